"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import kind_of, map_rows

#: Texts longer than this many characters are cut before encoding.
LONG = 1 << 16
#: Runs of white space of this many characters or more are encoded without the pattern.
RUN = 1 << 12
#: Where a match of a GPT-2 style pattern begins: at a single space between two
#: characters that are not white space, as no alternative holds a space
#: anywhere but at its start or within white space.
_SAFE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
# a run is looked for at its first character alone, or shorter runs would take time squared
_BLANKS = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{%d,}+" % RUN)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes, blank, rank on each line), once for each worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, most: int = LONG) -> Iterator[str]:
    """`text` in pieces that begin where a match begins, of about `most` characters.

    A stretch without a safe place stays whole, so the ids never change.
    """
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def matches(text: str, most: int = LONG) -> Iterator[tuple[str, bool]]:
    """`text` in pieces that begin where a match begins, with whether a piece is one match as it stands.

    A run of white space begins a match. At the end of a text it is one match;
    before anything else it is one but for its last character, which begins the
    next match. So long runs, which the library's regular expressions have no
    stack for, need no pattern.
    """
    start = 0
    for run in _BLANKS.finditer(text):
        if run.start() > start:
            for piece in safe_pieces(text[start : run.start()], most):
                yield piece, False
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : start], True
    if start < len(text):
        for piece in safe_pieces(text[start:], most):
            yield piece, False


def encode_text(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text; strings of special tokens are ordinary text."""
    if len(text) <= LONG:
        return codec.encode_to_numpy(text, disallowed_special=())
    single = lambda piece: np.array(codec._encode_single_piece(piece.encode()), np.uint32)
    ids = [single(piece) if whole else codec.encode_to_numpy(piece, disallowed_special=()) for piece, whole in matches(text)]
    return np.concatenate(ids) if len(ids) > 1 else ids[0]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Encodes every whole text.

    Returns (id, ids array<int>), with `decode` also decoded binary, the bytes
    that the ids stand for. A null text counts as empty: no ids and no bytes.
    Rows are independent, so repeated rows and ids come back as often as they
    came; columns other than the two named are not read. An empty table gives
    an empty result. Nothing is shuffled.
    """
    fields = {id_col: kind_of(df, id_col), "ids": "array<int>"} | ({"decoded": "binary"} if decode else {})

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        codec = encoding(rank_file, pattern)
        for keys, texts in batches:
            for first in range(0, len(keys), 256):
                ids = [encode_text(codec, text or "") for text in texts[first : first + 256]]
                out = {id_col: keys[first : first + 256], "ids": as_lists(ids)}
                if decode:
                    out["decoded"] = [codec.decode_bytes(x.tolist()) for x in ids]
                yield out

    return map_rows(df, [id_col, text_col], rows, fields)


def as_lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Arrays of ids as one Arrow array of lists."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

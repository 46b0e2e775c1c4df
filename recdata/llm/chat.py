"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn is written as

    <turn>ROLE<content>CONTENT</turn>

and a conversation is its turns one after the other. In texts and roles `&` is
written `&amp;` and `<` is written `&lt;`, so none of them can hold a control
string, and reading them back gives exactly what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The control strings of the template.
TURN, CONTENT, END = "<turn>", "<content>", "</turn>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}

#: An attachment within a text: its kind and its reference.
EMBEDDED = r"!\[(image|audio|document)\]\(([^()\x20\x09-\x0D]*)\)"

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PATCH, IMAGE_LEAST, AUDIO_RATE, PAGE_TOKENS = 28, 4, 12.5, 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """The content of a plain text: one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def parts_of(text: Column) -> Column:
    """The content of a text in which attachments stand as `![kind](reference)`: texts and attachments in turn, a text first and last.

    An attachment keeps what it was made of in `text`, so that it can be put back.
    """
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]

    def both(found: Column) -> Column:
        said = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("uri"), *nothing)
        kept = lambda a: F.struct(F.regexp_extract(a, EMBEDDED, 1).alias("kind"), a.alias("text"), F.regexp_extract(a, EMBEDDED, 2).alias("uri"), *nothing)
        return F.flatten(F.transform(F.split(text, EMBEDDED), lambda t, i: F.when(i < F.size(found), F.array(said(t), kept(F.get(found, i)))).otherwise(F.array(said(t)))))

    return let(F.regexp_extract_all(text, F.lit(EMBEDDED), F.lit(0)), both)


def part_tokens(part: Column) -> Column:
    """How many tokens the placeholder of an attachment stands for once expanded.

    Images: patches of PATCH x PATCH pixels; audio: AUDIO_RATE a second;
    documents: PAGE_TOKENS a page. Sizes that are null count as the least.
    """
    sides = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    return (
        F.when(part["kind"] == "image", F.greatest(sides, F.lit(IMAGE_LEAST)))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def flatten_parts(parts: Column) -> Column:
    """The parts of a turn, in order: escaped texts, and a placeholder for each attachment.

    A part of a kind that is not known, or null, is a text; a null text is empty.
    """
    written = F.coalesce(escape(F.lit("")), F.lit(""))

    def visit(part: Column) -> Column:
        out = F.coalesce(escape(part["text"]), written)
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """The references of a turn's attachments, in the order of their placeholders, with what each stood as (`source`: its markup, or its placeholder)."""
    found = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False)))
    return F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("n_tokens"), F.coalesce(p["text"], F.concat(F.lit("<"), p["kind"], F.lit(">"))).alias("source")))


def format_chats(df: DataFrame, parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: its turns in order of (turn, role, content), formatted.

    `df` has conv_id, turn, role and `parts_col`, an array of PART. Returns
    conv_id, formatted, mask: the lengths of consecutive stretches of
    `formatted` with whether they count in the loss (the content of turns of
    `loss_role`), attachments of the whole conversation, and by_turn, the same
    for each turn. Null roles, texts
    and arrays count as empty; null turns come first; repeated rows are
    repeated turns; the rows with null conv_id are one conversation; other
    columns are not read. Rows are formatted before they are grouped, so that
    what is left for a group is to sort and join its turns.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct(
        F.col("turn").alias("turn"),
        role.alias("role"),
        flatten_parts(parts).alias("content"),
        F.concat(F.lit(TURN), escape(role), F.lit(CONTENT)).alias("head"),
        attachments(parts).alias("attachments"),
    )
    rows = F.array_sort(F.collect_list("t"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "")
    stretch = lambda text, loss: F.struct(F.length(text).cast("long").alias("n_chars"), loss.alias("loss"))
    mask = F.flatten(F.transform("turns", lambda t: F.array(stretch(t["head"], F.lit(False)), stretch(t["content"], t["role"] == loss_role), stretch(F.lit(END), F.lit(False)))))
    return (
        df.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(rows.alias("turns"))
        .select("conv_id", joined.alias("formatted"), mask.alias("mask"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"), F.transform("turns", lambda t: t["attachments"]).alias("by_turn"))
    )


_ANY = "<(?:" + "|".join(PLACEHOLDERS) + ")>"


def _restored(content: Column, attached: Column | None) -> Column:
    """A turn's content unescaped, with each placeholder replaced by the source of its attachment; without `attached` placeholders stay."""
    if attached is None:
        return unescape(content)
    # texts hold no unescaped "<", so whatever looks like a placeholder is one
    return F.array_join(F.transform(F.split(content, _ANY), lambda t, k: F.concat(unescape(t), F.coalesce(F.get(attached, k)["source"], F.lit("")))), "")


def read_turns(formatted: Column, by_turn: Column | None = None) -> Column:
    """The turns of a formatted conversation: role and text, unescaped. With `by_turn` attachments are put back, else placeholders stay."""
    pieces = F.filter(F.split(formatted, END), lambda piece: piece != "")

    def turn(piece: Column, i: Column) -> Column:
        body = F.substring_index(piece, TURN, -1)
        attached = None if by_turn is None else F.get(by_turn, i)
        return F.struct(unescape(F.substring_index(body, CONTENT, 1)).alias("role"), _restored(F.substring_index(body, CONTENT, -1), attached).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column, by_turn: Column | None = None) -> Column:
    """The text under the loss mask, unescaped; with `by_turn` attachments are put back.

    Three stretches of the mask stand for a turn, so each turn is cut out of
    its own piece and the time is linear in the length.
    """
    pieces = F.filter(F.split(formatted, END), lambda piece: piece != "")

    def counted(piece: Column, i: Column) -> Column:
        head, body = F.get(mask, 3 * i), F.get(mask, 3 * i + 1)
        attached = None if by_turn is None else F.get(by_turn, i)
        return F.when(body["loss"], _restored(piece.substr((head["n_chars"] + 1).cast("int"), body["n_chars"].cast("int")), attached)).otherwise("")

    return F.array_join(F.transform(pieces, counted), "")

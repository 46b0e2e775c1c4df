"""Column functions on text. Patterns avoid look-around and back references, so other engines read them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of items and reviews, and the pattern of mark-up.
END_OF_ITEM = "<ENDOFITEM>"
END_OF_REVIEW = "<end of review>"
TAGS = r"<[^\n]*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def strip_markup(value: Column) -> Column:
    """Without tags and entities."""
    return F.regexp_replace(value, TAGS, "")


def clean_white_space(value: Column) -> Column:
    """Line breaks and tabs become spaces."""
    return F.regexp_replace(value, r"[\n\t\r]", " ")


def parse_list(value: Column, dedupe: bool = False) -> Column:
    """A written list (['a', 'b']) as an array: split at commas, quotes and brackets dropped, trimmed.

    With `dedupe` the first of equal entries stays. Null counts as one empty entry, as an empty text does.
    """
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"['\"\[\]]", ""), "  ", " ")))
    return F.array_distinct(parts) if dedupe else parts


def flatten_description(value: Column) -> Column:
    """A written list of paragraphs as one text: brackets and the quotes around entries dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"^\[|\]$", ""), r"^'|'$|', '", " "))


def top_entries(values: Column, k: int) -> Column:
    """The first `k` entries of a sorted array, comma-separated."""
    return F.array_join(F.slice(values, 1, k), ", ")


def blank_if_like(value: Column) -> Column:
    """Empty where the cell holds "like"."""
    return F.when(value.contains("like"), F.lit("")).otherwise(value)


def normalise_text(value: Column, lower: bool = True, negation: bool = True) -> Column:
    """Without review marks; optionally in lower case and with n't written as not. Null is empty."""
    out = F.replace(F.coalesce(value, F.lit("")), F.lit(END_OF_REVIEW), F.lit(""))
    out = F.lower(out) if lower else out
    return F.replace(out, F.lit("n't"), F.lit(" not")) if negation else out


def normalise_tokens(tokens: Column) -> Column:
    """Tokens with n't as a token of its own become not."""
    return F.transform(tokens, lambda t: F.when(t == "n't", F.lit("not")).otherwise(t))


def join_fields(fields: list[Column], separator: str = ". ") -> Column:
    """Fields joined by ". ", repeated separators collapsed, trimmed; null counts as empty."""
    joined = F.concat_ws(separator, *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.trim(F.regexp_replace(joined, r"(\. )+", ". "))


def tokenize(value: Column) -> Column:
    """Basic English tokens of a lower-cased text.

    Spaces around ' . , ( ) ! ?, double quotes deleted, ; : and line-break tags
    become spaces. Null and blank texts have none.
    """
    text = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"<br />|[;:]", " ")
    text = F.regexp_replace(F.regexp_replace(text, '"', ""), r"(['.,()!?])", r" $1 ")
    return F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda t: t != "")


def sentences(value: Column) -> Column:
    """Sentences: cut after . ! or ? with white space behind. Blank texts have none."""
    marked = F.regexp_replace(F.coalesce(value, F.lit("")), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"[\n\t\r]", " "))), lambda s: s != "")


def ngrams(tokens: Column, sizes: tuple[int, ...] = (1,)) -> Column:
    """All n-grams of the given sizes, the tokens of each joined by a space; all of the first size come first."""

    def of(t: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*(of(t, n) for n in sizes)))


def chunk_tokens(tokens: Column, size: int) -> Column:
    """Consecutive runs of `size` tokens; no tokens make one empty chunk."""
    empty = F.array(F.array().cast("array<string>"))
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.size(t), F.lit(size)), lambda i: F.slice(t, i, size))
    return let(tokens, lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(empty))


def chunk_items(value: Column, size: int) -> Column:
    """One chunk for each item of a profile whose items end with the mark, cut at `size` tokens."""
    items = F.filter(F.split(value, END_OF_ITEM), lambda x: F.trim(x) != "")
    cut = F.transform(items, lambda x: F.slice(tokenize(x), 1, size))
    return F.when(F.size(items) > 0, cut).otherwise(F.array(F.array().cast("array<string>")))


def truncate(tokens: Column, length: int) -> Column:
    return F.slice(tokens, 1, length)


def all_letters(ngram: Column) -> Column:
    """Whether each token of an n-gram consists of letters."""
    return ngram.rlike(r"^\p{L}+( \p{L}+)*$")

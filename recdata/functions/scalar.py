"""Column functions on numbers, ratings and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a five-level rating, lowest first.
RATING_WORDS = ("did not like it", "it was ok", "liked it", "really liked it", "it was amazing")
#: Bins of counts: (lower, upper or None).
BINS = ((1, 5), (6, 10), (11, 50), (51, 100), (101, 200), (201, 500), (501, 1000), (1001, None))


def hash_key(seed: int, *columns: str | Column) -> Column:
    """The text that replaces a random draw: md5 of the seed and some ids. Ordering by it shuffles rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)))


def hash_int(key: Column) -> Column:
    """An integer from 0 to 2^32 - 1 of a `hash_key`."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def hash_uniform(key: Column) -> Column:
    """A number over 0 and under 1 of a `hash_key`."""
    return (hash_int(key) + F.lit(0.5)) / F.lit(4294967296.0)


def round_half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def scale_clamp(value: Column, low: float, high: float) -> Column:
    """Min-max scaled, and held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(float(low))) / F.lit(float(high - low))))


def rating_to_int(value: Column, dataset: str = "number") -> Column:
    """`words`: the five rating words to 1..5, anything else to 0; `number`: cast by way of a double; null to -1."""
    if dataset == "words":
        out = reduce(lambda acc, kv: acc.when(F.lower(F.trim(value)) == kv[1], F.lit(kv[0])), enumerate(RATING_WORDS, 1), F.when(value.isNull(), F.lit(-1)))
        return out.otherwise(F.lit(0))
    return F.coalesce(value.try_cast("double").cast("int"), F.lit(-1))


def parse_count(value: Column) -> Column:
    """A count with thousands commas; null if it is none."""
    return F.regexp_replace(value, ",", "").try_cast("bigint")


def parse_sales_rank(value: Column) -> Column:
    """The rank in Books, in the paid or the free Kindle store, or in anything else: the first that the text has fills its field, the others are infinite."""
    patterns = {"books": r"([\d,]+) in Books", "paid": r"([\d,]+) Paid in Kindle Store", "free": r"([\d,]+) Free in Kindle Store", "any": r"([\d,]+) in "}
    number = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(value, p, 1), F.lit("")), ",", "").try_cast("double")
    fields, found = [], F.lit(False)
    for name, pattern in patterns.items():
        rank = number(pattern)
        fields.append(F.when(~found & rank.isNotNull(), rank).otherwise(F.lit(float("inf"))).alias(name))
        found = found | rank.isNotNull()
    return F.struct(*fields)


def bucket(value: Column, bins: tuple = BINS) -> Column:
    """The name of the bin, such as 6-10 or 1001+; null outside all."""
    out = F.lit(None).cast("string")
    for low, high in reversed(bins):
        inside = (value >= low) if high is None else value.between(low, high)
        out = F.when(inside, F.lit(f"{low}+" if high is None else f"{low}-{high}")).otherwise(out)
    return out


def group_label(count: Column, thresholds: tuple[int, ...] = (5, 50)) -> Column:
    """1-5, 6-50, 51+ for thresholds 5 and 50; 0 for none or null."""
    lows = (1, *(t + 1 for t in thresholds))
    bins = tuple((low, high) for low, high in zip(lows, (*thresholds, None), strict=True))
    return F.coalesce(bucket(count, bins), F.lit("0"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(dot(v, v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))

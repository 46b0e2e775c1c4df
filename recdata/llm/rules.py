"""Line-first quality rules, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

# The characters that count as symbols, and the phrases of boilerplate.
SYMBOL = r"[#*$%&|<>]"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies"
    r"|subscribe to our newsletter|sign up for our newsletter|click here|javascript (is|must be) (enabled|disabled)|skip to (main )?content"
    r"|alle rechte vorbehalten|datenschutzerkl\x{e4}rung|nutzungsbedingungen|cookies akzeptieren|hier klicken"
    r"|tous droits r\x{e9}serv\x{e9}s|politique de confidentialit\x{e9}|conditions d'utilisation|accepter (tous )?les cookies|cliquez ici"
    r"|todos los derechos reservados|pol\x{ed}tica de privacidad|t\x{e9}rminos de uso|aceptar (todas )?las cookies|haga clic aqu\x{ed})"
)
#: A phrase of boilerplate fails a line of this many words at most; within a longer one it is prose.
BOILERPLATE_WORDS = 15
#: A separator that stands alone between two words.
SEPARATOR = r"[\x20\x09][|\x{203a}\x{2022}\x{b7}\x{bb}][\x20\x09]"
#: The opening quotation mark: a line that has it uses the closing one to quote.
QUOTE = "\u00ab"
#: A line of navigation has three separators or more, and so many of its words, separators included, for each.
NAVIGATION_WORDS = 5
#: A word followed by the same kind of symbol twice or more, as shouting and mark-up debris have it.
DEBRIS = r"[^\x20\x09-\x0D](!!+|\?\?+|[#*$%&<>~^=+]{2,})"

#: A line of this many words or more has a mark of a sentence somewhere.
SENTENCE_WORDS, SENTENCE_MARK = 20, r"[.!?:;\x{2026}\x{3002}\x{ff01}\x{ff1f}]"
#: Of a line that stands so often in a text, only the first stays.
REPEATS = 3

#: A document goes if its cleaning takes away this share of its word characters, in hundredths.
MOST_LOST = 50


def word_chars(text: Column) -> Column:
    """How many code points of a text lie in words."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more.

    Windows are compared by a 64-bit hash; within one text two different ones
    share it with a chance of about 1e-11 for 20,000 words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hashes) - 1

        def twice(at: Column) -> Column:
            same = lambda p, j: ((j > 0) & (F.get(at, j - 1)["h"] == p["h"])) | ((j < last) & (F.get(at, j + 1)["h"] == p["h"]))
            return F.flatten(F.transform(F.filter(at, same), lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, F.size(F.array_distinct(let(pairs, twice)))).otherwise(0)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, let(hashes, covered)).otherwise(0)

    return let(tokens, of)


def failing_line(line: Column, n_words: Column) -> Column:
    """Whether a line of so many words goes: by punctuation (debris, or no sentence), as navigation or as boilerplate. Lines without a word stay."""
    punctuation = let(F.regexp_count(line, F.lit(DEBRIS)), lambda debris: (debris >= 2) & (2 * debris >= n_words))
    navigation = let(F.regexp_count(line, F.lit(SEPARATOR)), lambda n: (n >= 3) & (NAVIGATION_WORDS * n >= n_words)) & ~F.contains(line, F.lit(QUOTE))
    endless = (n_words >= SENTENCE_WORDS) & ~line.rlike(SENTENCE_MARK)
    return (n_words > 0) & (punctuation | endless | navigation | ((n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)))


def repeated_lines(lines: Column) -> Column:
    """For each of some lines (structures with line and words) whether it has words, equals an earlier line, and stands REPEATS times or more.

    Lines are sorted and compared with their neighbours, so the time is that of
    a sort however many lines there are.
    """

    def told(at: Column) -> Column:
        same = lambda p, j: (j >= 0) & (F.get(at, F.greatest(j, F.lit(0)))["line"] == p["line"])
        after = lambda p, j: F.coalesce(F.get(at, j)["line"] == p["line"], F.lit(False))
        return F.transform(at, lambda p, j: F.struct(p["i"].alias("i"), (same(p, j - 1) & (same(p, j - 2) | after(p, j + 1))).alias("again")))

    placed = F.array_sort(F.transform(lines, lambda x, i: F.struct(x["line"].alias("line"), i.alias("i"))))
    back = lambda flags: F.transform(F.array_sort(flags), lambda f: f["again"])
    some = F.size(F.array_distinct(F.transform(lines, lambda x: x["line"]))) <= F.size(lines) - (REPEATS - 1)
    flags = F.when(some, back(let(placed, told))).otherwise(F.array().cast("array<boolean>"))
    return let(flags, lambda f: F.transform(lines, lambda x, i: (F.size(x["words"]) > 0) & F.coalesce(F.get(f, i), F.lit(False))))


def _judged(text: Column, most_lost: int) -> Column:
    """All that `clean_lines` tells of a text, as one structure; every line is taken apart once."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("words")))
    fails = lambda x, i, again: failing_line(x["line"], F.size(x["words"])) | F.get(again, i)
    marked = lambda ls: let(repeated_lines(ls), lambda again: F.transform(ls, lambda x, i: F.struct(x["line"].alias("line"), x["words"].alias("words"), fails(x, i, again).alias("fails"))))
    joined = lambda ls, fails: F.array_join(F.transform(F.filter(ls, lambda x: x["fails"] == fails), lambda x: x["line"]), "\n")
    filled = lambda ls: F.transform(F.filter(ls, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])

    def counts(ls: Column) -> Column:
        tokens = F.flatten(F.transform(ls, lambda x: x["words"]))
        return F.struct(
            joined(ls, False).alias("cleaned"),
            F.size(tokens).cast("long").alias("n_words"),
            word_chars(text).cast("long").alias("word_chars"),
            repeated_words(tokens).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(filled(ls), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.filter(ls, lambda x: x["fails"])).cast("long").alias("n_lines_failed"),
            word_chars(joined(ls, True)).cast("long").alias("lost_chars"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        kept = ~failed & (100 * c["lost_chars"] <= most_lost * c["word_chars"])
        return F.struct(*(c[name].alias(name) for name in COUNTS), failed.alias("base_failed"), kept.alias("kept"))

    return let(let(let(lines, marked), counts), verdict)


COUNTS = ("cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_failed", "lost_chars")


def clean_lines(df: DataFrame, text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """Judges every line, by itself and by how often it stands in its text, removes those that fail, then judges the document.

    Adds cleaned (the text of the lines left, in order), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_failed, lost_chars
    (word characters in the lines removed), base_failed and kept. A null text
    counts as empty; texts without 50 words fail. Every row is judged by itself:
    repeated rows all get the same verdict, an empty table gives an empty one,
    existing columns of those names are replaced and all others stay. Nothing
    is shuffled. A very long text is one row, and its time and memory grow with
    its length.
    """
    told = (*COUNTS, "base_failed", "kept")
    others = [F.col(f"`{c}`") for c in df.columns if c not in told]
    # a generator, so that a filter on its columns does not compute them again
    return df.select(*others, F.inline(F.array(_judged(F.coalesce(F.col(text_col), F.lit("")), most_lost))))

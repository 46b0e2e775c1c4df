"""Column functions on hand-made cases."""

from pyspark.sql import functions as F

from recdata.functions import scalar, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_text_cleaning(spark):
    rows = [("don't",), ("<b>x</b>&amp;",), ("",), (None,), ("a\tb\nc",)]
    got = values(spark, rows, "t string", n=text.normalise_text(F.col("t")), m=text.strip_markup(F.col("t")), w=text.clean_white_space(F.col("t")))
    assert [g["n"] for g in got] == ["do not", "<b>x</b>&amp;", "", "", "a\tb\nc"]
    assert got[1]["m"] == "x" and got[4]["w"] == "a b c"


def test_join_fields_collapses(spark):
    got = values(spark, [("a", None, "b"), (". . .", "", "")], "x string, y string, z string", j=text.join_fields([F.col("x"), F.col("y"), F.col("z")]))
    assert got[0]["j"] == "a. b"
    assert ". . " not in got[1]["j"]


def test_lists(spark):
    got = values(spark, [("['Sci-Fi', \"Art\", 'Art']",), (None,), ("",)], "t string", p=text.parse_list(F.col("t")), d=text.parse_list(F.col("t"), dedupe=True))
    assert got[0] == {"p": ["Sci-Fi", "Art", "Art"], "d": ["Sci-Fi", "Art"]}
    assert got[1]["p"] == [""] and got[2]["p"] == [""]


def test_tokens_sentences_ngrams_chunks(spark):
    got = values(
        spark, [('He said: "No!" It\'s (fine).  Really?\nYes',), ("",), (None,)], "t string",
        t=text.tokenize(F.col("t")), s=text.sentences(F.col("t")), g=text.ngrams(text.tokenize(F.col("t")), (1, 2)), c=text.chunk_tokens(text.tokenize(F.col("t")), 4),
    )
    assert got[0]["t"] == ["he", "said", "no", "!", "it", "'", "s", "(", "fine", ")", ".", "really", "?", "yes"]
    assert got[0]["s"] == ['He said: "No!" It\'s (fine).', "Really?", "Yes"]
    assert got[0]["g"][:14] == got[0]["t"] and got[0]["g"][14] == "he said" and len(got[0]["g"]) == 27
    assert [len(c) for c in got[0]["c"]] == [4, 4, 4, 2]
    assert got[1] == got[2] == {"t": [], "s": [], "g": [], "c": [[]]}


def test_numbers(spark):
    got = values(
        spark, [("it was amazing", "1,234", 1.005, 7), ("", "x", 2.5, 0), (None, None, None, None)], "r string, c string, v double, n int",
        r=scalar.rating_to_int(F.col("r"), "words"), c=scalar.parse_count(F.col("c")), v=scalar.round_half_up(F.col("v"), 0), b=scalar.bucket(F.col("n")), g=scalar.group_label(F.col("n")),
    )
    assert got[0] == {"r": 5, "c": 1234, "v": 1.0, "b": "6-10", "g": "6-50"}
    assert got[1] == {"r": 0, "c": None, "v": 3.0, "b": None, "g": "0"}
    assert got[2] == {"r": -1, "c": None, "v": None, "b": None, "g": "0"}


def test_sales_rank(spark):
    rows = [("12,345 in Books (",), ("#7 Paid in Kindle Store (",), ("#9 Free in Kindle Store",), ("nothing",), (None,)]
    got = [g["r"] for g in values(spark, rows, "t string", r=scalar.parse_sales_rank(F.col("t")))]
    inf = float("inf")
    assert [g["books"] for g in got] == [12345.0, inf, inf, inf, inf]
    assert got[1]["paid"] == 7.0 and got[2]["free"] == 9.0 and got[4]["any"] == inf

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text

CASES = {
    "getHTTPServer": ["gethttpserver", "get", "http", "server"],
    "_load_model foo_": ["_load_model", "load", "model", "foo_", "foo"],
    "THE end": ["the", "the", "end"],
    "3.14 v1.2 1_000 5": ["3.14", "v1", "_000", "000"],
    "schön": ["sch"],
    "the a of": [],
    "__ _": [],
    "vllmModelExecutor": ["vllmmodelexecutor", "vllm", "model", "executor"],
    "": [],
}


def humps(word: str) -> list[str]:
    out = word[:1]
    for before, c, after in zip(word, word[1:], word[2:] + " "):
        small = "a" <= before <= "z" or "0" <= before <= "9"
        cut = "A" <= c <= "Z" and (small or "A" <= before <= "Z" and "a" <= after <= "z")
        out += "_" * cut + c
    return out.split("_")


def model(s: str) -> list[str]:
    """The same rule, word by word."""
    out = []
    for raw in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?", s):
        ok = lambda t: len(t) > 1 and t.strip("_")
        if "_" in raw or re.search("[A-Z]", raw[1:]):
            out += [t.lower() for t in [raw, *(p for w in raw.split("_") for p in humps(w))] if ok(t)]
        elif ok(raw.lower()) and raw.lower() not in text.STOPWORDS:
            out.append(raw.lower())
    return out


def tokens(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(text.tokenize(F.col("t"))).collect()]


def test_tokens(spark):
    assert tokens(spark, list(CASES)) == list(CASES.values())
    assert tokens(spark, [None, "١٢٣ x"]) == [[], ["١٢٣"]]


def test_tokens_against_a_model(spark):
    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.text("abAB_ 1.é", max_size=12), min_size=40, max_size=60))
    def check(rows):
        assert tokens(spark, rows) == [model(r) for r in rows]

    check()


def test_cache_key(spark):
    df = spark.createDataFrame([("  What  IS rag ",), ("what is rag",), (" what\tis\nrag",)], "q string")
    keys = {r[0] for r in df.select(text.cache_key(F.col("q"), F.lit(5))).collect()}
    assert len(keys) == 1 and keys.pop().startswith("cf68d2d1")


def test_decoded_and_blank(spark):
    df = spark.createDataFrame([(b"a\r\nb\rc\xff",)], "c binary")
    assert df.select(text.decoded(F.col("c"))).first()[0] == "a\nb\nc�"
    rows = spark.createDataFrame([("",), (" \t\n ",), (" x ",)], "t string")
    assert [r[0] for r in rows.select(text.not_blank(F.col("t"))).collect()] == [False, False, True]


def test_suffix(spark):
    rows = ["a/b.PY", ".md", "x/.md", "noext", "a.b.txt", "a.d/readme"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [r[0] for r in df.select(text.suffix(F.col("p"))).collect()] == [".py", "", "", "", ".txt", ""]

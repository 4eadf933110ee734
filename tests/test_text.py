import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.folding import fold, fold_key
from tracewell.operators.chunking import pack_paragraphs, pack_with_windows


@pytest.mark.parametrize(
    "stored, form",
    [
        ("20 Ａｍｐ", "20 Amp"), ("４ сores", "4 cores"), ("㎸А", "kVA"), ("m² ± × ≤ ★ ₩ € Δt μm Ω ½ ①", "m² ± × ≤ ★ ₩ € Δt μm Ω ½ ①"), ("Вектрон", "Вектрон"),
        ("4‑pole x", "4-pole x"), ("a​b­c﻿", "abc"), ("é", "é"), ("매", "매"), ("l1\r\nl2\t", "l1\r\nl2\t"), ("", ""), ("Ω µ", "Ω μ"),
        ("ﬁt ℃", "fit °C"),
    ],
)
def test_fold(stored, form):
    assert fold(stored) == form and fold(form) == form


def test_fold_key():
    assert fold_key("  ＡＢ　C\n") == "ab c" and fold_key(None) is None and fold_key("Straße") == "strasse"


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


def test_expressions(spark):
    t = F.col("t")
    assert values(spark, X.lexical_tokens(t), "Cable AND 3.5 kV", None, "") == [["cable", "3.5", "kv"], None, []]
    assert values(spark, X.fixed_windows(t, 10, 5), "x" * 25, "abc", "") == [["x" * 10] * 4, ["abc"], [""]]
    assert values(spark, X.clause_of(t), "see KEC 140.2", "제 3 조 본문", "212.3 applies", "none") == ["KEC 140.2", "제3조", "212.3", None]
    assert values(spark, X.split_paragraphs(t), "a.\n\nb c", "One. Two", "") == [["a.", "b c"], ["One.", "Two"], []]
    assert values(spark, X.drawing_number(t), "E 101A", "ab_12", "none") == ["E-101A", "AB-12", None]
    assert values(spark, X.url_component(t), "a b!(1)'*~", "가") == ["a%20b!(1)'*~", "%EA%B0%80"]
    got = values(spark, X.fnv1a(t), "hello", "a")
    assert got == [0x4F9F2CAB, 0xE40C292C]
    seq = X.contains_sequence(F.split(t, " "), F.array(F.lit("b"), F.lit("c")))
    assert values(spark, seq, "a b c", "b a c", "b") == [True, False, False]


def test_packers():
    text = "\n\n".join(["p" * 500, "q" * 500, "r" * 500, "short", "s" * 3000])
    chunks = pack_paragraphs(text)
    assert all(len(c) <= 1200 for c in chunks) and chunks[0] == "p" * 500 + "\n\n" + "q" * 500 and chunks[1].startswith("q" * 150 + "r" * 500)
    assert pack_paragraphs(None) == [] and pack_paragraphs("tiny") == []
    assert [len(c) for c in pack_with_windows("a" * 2500)] == [1000, 1000, 700] and pack_with_windows(None) == []


def test_compatible_forms_are_searched_alike(spark):
    from tracewell.operators.retrieval import lexical_search, query_tokens

    rows = [(1, "ground rod 12", None), (2, "\uff27\uff32\uff2f\uff35\uff2e\uff24 rod \uff11\uff12", None), (3, "nothing", "ground rod"), (4, None, None), (5, "\u1100\u1161", None)]
    df = spark.createDataFrame(rows, "id long, text string, clause string")
    got = {r["id"]: r["score"] for r in lexical_search(df, "\uff47round rod", 10, "id", "text", "clause").collect()}
    assert got[1] == got[2] == 0.833333 and set(got) == {1, 2, 3}
    assert [r["id"] for r in lexical_search(df, "\uac00", 10, "id", "text", "clause").collect()] == [5]
    assert query_tokens("\uff21\uff2e\uff24 \u2460") == ["1"] and lexical_search(df, "and", 10, "id", "text").count() == 0

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.encode import decode_ids, encode_corpus, encode_ids, load, vocabulary
from tracewell.llm.lookalikes import consistent_forms
from tracewell.llm.split import split_by_tokens, split_items, split_text, token_edges

TEXT = st.text(alphabet=st.sampled_from("ab. \n\r다|,가😀"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[p["fresh"] : p["end"]] for p in pieces) == text
    for before, after in zip(pieces, pieces[1:]):
        assert after["piece"][: after["fresh"] - after["start"]] == (before["piece"][-overlap:] if overlap else "")
    assert all(len(p["piece"]) <= limit for p in pieces)


def test_natural_boundaries_first():
    text = "Sentence one is here. " * 30 + "\n\n" + "tail " * 100
    assert split_text(text, 700, 50)[0]["piece"].endswith("\n\n")
    assert split_text("x" * 3000)[0]["end"] == 1200
    with pytest.raises(ValueError):
        split_text("x" * 10, 5, 5)


def test_split_items(spark):
    rows = [("a", "long " * 600, None, "clash"), ("a", "long " * 600, None, "clash"), ("b", "short", "1", ""), ("c", None, None, ""), ("d", "", None, "")]
    out = split_items(spark.createDataFrame(rows, "id string, text string, clause string, piece string"), "text", ["id", "clause"]).collect()
    assert {r["id"] for r in out} == {"a", "b", "d"} and sum(r["id"] == "a" for r in out) == 3
    assert split_items(spark.createDataFrame([], "id string, text string"), "text", ["id"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(12, 40), st.integers(0, 4))
def test_pieces_of_tokens(text, limit, overlap):
    """Sizes in tokens: pieces cover the text, cut no character, hold at most the limit, and are the text itself below it."""
    edges = token_edges(text, vocabulary())
    pieces = split_text(text, limit, overlap, edges)
    assert "".join(text[p["fresh"] : p["end"]] for p in pieces) == text
    assert all(p["units"] <= limit and p["piece"] == text[p["start"] : p["end"]] for p in pieces)
    assert all(0 <= a["end"] - b["start"] and a["end"] == b["fresh"] for a, b in zip(pieces, pieces[1:]))
    assert (len(pieces) == 1) == (len(edges) - 1 <= limit)


def test_split_by_tokens(spark):
    rows = [("a", "Sentence one is here. " * 60, "x"), ("a", "Sentence one is here. " * 60, "x"), ("b", "short", "y"), ("c", None, "z"), ("d", "", "z")]
    out = split_by_tokens(spark.createDataFrame(rows, "id string, text string, piece string"), "text", ["id"], 100, 10).orderBy("id", "piece_index").collect()
    assert {r.id for r in out} == {"a", "b", "d"} and [r.units for r in out if r.id != "a"] == [1, 0]
    mine = [r for r in out if r.id == "a"]
    assert len(mine) > 2 and all(r.units <= 100 and r.n_pieces == len(mine) for r in mine) and all(r.piece.rstrip().endswith(".") for r in mine)
    assert split_by_tokens(spark.createDataFrame([], "id string, text string"), "text", ["id"], 100, 10).count() == 0


def test_counts_are_the_encoder_s(spark):
    from tracewell.llm.encode import count_tokens

    df = spark.createDataFrame([*DOCS, (6, "don't  stop\u00a0 now\r\n x" + "y" * 3000)], "id long, text string")
    got = {r.id: r.n for r in df.select("id", count_tokens("text").alias("n")).collect()}
    assert got == {r["id"]: len(r["ids"]) for r in encode_corpus(df, "id", "text").collect()}


DOCS = [(1, "Hello, world <|endoftext|> 😀 접지"), (1, "Hello, world <|endoftext|> 😀 접지"), (2, None), (3, ""), (4, " \n\t "), (5, "가나다" * 20000)]


def test_encode_round_trip(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    ids = encode_corpus(df, "id", "text")
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert len(got) == 5 and got[2] == [] == got[3] and 50256 not in got[1]
    back = {r["id"]: r["t"] for r in ids.select("id", decode_ids("ids").alias("t")).collect()}
    assert back == {i: t or "" for i, t in DOCS}
    assert got[1] == load(vocabulary()).encode(DOCS[0][1], add_special_tokens=False).ids


def test_offsets(spark):
    rows = encode_corpus(spark.createDataFrame(DOCS[:1], "id long, text string"), "id", "text", offsets=True).collect()
    assert len(rows[0]["ids"]) == len(rows[0]["starts"]) and rows[0]["ends"][-1] == len(DOCS[0][1])
    assert spark.createDataFrame([], "t string").select(encode_ids("t")).count() == 0


def test_forms(spark):
    rows = [(1, "Ａ　B", None, "x"), (1, "Ａ　B", None, "x"), (2, "plain", "m²", "y"), (3, None, "cаble", "z")]
    out = consistent_forms(spark.createDataFrame(rows, "id long, name string, spec string, form string"), "t", "id", ["name", "spec"]).distinct().collect()
    got = {(r["field_name"], r["row_key"]): (r["disguised"], r["form"], r["form_key"]) for r in out}
    assert got == {
        ("name", "1"): (True, "A B", "a b"), ("name", "2"): (False, "plain", "plain"), ("spec", "2"): (False, "m²", "m²"), ("spec", "3"): (True, "cable", "cable"),
    }

import pytest

from tracewell.operators import store

S = "k int, v string, n int"


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], S)
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], S)
    assert {tuple(r)[:2] for r in store.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    after, conflicts = store.insert_if_absent(old, new, ["k"], ["v"])
    assert {r["k"] for r in after.collect()} == {1, 2, 3} and {r["k"] for r in conflicts.collect()} == {2}
    path = str(tmp_path / "t")
    store.write_table(old, path)
    store.write_table(store.upsert(spark.read.parquet(path), new, ["k"], "n"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(RuntimeError):
        store.prune_sources(old, new.select("k"), old.select("k"), "k")
    assert store.prune_sources(old, old.select("k"), old.where("k = 1").select("k"), "k").count() == 1


def test_pages(spark):
    rows = spark.createDataFrame([(a, b) for a in "ab" for b in range(5)], "a string, b int")
    first = store.keyset_page(rows, ["a", "b"], None, 4).collect()
    rest = store.keyset_page(rows, ["a", "b"], ("a", 3), 10).collect()
    assert len(first) == 4 and first[0]["has_more"] and len(rest) == 6 and not rest[0]["has_more"]
    with pytest.raises(ValueError):
        store.keyset_page(rows, ["a"], None, 0)

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.packing import fill_containers, pack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_pack_is_whole_and_within_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    bins = pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 100 for b in bins)


def test_search_improves_on_the_start():
    sizes = np.array([60, 60, 40, 40, 35, 35, 30], np.int64)
    assert len(pack(sizes, 100)) == 3


def test_two_for_one_beyond_any_number_of_items():
    """The exchange that empties a container may take any two of its items."""
    from tracewell.llm.packing import _offers

    sizes = np.array([1] * 40 + [7, 9], np.int64)
    totals, groups = _offers(sizes, np.arange(42))
    assert totals.tolist() == [1, 2, 7, 8, 9, 10, 16] and all(sizes[list(g)].sum() == t for t, g in zip(totals, groups))
    assert all(len(set(g)) == len(g) for g in groups)


def test_containers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(s), "x") for i, s in enumerate(rng.integers(1, 900, 400))] + [(900, 5000, "x"), (901, 2048, "x"), (902, 4096, "x"), (903, None, "x"), (904, 0, "x"), (None, 5, "x"), (900, 5000, "x")]
    out = fill_containers(spark.createDataFrame(rows, "id long, n int, part string"), "id", "n", block=128).toPandas()
    assert out.groupby("container_id")["size"].sum().max() <= 2048
    want = {i: s for i, s, _ in rows if s and i is not None}
    assert out.groupby("id")["size"].sum().to_dict() == want
    assert set(out.id[out.groupby("id")["part"].transform("count") > 1]) == {900, 902}
    assert out.container_id.nunique() <= np.ceil(out["size"].sum() / 2048) + 2
    for _, parts in out.groupby("id"):
        parts = parts.sort_values("start")
        assert (parts.start.to_numpy()[1:] == (parts.start + parts["size"]).to_numpy()[:-1]).all()
    assert fill_containers(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0

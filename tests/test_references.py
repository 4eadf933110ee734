import random
from collections import Counter
from datetime import datetime, timedelta

from tracewell.operators.references import orphan_references, references, targets

REF, TGT = "id long, k string, at timestamp, period string", "k string, s timestamp, e timestamp, id int"
DAY = datetime(2024, 1, 1)


def brute(refs, tgts):
    known, out = {}, {}
    for k, s, e, _ in tgts:
        known[k] = (s, e)
    for _, k, at, _ in set(refs):
        if k is None:
            continue
        fault = "missing"
        if k in known:
            s, e = known[k]
            fault = "deleted" if e is not None and at >= e else "not_yet" if at < s else None
        out.setdefault((k, at.strftime("%Y-%m")), Counter())[fault] += 1
    return {key: (sum(c.values()), c["missing"], c["deleted"], c["not_yet"]) for key, c in out.items() if sum(c.values()) > c[None]}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(40)]
    tgts = [(k, DAY + timedelta(days=rng.randrange(120)), rng.choice([None, DAY + timedelta(days=130 + rng.randrange(100))]), 0) for k in keys[:30]]
    refs = [(i, "k0" if i % 3 == 0 else rng.choice(keys), DAY + timedelta(hours=rng.randrange(6000)), "own column") for i in range(3000)]
    refs += refs[:50] + [(9_999, None, DAY, "")]
    got = orphan_references(
        references(spark.createDataFrame(refs, REF), ["id"], ["k"], "at"), targets(spark.createDataFrame(tgts * 2, TGT), ["k"], "s", "e"), heavy_share=8
    ).collect()
    assert {(r["k0"], r["period"]): (r["references"], r["missing"], r["deleted"], r["not_yet"]) for r in got} == brute(refs, tgts)
    assert len(got) == len({(r["k0"], r["period"]) for r in got})


def test_empty_sides(spark):
    none, refs = spark.createDataFrame([], TGT), spark.createDataFrame([(1, "a", DAY, "")], REF)
    assert orphan_references(references(refs, ["id"], ["k"], "at"), targets(none, ["k"], "s", "e")).count() == 1
    assert orphan_references(references(refs.limit(0), ["id"], ["k"], "at"), targets(none, ["k"], "s", "e")).count() == 0

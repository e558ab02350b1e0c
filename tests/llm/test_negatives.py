"""Hard negatives: searches against full scoring, whole results against brute force, odd rows, slabs."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from histmetrics.llm import negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows):
    known = {
        (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, label, v in known:
        if i % 50:
            continue
        scored = {(-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in known if j != i}
        order = sorted(scored)
        for p, positive, _ in [s for s in order if s[2]][:5]:
            fit = [s for s in order if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit[:3])]
    return sorted(out)


def rows(rng, n=700, d=6):
    centres = rng.normal(size=(4, d))
    made = [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=d) / 2).astype("f4")], 3 if i % 3 else i % 5) for i in range(n)]
    made += [(50, made[50][1], made[50][2])] * 3 + [(61, made[61][1], made[61][2])] * 4  # repeated anchor and candidate
    made += [(1000 + k, made[100][1], k % 2) for k in range(9)]  # copies of an anchor: ties on the score
    made += [(None, [1.0] * d, 1), (2000, None, 1), (2050, [1.0] * d, None), (2100, [], 1), (2150, [1.0] * (d - 1) + [None], 1)]
    made += [(2200, [1.0] * (d - 1) + [float("inf")], 1), (2250, [0.0] * d, 2), (2251, [0.0] * d, 2), (2300, [1.0] * d, 99), (-50, [0.5] * d, 1)]
    return made


def frame(spark, given):
    df = spark.createDataFrame(given, SCHEMA)
    for name in ("rank", "tile", "found", "score", "anchor_id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(6)


def test_searches_find_what_full_scoring_finds_and_stop_early():
    rng, early = np.random.default_rng(5), 0
    for round_ in range(60):
        x = rng.integers(-4, 5, size=(300, 3)) if round_ % 2 else np.floor(64 * rng.normal(size=(300, 3))).astype(np.int64)
        ids = rng.permutation(300)
        lists = negatives.Lists(x)
        anchor = rng.integers(-4, 5, size=3) * (round_ > 3)
        top = negatives.Top(5)
        early += lists.search(anchor, lambda at, s: top.add(s, ids[at]), top.closed) < 300
        want = negatives.best(x @ anchor, ids, 5)
        assert (top.scores == want[0]).all() and (top.ids == want[1]).all()
    assert early > 20


def test_threshold_bounds_every_row_not_met():
    rng = np.random.default_rng(6)
    x, anchor = rng.integers(-50, 50, size=(200, 4)), np.array([3, -2, 0, 1])
    met, least = set(), []

    def take(at, scores):
        met.update(at.tolist())

    def done(threshold):
        left = [int(x[i] @ anchor) for i in range(200) if i not in met]
        least.append(threshold)
        assert all(s <= threshold for s in left)
        return False

    negatives.Lists(x).search(anchor, take, done)
    assert len(met) == 200 and least == sorted(least, reverse=True)


@pytest.mark.parametrize("slab", [negatives.SLAB, 4])
def test_results_match_brute_force(spark, slab):
    given = rows(np.random.default_rng(7))
    got = sorted(tuple(r) for r in negatives.mine_negatives(frame(spark, given), slab).collect())
    assert got == brute(given) and len(got) > 20


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    given = [(i * 10, [float(x) for x in (rng.normal(size=4) * 2**17).astype("f4")], i % 3) for i in range(60)]
    assert sorted(tuple(r) for r in negatives.mine_negatives(frame(spark, given)).collect()) == brute(given)


def test_no_rows_and_lonely_anchors(spark):
    for given in ([], [(1, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 2)], [(50, None, 1)]):
        got = negatives.mine_negatives(spark.createDataFrame(given, SCHEMA))
        assert got.columns == list(negatives.RESULT) and got.count() == 0


def test_vectors_of_other_lengths_are_refused(spark):
    with pytest.raises(Exception, match="length"):
        negatives.mine_negatives(spark.createDataFrame([(50, [1.0, 2.0], 1), (51, [1.0], 1)], SCHEMA)).count()

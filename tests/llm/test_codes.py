"""Vector codes: the active-entry rule against full scans, whole results against brute force, odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from histmetrics.llm import codes

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, entries):
    """Plain Lloyd in Python integers: (vec_id, code, error, label_error, digest) of every kept row."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    w = len(first[0][1]) // 4
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    books = [[v[p * w : (p + 1) * w] for _, v in first] for p in range(4)]

    def assign():
        out = []
        for parts in cut:
            found = []
            for p, part in enumerate(parts):
                d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
                found.append((min(d), d.index(min(d))))
            out.append(found)
        return out

    for _ in range(4):
        near = assign()
        for p in range(4):
            for e in range(len(first)):
                mine = [cut[k][p] for k in range(len(kept)) if near[k][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    near = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in found) for found in near]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return sorted(
        ((i, "".join(f"{e:02x}" for _, e in found), error, by_label[label], digest)
         for (i, _, label), found, error in zip(kept, near, errors)),
        key=repr,
    )


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("code", "error", "part", "kind", "ints", "n"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(5)


def odd(rng):
    """Copies, ties, nulls, infinities, null ids and labels, a label that holds a third of the rows."""
    points = rng.normal(size=(12, 8)).astype("f4") / 4
    rows = [(i, [float(x) for x in (points[i % 12] + (i % 7 == 3) * rng.normal(size=8) / 64)], 0 if i % 3 else i % 5) for i in range(90)]
    rows += [(5, rows[5][1], 0), (5, rows[5][1], 0), (6, rows[7][1], None), (None, rows[1][1], None), (200, None, 1)]
    rows += [(201, [1.0] * 7 + [None], 1), (202, [1.0] * 7 + [float("inf")], 1), (203, [float("nan")] * 8, 1), (-4, [-0.0] * 8, 1)]
    return rows


def test_active_entry_rule_equals_full_scans():
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = rng.integers(-3, 4, size=(200, 3))
        entries = rng.integers(-3, 4, size=(12, 3))
        code, stored = codes.nearest(x, entries)
        moved = rng.random(12) < 0.4
        later = entries.copy()
        later[moved] += rng.integers(-1, 2, size=(moved.sum(), 3))
        moved = (later != entries).any(axis=1)
        got, want = codes.reassign(x, later, moved, code, stored), codes.nearest(x, later)
        assert all((g == w).all() for g, w in zip(got, want))


def test_distances_are_exact_for_large_components():
    x = np.array([[2**26, -(2**26)]]), np.array([[-(2**26) + 1, 2**26]])
    want = sum((int(a) - int(b)) ** 2 for a, b in zip(x[0][0], x[1][0]))
    assert codes.distances(*x)[0, 0] == want


@pytest.mark.parametrize("entries", [256, 9])
def test_results_match_brute_force(spark, monkeypatch, entries):
    rows = odd(np.random.default_rng(2))
    monkeypatch.setattr(codes, "ENTRIES", entries)
    got = sorted((tuple(r) for r in codes.compress_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows, entries)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 8, 1)]):
        got = codes.compress_vectors(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_vectors_without_a_code_are_refused(spark):
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [1.0] * 8, 1), (2, [2.0**18] * 8, 1)]):
        with pytest.raises(Exception, match="length|large"):
            codes.compress_vectors(spark.createDataFrame(rows, SCHEMA)).count()

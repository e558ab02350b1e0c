import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.operators import measures


def summary(values):
    """The same five numbers by brute force."""
    ordered = sorted(values)
    return (
        len(ordered),
        sum(ordered) / len(ordered),
        float(statistics.median(ordered)),
        ordered[max(0, math.ceil(0.95 * len(ordered)) - 1)],
        ordered[-1],
    )


def frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, value double")


def test_small_groups(spark):
    groups = {"one": [7], "four": [1, 2, 3, 10], "equal": [5, 5, 5], "negative": [-3, -1, 0, 2.5], "zero": [0, 0]}
    got = {r["k"]: tuple(r)[1:] for r in measures.distribution(frame(spark, groups), ["k"]).collect()}
    assert got == {k: summary([float(v) for v in vs]) for k, vs in groups.items()}
    assert got["four"] == (4, 4.0, 2.5, 10.0, 10.0)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_with_a_hot_group(spark, seed):
    rnd = random.Random(seed)
    groups = {f"g{i}": [rnd.randint(0, 20) for _ in range(rnd.randint(1, 60))] for i in range(40)}
    groups["hot"] = [rnd.choice([3, rnd.randint(-10**6, 10**6) / 8]) for _ in range(4000)]
    got = {r["k"]: tuple(r)[1:] for r in measures.distribution(frame(spark, groups), ["k"]).collect()}
    want = {k: summary([float(v) for v in vs]) for k, vs in groups.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][2:] == want[k][2:], k
        assert got[k][1] == pytest.approx(want[k][1])


def test_nearest_rank_for_every_count(spark):
    groups = {str(n): list(range(1, n + 1)) for n in range(1, 130)}
    got = {r["k"]: tuple(r)[1:] for r in measures.distribution(frame(spark, groups), ["k"]).collect()}
    assert got == {k: summary([float(v) for v in vs]) for k, vs in groups.items()}


def test_null_values_are_no_values_and_empty_entities_get_zeros(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, value double")
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    out = measures.with_empty(measures.distribution(df, ["k"]), entities, ["k"])
    assert rows(out) == [("a", 1, 1.0, 1.0, 1.0, 1.0), ("b", 0, 0.0, 0.0, 0.0, 0.0), ("c", 0, 0.0, 0.0, 0.0, 0.0)]


def test_module_values_come_from_raw_values(spark):
    rows = [("v", "m", "a.py", "jones", float(v)) for v in (1, 1, 1, 1)] + [("v", "m", "b.py", "jones", 9.0)]
    obs = spark.createDataFrame(rows, "version_id string, module string, relative_path string, family string, value double")
    only = measures.module_distributions(obs).first()
    assert (only["count"], only["mean"], only["median"], only["p95"]) == (5, 2.6, 1.0, 9.0)
    assert measures.file_distributions(obs).count() == 2


@pytest.mark.parametrize("n", [400, 4000])
def test_windows_do_not_grow_with_a_key(spark, monkeypatch, n):
    """Ten times the values under one key, all in a narrow band but for two: places are narrowed until they are small."""
    monkeypatch.setattr(measures, "PLACE_VALUES", 60)
    largest, located = [], measures._located

    def watch(sums, targets, group, place):
        largest.append(sums.groupBy(*group).count().agg(F.max("count")).first()[0])
        return located(sums, targets, group, place)

    monkeypatch.setattr(measures, "_located", watch)
    rng = random.Random(n)
    values = [1000 + rng.randrange(n) * 2.0**-30 for _ in range(n)] + [1e9, -7.0]
    df = spark.createDataFrame([("hot", v) for v in values] + [("small", float(v)) for v in range(5)], "k string, value double")
    got = {r["k"]: r for r in measures.distribution(df, ["k"]).collect()}
    values.sort()
    m = len(values)
    hot = got["hot"]
    assert (hot["count"], hot["max"]) == (m, 1e9)
    assert hot["median"] == (values[(m + 1) // 2 - 1] + values[m // 2]) / 2 and hot["p95"] == values[math.ceil(0.95 * m) - 1]
    assert (got["small"]["median"], got["small"]["p95"]) == (2.0, 4.0)
    assert max(largest) <= 64  # ranges of a place, or values of the last one


def test_assembled_files_keep_unmeasured_ones(spark):
    files = spark.createDataFrame(
        [("v", "m", "a.py", 3), ("v", "m", "b.js", 5), ("v", "m", "notes.txt", 9)],
        "version_id string, module string, relative_path string, lines long",
    )
    obs = spark.createDataFrame(
        [("v", "m", "a.py", "cyclomatic", 1.0), ("v", "m", "a.py", "cyclomatic", 3.0), ("v", "m", "a.py", "jones", 4.0)],
        "version_id string, module string, relative_path string, family string, value double",
    )
    out = measures.assemble_file_metrics(measures.measure_files(files), measures.file_distributions(obs))
    got = {r["relative_path"]: r for r in out.collect()}
    assert set(got) == {"a.py", "b.js"}
    assert got["a.py"]["line_counts"] == {"lines": 3, "function_count": 2, "jones_line_count": 1}
    assert got["a.py"]["metrics"]["cyclomatic_mean"] == 2.0
    assert got["b.js"]["metrics"] == {} and got["b.js"]["distributions"] == {}
    assert got["b.js"]["line_counts"] == {"lines": 5, "function_count": 0, "jones_line_count": 0}


def test_assembled_modules_have_zero_distributions_without_values(spark):
    files = spark.createDataFrame(
        [("v", "m", "a.css", "css_lines", 3), ("v", "m", "b.css", "css_lines", 4)],
        "version_id string, module string, relative_path string, line_category_id string, lines long",
    )
    per_file = measures.line_counts(files, keys=measures.ENTITY_FILE)
    counts = measures.line_count_map(measures.roll_up_line_counts(per_file))
    none = spark.createDataFrame([], "version_id string, module string, family string, count long, mean double, median double, p95 double, max double")
    row = measures.assemble_module_aggregates(counts, none, "file_count").first()
    assert row["total_lines"] == 7 and row["line_counts"]["css_lines"] == 7 and row["line_counts"]["js_lines"] == 0
    assert row["metrics"]["python_file_count"] == 2.0 and row["metrics"]["cognitive_p95"] == 0.0
    assert row["distributions"]["jones"]["count"] == 0 and row["manifest_depends"] == []


def test_file_counts_keep_broken_files(spark, rows):
    files = spark.createDataFrame(
        [("v", "m", p, e) for p, e in [("a.py", None), ("b.py", "bad"), ("__manifest__.py", None), ("tests/c.py", "bad"), ("test_d.py", None), ("e.js", None)]],
        "version_id string, module string, relative_path string, error string",
    )
    assert rows(measures.file_counts(files)) == [("v", "m", 2, 1)]


def test_run_outcome(spark, rows):
    flags = spark.createDataFrame(
        [("r", True, 0), ("r", True, 3), ("r", False, 1), ("r", False, 0)], "run_id string, has_metrics boolean, failures int"
    )
    assert rows(measures.run_outcome(flags)) == [("r", 3, 1, 4)]


def test_ranks_of_a_narrow_band_and_nan(spark, rows):
    band = spark.range(5000).selectExpr("'k' AS key", "1000 + pmod(id * 7919, 5000) / 1000.0D AS value")
    got = measures.distribution(band, ["key"]).first()
    assert (got["count"], got["median"], got["p95"], got["max"]) == (5000, 1002.4995, 1004.749, 1004.999)
    odd = spark.sql("SELECT 'k' AS key, explode(array(1D, 2D, 3D, double('NaN'))) AS value")
    got = measures.distribution(odd, ["key"]).first()
    assert got["median"] == 2.5 and got["p95"] != got["p95"] and got["max"] != got["max"]


def test_measured_files_equal_assembled_ones(spark):
    told = [("v", "m", "a.py", "python_lines", 3, 1.0, 5.0, None), ("v", "m", "a.py", "js_lines", 4, 9.0, None, None),
            ("v", "m", "a.py", "python_lines", 1, float("nan"), 2.0, None), ("v", "m", "b.py", None, 2, None, None, None),
            ("v", None, "c.py", "xml_lines", 7, 1.0, 1.0, 1.0)]
    schema = "version_id string, module string, relative_path string, line_category_id string, lines long, cyclomatic double, cognitive double, jones double"
    found = spark.createDataFrame(told, schema)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in measures.FAMILIES])).alias("o")
    long = found.select("version_id", "module", "relative_path", each).select("version_id", "module", "relative_path", "o.*")
    sums = found.groupBy("version_id", "module", "relative_path").agg(
        F.min("line_category_id").alias("line_category_id"), F.sum("lines").alias("lines")
    )
    want = measures.assemble_file_metrics(sums, measures.file_distributions(long))
    got = measures.measured_files(found)
    assert got.columns == want.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(str(r.asDict(True)) for r in got.collect()) == sorted(str(r.asDict(True)) for r in want.collect())


def test_lines_are_joined_once_for_module_rows(spark, monkeypatch):
    joined, lines = [], frames.lines
    monkeypatch.setattr(frames, "lines", lambda *a: joined.append(lines(*a)) or joined[-1])
    found = frames.module_aggregate(spark, "/root/testdata/sf0.001")
    assert len(joined) == 1
    assert not [path for path in found.inputFiles() if "lineitem" in path or "orders" in path]
    assert {r["version_id"] for r in found.collect()} == {r["version_id"] for r in frames.versions(spark, "/root/testdata/sf0.001").collect()}

import pytest
from pyspark.sql import functions as F

from histmetrics import schemas
from histmetrics.session import folder_names, scratch_path
from histmetrics.operators import ordering
from histmetrics.sources import batches, logs, sinks, store, tables, trees
from histmetrics.streaming import incremental


def test_commit_records(spark):
    good = "\x1f".join(["ab12", "An Author", "a@b.c", "10", "20", "first line"])
    data = [
        good, "", "  \n", "ab\x1fx", good.replace("ab12", "zz"), good.replace("10", "ten"), good.replace("20", "-2"),
        good.replace("a@b.c", "a b"), "\x1f".join(["ab12", "n", "a@b.c", "1", "2", ""]),
    ]
    out = logs.parse_commit_log(spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, value string")).orderBy("i").collect()
    assert [r["failure_reason"] for r in out] == [
        None, "empty_output", "empty_output", "wrong_field_count", "invalid_hash", "invalid_epoch", "invalid_epoch", "invalid_email", "wrong_field_count",
    ]
    assert (out[0]["version_id"], out[0]["summary"], out[0]["authored_at"].second) == ("ab12", "first line", 10)
    assert out[4]["version_id"] is None


def test_plan_keeps_positions_of_the_full_list(spark, rows):
    data = [("a", ["p"], 0), ("  ", ["p"], 1), ("m", ["p", "q"], 2), ("b", [], 3), ("c", ["b"], 4)]
    planned = logs.plan_versions(spark.createDataFrame(data, "version_id string, parents array<string>, seq long"))
    assert rows(planned) == [("a", 0), ("b", 1), ("c", 2)]
    stored = spark.createDataFrame([("a",), ("b",)], "version_id string")
    assert rows(logs.pending_versions(planned, stored)) == [("c", 2)]


def test_short_log(spark, rows):
    data = [(0, ""), (1, "aa 10 first one"), (2, "bb 11 x"), (3, " "), (4, "cc 12 y")]
    lines = spark.createDataFrame(data, "seq long, value string")
    assert rows(logs.plan_short_log(lines)) == [("aa", 0), ("bb", 1)]
    assert rows(logs.plan_short_log(lines, 1)) == [("aa", 0)]
    gaps = spark.createDataFrame([(10 * i, f"c{i:02d} {i} s") for i in range(30)], "seq long, value string")
    assert rows(logs.plan_short_log(gaps)) == [(f"c{i:02d}", i) for i in range(30)]
    assert logs.plan_short_log(gaps, 12).count() == 12


def version_rows(spark, *orders):
    rows = [(f"v{o}", o, "n", "e", None, None, None) for o in orders]
    return spark.createDataFrame(rows, schemas.VERSION)


def edge_rows(spark, *triples):
    rows = [(f"v{o}", s, t, n, {"xml_ref": n}, n, {"view": n}) for o, s, t, n in triples]
    return spark.createDataFrame(rows, schemas.COUPLING_EDGE)


def failure_rows(spark, *orders):
    return spark.createDataFrame([("r", f"v{o}", None, "broken") for o in orders], schemas.FAILURE)


def test_upsert_replaces_by_key_and_keeps_other_buckets(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    versions = version_rows(spark, 0, 1, 2, 3)
    kept.upsert_versions(versions, {"coupling_edge": edge_rows(spark, (0, "a", "b", 1), (1, "a", "b", 1), (3, "a", "b", 1))}, failure_rows(spark))
    kept.upsert("coupling_edge", edge_rows(spark, (1, "a", "b", 7), (0, "c", "b", 2)), versions)
    assert rows(kept.read("coupling_edge"), "version_id", "source", "score") == [
        ("v0", "a", 1), ("v0", "c", 2), ("v1", "a", 7), ("v3", "a", 1)
    ]


def test_upsert_reads_touched_buckets_only(spark):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    versions = version_rows(spark, *range(20))
    kept.upsert_versions(versions, {"coupling_edge": edge_rows(spark, *[(o, "a", "b", 1) for o in range(20)])}, failure_rows(spark))
    one = kept.stage(versions.where("version_order = 5"), {"coupling_edge": edge_rows(spark, (5, "a", "b", 9))}, None)
    merged = kept.merged("coupling_edge", kept.snapshot().of("coupling_edge"), [one], [2])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(version_bucket") == plan.count("FileScan") > 1 and "(version_bucket" in plan
    assert {p.split("version_bucket=")[1].split("/")[0] for p in merged.inputFiles()} == {"2"}
    kept.commit([one])
    assert sorted((r["version_id"], r["score"]) for r in kept.read("coupling_edge").where("score > 1").collect()) == [("v5", 9)]


def test_readers_see_whole_snapshots(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    versions = version_rows(spark, 0, 1, 2)
    kept.upsert_versions(versions, {"coupling_edge": edge_rows(spark, *[(o, "a", "b", 1) for o in range(3)])}, failure_rows(spark))
    before, reader = kept.pinned(), store.HistoryStore(spark, kept.root, 2)
    staged = kept.stage(versions, {"coupling_edge": edge_rows(spark, (0, "a", "b", 5))}, failure_rows(spark, 2))
    assert reader.read("coupling_edge").where("score = 5").count() == 0 and reader.read("failure").count() == 0
    kept.commit([staged])
    assert rows(reader.read("coupling_edge"), "version_id", "score") == [("v0", 5), ("v1", 1), ("v2", 1)]
    assert reader.read("failure").count() == 1
    assert before.read("coupling_edge").where("score = 5").count() == 0 and before.read("failure").count() == 0
    kept.vacuum()
    assert rows(reader.read("coupling_edge"), "version_id", "score") == [("v0", 5), ("v1", 1), ("v2", 1)]
    assert folder_names(spark, f"{kept.root}/snapshot") == [f"number={kept.snapshot().number}"]


def test_a_write_that_fails_leaves_nothing(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    versions = version_rows(spark, 0, 1)
    kept.upsert_versions(versions, {"coupling_edge": edge_rows(spark, (0, "a", "b", 1))}, failure_rows(spark))
    lost = versions.select("version_id", F.raise_error(F.lit("lost")).cast("string").alias("module"))
    with pytest.raises(Exception, match="lost"):
        kept.upsert_versions(versions, {"coupling_edge": edge_rows(spark, (0, "a", "b", 2)), "module_aggregate": lost}, failure_rows(spark, 1))
    assert rows(kept.read("coupling_edge"), "version_id", "score") == [("v0", 1)]
    assert kept.read("failure").count() == 0 and len(folder_names(spark, kept.path("coupling_edge"))) == 1


def test_failures_come_once_per_batch_and_again_per_retry(spark):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    for number in (0, 0, 1, 0, 1):
        kept.upsert_versions(version_rows(spark, number), {}, failure_rows(spark, number), batch=("stream", number))
    assert kept.read("failure").count() == 2 and kept.read("version").count() == 0
    kept.upsert_versions(version_rows(spark, 0), {}, failure_rows(spark, 0))
    assert kept.read("failure").count() == 3


def test_versions_fail_alone_and_runs_are_tallied(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)

    def measure(wanted):
        score = F.when(F.col("version_id") == "v2", F.raise_error(F.lit("bad tree")).cast("long")).otherwise(F.lit(1))
        return {"coupling_edge": wanted.select("version_id", F.lit("a").alias("source"), F.lit("b").alias("target"), score.alias("score"))}, failure_rows(spark)

    unreadable = spark.createDataFrame([("v0", "no commit")], "version_id string, error_text string")
    incremental.analyze_pending(kept, version_rows(spark, 0, 1, 2, 3), measure, run_id="r", unreadable=unreadable)
    assert rows(kept.read("version"), "version_id") == [("v1",), ("v3",)]
    assert [(r[0], "bad tree" in r[1], r[2]) for r in rows(kept.read("failure"), "version_id", "error_text", "run_id")] == [
        ("v0", False, "r"), ("v2", True, "r")
    ]
    assert rows(kept.runs(), "status", "versions_total", "versions_succeeded", "versions_failed") == [("completed", 4, 2, 2)]
    with pytest.raises(Exception, match="bad tree"):
        incremental.analyze_pending(kept, version_rows(spark, 2), measure, run_id="s", fail_fast=True)
    assert rows(kept.runs(), "run_id", "status") == [("r", "completed"), ("s", "failed")]
    incremental.analyze_pending(kept, version_rows(spark, 1), measure, run_id="t", rebuild=True)
    assert rows(kept.runs(), "run_id", "status") == [("t", "completed")] and kept.read("failure").count() == 0


def test_failure_only_versions_are_not_recorded(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"))
    kept.upsert_versions(version_rows(spark, 0, 1, 2), {"coupling_edge": edge_rows(spark, (0, "a", "b", 1))}, failure_rows(spark, 0, 1))
    assert rows(kept.read("version"), "version_id") == [("v0",), ("v2",)]
    assert kept.read("failure").count() == 2


def test_rebuild_and_incremental(spark, rows):
    kept = store.HistoryStore(spark, scratch_path(spark, "t"), versions_per_bucket=2)
    seen = []

    def measure(wanted):
        seen.append(sorted(r[0] for r in wanted.select("version_id").collect()))
        edges = wanted.select("version_id", F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit(1).alias("score"))
        return {"coupling_edge": edges}, failure_rows(spark)

    incremental.analyze_pending(kept, version_rows(spark, 0, 1), measure)
    incremental.analyze_pending(kept, version_rows(spark, 0, 1, 2), measure)
    assert seen == [["v0", "v1"], ["v2"]]
    assert kept.read("version").count() == 3
    incremental.analyze_pending(kept, version_rows(spark, 1), measure, rebuild=True)
    assert rows(kept.read("version"), "version_id") == [("v1",)]
    assert kept.read("coupling_edge").count() == 1


def test_schema_checks(spark):
    root = scratch_path(spark, "t")
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, root, "version")
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, root, "nothing")
    with pytest.raises(tables.IncompatibleSchema, match="3.*4"):
        tables.assert_compatible(3)
    old = spark.createDataFrame([("v", "a", "b", 1)], "version_id string, source string, target string, score int")
    old.write.parquet(f"{root}/coupling_edge")
    assert tables.read_table(spark, root, "coupling_edge").first()["breakdown"] is None


def test_run_ledger_keeps_the_last_entry(spark, rows):
    entries = spark.sql(
        "SELECT 'r' AS run_id, 'running' AS status, timestamp'2024-01-01 00:00:00' AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at"
        " UNION ALL SELECT 'r', 'completed', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:05:00'"
    )
    assert rows(store.latest_runs(entries), "run_id", "status") == [("r", "completed")]


def test_batches_round_trip(spark, rows):
    path = scratch_path(spark, "t")
    versions = version_rows(spark, 0, 1)
    edges = edge_rows(spark, *[(0, f"s{i}", "t", 1) for i in range(40)])
    given = {"edges": edges, "failures": failure_rows(spark, 0)}
    assert batches.batch_lines(versions, given).count() == 42  # 40 sources, a failure, a version without rows
    batches.write_batches_jsonl(versions, given, path)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    read = batches.explode_batches(batches.read_batches_jsonl(spark, path))
    assert rows(read["version"], "version_id") == [("v0",), ("v1",)]
    assert rows(read["coupling_edge"], "version_id", "source") == rows(edges, "version_id", "source")
    assert sorted(r["error_text"] for r in read["failure"].collect()) == ["broken", "unreadable batch: not json"]


def test_file_tree(spark, tmp_path):
    target = tmp_path / "v1" / "sale" / "models"
    target.mkdir(parents=True)
    (target / "a.py").write_bytes(b"x = 1\r\ny = 2")
    (target / "b.py").write_bytes(b"\xff\xfe\n")
    got = {r["relative_path"]: r for r in trees.read_file_tree(spark, str(tmp_path)).collect()}
    assert (got["models/a.py"]["version_id"], got["models/a.py"]["module"]) == ("v1", "sale")
    assert got["models/a.py"]["content"] == "x = 1\r\ny = 2" and got["models/b.py"]["content"] is None
    lines = {r["relative_path"]: r["lines"] for r in trees.with_lines(trees.read_file_tree(spark, str(tmp_path), "*.py")).collect()}
    assert lines == {"models/a.py": 2, "models/b.py": 1}


def test_result_formats(spark):
    df = spark.sql("SELECT 1 AS a, map('k', 2) AS m")
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, fmt)
        sinks.write_result(df, path, fmt)
        assert spark.read.option("header", "true").format(fmt).load(path).count() == 1
    with pytest.raises(ValueError):
        sinks.write_result(df, "x", "xlsx")
    path = scratch_path(spark, "t")
    sinks.write_result(df, path, "text")
    assert spark.read.text(path).count() == df.count()


def test_lines_of_large_modules_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(batches, "LINE_ROWS", 20)
    edges = edge_rows(spark, *[(0, "hot", f"t{i}", 1) for i in range(200)], (0, "cold", "t", 1), (1, "hot", "t", 1))
    lines = batches.batch_lines(version_rows(spark, 0, 1), {"edges": edges}).select(F.size("edges").alias("n")).collect()
    assert sum(r["n"] for r in lines) == 202 and max(r["n"] for r in lines) < 40 and len(lines) >= 10


def test_positions_of_far_and_equal_keys(spark):
    keys = [(10**k, f"a{k}") for k in range(12)] + [(7, f"b{k}") for k in range(300)]
    placed = ordering.global_position(spark.createDataFrame(keys, "seq long, name string").repartition(5), ["seq", "name"])
    assert [r["position"] for r in placed.orderBy("seq", "name").collect()] == list(range(312))


def test_raw_bytes_are_kept_only_where_there_is_no_text(spark, tmp_path):
    for version in ("v1", "v2"):
        (tmp_path / version / "m").mkdir(parents=True)
        (tmp_path / version / "m" / "a.py").write_bytes(b"x")
        (tmp_path / version / "m" / "b.py").write_bytes(b"\xff")
    got = {(r["version_id"], r["relative_path"]): (r["content"], r["raw"]) for r in trees.read_file_tree(spark, str(tmp_path)).collect()}
    assert got == {(v, p): x for v in ("v1", "v2") for p, x in (("a.py", ("x", None)), ("b.py", (None, bytearray(b"\xff"))))}
    assert spark.conf.get(trees.LISTING) != "0"

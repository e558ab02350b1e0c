"""Logs, batches and the store: written and read back, or parsed."""

from pyspark.sql import functions as F

from histmetrics import schemas
from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.extract.complexity import apply_error_policy
from histmetrics.functions.values import project_id
from histmetrics.session import cut_lineage, scratch_path
from histmetrics.sources import batches, logs, sinks, store, tables, trees
from histmetrics.streaming import incremental


def plain_versions(df):
    return df.select("version_id", "version_order", "summary")


def first_half(df, spark, sf):
    """Rows of the versions up to 1998-Q2."""
    early = frames.versions(spark, sf).where("version_order <= 7994").select("version_id")
    return df.join(early, "version_id", "left_semi")


def doubled(df):
    """Edge rows as a later run would find them: every score doubled."""
    return df.withColumn("score", F.col("score") * 2)


@query("read_table", "SELECT version_id, version_order, summary FROM x_version")
def _(spark, sf):
    root = scratch_path(spark, "read")
    frames.versions(spark, sf).write.parquet(f"{root}/version")
    return plain_versions(tables.read_table(spark, root, "version"))


@query(
    "read_file_tree",
    r"""SELECT version_id, module, CAST(sum(length(u) - length(replace(u, chr(10), ''))) AS BIGINT) AS lines FROM
       (SELECT version_id, module, regexp_replace(content || chr(10), '\r\n?', chr(10), 'g') AS u FROM x_doc) GROUP BY ALL""",
)
def _(spark, sf):
    root = scratch_path(spark, "tree")
    docs = frames.document_files(spark, sf).select("version_id", "module", "content")
    # A tree of text files with some hundred documents each, one folder per version and module.
    (
        docs.hint("rebalance", "version_id", "module")
        .write.option("maxRecordsPerFile", 500).partitionBy("version_id", "module").text(root)
    )
    counted = trees.with_lines(trees.read_file_tree(spark, root, "part-*"))
    return counted.groupBy(
        F.replace("version_id", F.lit("version_id=")).alias("version_id"),
        F.replace("module", F.lit("module=")).alias("module"),
    ).agg(F.sum("lines").alias("lines"))


@query(
    "file_tree_paths",
    r"""SELECT version_id, 'lang=' || lang || '/source=' || source || '/part' AS relative_path, lang <> 'en' AS decoded, lang = 'en' AS raw
       FROM (SELECT 'v' || CAST(doc_id % 3 AS VARCHAR) AS version_id, * FROM documents WHERE text IS NOT NULL) GROUP BY ALL""",
)
def _(spark, sf):
    """Paths below the module folder; the files of one language are compressed, so their bytes are no UTF-8."""
    root = scratch_path(spark, "tree")
    docs = frames.table(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"), F.lit("all").alias("module"), "lang", "source", "text"
    )
    paths = ("version", "module", "lang", "source")
    english = F.col("lang") == "en"
    for rows, codec in ((docs.where(~english), "none"), (docs.where(english), "gzip")):
        rows.repartition(*paths).write.mode("append").option("compression", codec).partitionBy(*paths).text(root)
    found = trees.read_file_tree(spark, root, "part-*")
    return found.groupBy(
        F.replace("version_id", F.lit("version=")).alias("version_id"), F.regexp_replace("relative_path", "/part-[^/]*$", "/part").alias("relative_path")
    ).agg(F.bool_and(F.col("content").isNotNull()).alias("decoded"), F.bool_and(F.col("raw").isNotNull()).alias("raw"))


@query(
    "parse_commit_log",
    r"""SELECT o_orderkey AS seq, CASE WHEN r IS NULL THEN lower(hex(o_orderkey)) END AS version_id,
       CASE WHEN r IS NULL THEN c_name END AS author_name, CASE WHEN r IS NULL THEN c_name || '@' || lower(c_mktsegment) END AS author_email,
       CASE WHEN r IS NULL THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS authored,
       CASE WHEN r IS NULL THEN o_orderpriority END AS summary, r AS failure_reason FROM
       (SELECT *, CASE WHEN o_orderkey % 29 = 0 THEN 'empty_output' WHEN o_orderkey % 23 = 0 THEN 'wrong_field_count'
        WHEN o_orderkey % 17 = 0 THEN 'invalid_hash' WHEN o_orderkey % 13 = 0 THEN 'invalid_epoch'
        WHEN o_orderkey % 19 = 0 THEN 'invalid_email' END AS r FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def _(spark, sf):
    parsed = logs.parse_commit_log(frames.log_lines(spark, sf))
    return parsed.select(
        "seq", "version_id", "author_name", "author_email",
        F.date_format("authored_at", "yyyy-MM-dd HH:mm:ss").alias("authored"), "summary", "failure_reason",
    )


def _commits(spark, sf):
    key = F.col("o_orderkey")
    parents = F.when(key % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    ident = F.when(key % 31 == 0, F.lit("  ")).otherwise(F.lower(F.hex(key)))
    return frames.table(spark, sf, "orders").select(ident.alias("version_id"), parents.alias("parents"), key.alias("seq"))


@query(
    "plan_versions",
    """SELECT lower(hex(o_orderkey)) AS version_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS version_order
       FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 31 <> 0""",
)
def _(spark, sf):
    return logs.plan_versions(_commits(spark, sf))


@query(
    "pending_versions",
    """SELECT version_id, version_order FROM (SELECT o_orderkey, lower(hex(o_orderkey)) AS version_id,
       row_number() OVER (ORDER BY o_orderkey) - 1 AS version_order FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 31 <> 0)
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""",
)
def _(spark, sf):
    planned = logs.plan_versions(_commits(spark, sf))
    stored = frames.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.lower(F.hex("l_orderkey")).alias("version_id"))
    return logs.pending_versions(planned, stored)


@query(
    "plan_short_log",
    """SELECT lower(hex(o_orderkey)) AS version_id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS version_order
       FROM orders WHERE o_orderkey * 10 < (SELECT min(o_orderkey) * 10 FROM orders WHERE o_orderkey % 100 = 70)
       ORDER BY o_orderkey LIMIT 100""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    line = F.concat_ws(" ", F.lower(F.hex(key)), F.unix_timestamp("o_orderdate").cast("string"), F.col("o_orderpriority"))
    rows = frames.table(spark, sf, "orders").select((key * 10).alias("seq"), F.when(key % 100 == 70, " ").otherwise(line).alias("value"))
    return logs.plan_short_log(rows, 100)


def _batch_tables(spark, sf):
    edges = frames.edges(spark, sf)
    files = frames.file_lines(spark, sf).select(
        "version_id", "module", "relative_path", "line_category_id",
        F.create_map().cast("map<string,double>").alias("metrics"),
        F.create_map(F.lit("lines"), F.col("lines")).alias("line_counts"),
        F.create_map().cast(schemas.DISTRIBUTIONS).alias("distributions"),
    )
    return {"files": files, "edges": edges}


@query(
    "read_batches_jsonl",
    """SELECT 'file' AS part, version_id, module AS a, relative_path AS b, CAST(sum(lines) AS BIGINT) AS n FROM x_line GROUP BY ALL
       UNION ALL SELECT 'edge', version_id, source, target, score FROM x_edge
       UNION ALL SELECT 'version', version_id, summary, NULL, version_order FROM x_version""",
)
def _(spark, sf):
    path = scratch_path(spark, "batches")
    batches.write_batches_jsonl(frames.versions(spark, sf), _batch_tables(spark, sf), path)
    read = batches.explode_batches(batches.read_batches_jsonl(spark, path))
    none = F.lit(None).cast("string")
    n = F.col("line_counts")["lines"].alias("n")
    files = read["file_metric"].select(F.lit("file").alias("part"), "version_id", F.col("module").alias("a"), F.col("relative_path").alias("b"), n)
    edges = read["coupling_edge"].select(
        F.lit("edge").alias("part"), "version_id", F.col("source").alias("a"), F.col("target").alias("b"), F.col("score").cast("long").alias("n")
    )
    found = read["version"].select(
        F.lit("version").alias("part"), "version_id", F.col("summary").alias("a"), none.alias("b"), F.col("version_order").cast("long").alias("n")
    )
    return files.unionByName(edges).unionByName(found)


@query(
    "batch_lines",
    """SELECT version_id, m + s AS lines, f AS files, e AS edges FROM
       (SELECT version_id, count(DISTINCT module) AS m, count(DISTINCT (module, relative_path)) AS f FROM x_line GROUP BY ALL)
       JOIN (SELECT version_id, count(DISTINCT source) AS s, count(*) AS e FROM x_edge GROUP BY ALL) USING (version_id)""",
)
def _(spark, sf):
    rows = batches.batch_lines(frames.versions(spark, sf), _batch_tables(spark, sf))
    return rows.groupBy(F.col("commit.version_id").alias("version_id")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.size("files")).cast("long").alias("files"),
        F.sum(F.size("edges")).cast("long").alias("edges"),
    )


@query(
    "upsert_rows",
    """SELECT version_id, source, target, CASE WHEN version_order > 7994 OR source < 'NATION_2' THEN score * 2 ELSE score END AS score
       FROM x_edge JOIN x_version USING (version_id)""",
)
def _(spark, sf):
    edges = frames.edges(spark, sf)
    early = first_half(edges, spark, sf)
    late = edges.join(early.select("version_id").distinct(), "version_id", "left_anti")
    incoming = doubled(late.unionByName(early.where(F.col("source") < "NATION_2")))
    rows = store.upsert_rows(early, incoming, schemas.KEYS["coupling_edge"])
    return rows.select("version_id", "source", "target", F.col("score").cast("long").alias("score"))


@query(
    "upsert_versions",
    """SELECT e.version_id, source, target, CASE WHEN source < 'NATION_2' THEN score * 2 ELSE score END AS score,
       version_order, e.version_id NOT LIKE '%-Q4' AS recorded FROM x_edge e JOIN x_version USING (version_id)
       WHERE e.version_id NOT LIKE '%-Q4'""",
)
def _(spark, sf):
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=4)
    versions = frames.versions(spark, sf)
    edges = frames.edges(spark, sf).where(~F.col("version_id").endswith("-Q4"))
    failed = versions.where(F.col("version_id").endswith("-Q4")).select(
        "version_id", F.lit("run").alias("run_id"), F.lit(None).cast("string").alias("file_path"), F.lit("broken").alias("error_text")
    )
    kept.upsert_versions(versions, {"coupling_edge": edges}, failed)
    again = doubled(edges.where(F.col("source") < "NATION_2"))
    kept.upsert("coupling_edge", again, versions)
    recorded = kept.read("version").select("version_id", "version_order", F.lit(True).alias("recorded"))
    return kept.read("coupling_edge").select(
        "version_id", "source", "target", F.col("score").cast("long").alias("score")
    ).join(recorded, "version_id", "left")


@query("rebuild_store", "SELECT version_id, source, target, score FROM x_edge JOIN x_version USING (version_id) WHERE version_order > 7994")
def _(spark, sf):
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    versions, edges = frames.versions(spark, sf), frames.edges(spark, sf)
    nothing = spark.createDataFrame([], schemas.FAILURE)
    early = first_half(versions, spark, sf)
    kept.rebuild(early, {"coupling_edge": first_half(edges, spark, sf)}, nothing)
    late = versions.where("version_order > 7994")
    kept.rebuild(late, {"coupling_edge": edges.join(late.select("version_id"), "version_id", "left_semi")}, nothing)
    return kept.read("coupling_edge").select("version_id", "source", "target", F.col("score").cast("long").alias("score"))


@query(
    "retry_after_failure",
    """SELECT v.version_id, e.source, e.target, e.score FROM x_version v LEFT JOIN (SELECT * FROM x_edge
       WHERE version_id NOT LIKE '%-Q4' AND version_id NOT LIKE '%-Q2') e USING (version_id) WHERE v.version_id NOT LIKE '%-Q2'""",
)
def _(spark, sf):
    """Fourth quarters fail first and are empty successes in the next run; second ones fail in both."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=4)
    versions, edges = frames.versions(spark, sf), frames.edges(spark, sf)
    failed = versions.select(
        "version_id", F.lit("run").alias("run_id"), F.lit(None).cast("string").alias("file_path"), F.lit("broken").alias("error_text")
    )
    good = edges.where(~F.col("version_id").rlike("-Q[24]$"))
    kept.upsert_versions(versions, {"coupling_edge": good}, failed.where(F.col("version_id").rlike("-Q[24]$")))
    todo = logs.pending_versions(versions, kept.read("version"))
    kept.upsert_versions(todo, {"coupling_edge": good.where("false")}, failed.where(F.col("version_id").endswith("-Q2")))
    edge = kept.read("coupling_edge").select("version_id", "source", "target", F.col("score").cast("long").alias("score"))
    return kept.read("version").select("version_id").join(edge, "version_id", "left")


@query(
    "rebuild_clears",
    """SELECT 'version' AS "table", version_id FROM x_version WHERE version_order > 7994
       UNION ALL SELECT DISTINCT 'coupling_edge', version_id FROM x_edge JOIN x_version USING (version_id) WHERE version_order > 7994""",
)
def _(spark, sf):
    """A rebuild that passes fewer tables leaves nothing of the others."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    versions, edges = frames.versions(spark, sf), frames.edges(spark, sf)
    nothing = spark.createDataFrame([], schemas.FAILURE)
    kept.upsert_versions(versions, {"coupling_edge": edges, "module_aggregate": frames.modules(spark, sf)}, nothing)
    late = versions.where("version_order > 7994")
    kept.rebuild(late, {"coupling_edge": edges.join(late.select("version_id"), "version_id", "left_semi")}, nothing)
    found = [kept.read(t).select(F.lit(t).alias("table"), "version_id") for t in ("version", "coupling_edge", "module_aggregate")]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


@query("incremental_refusal", "SELECT version_id, source, target, score FROM x_edge")
def _(spark, sf):
    """An incremental run over another scope is refused and changes nothing."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    versions, edges = frames.versions(spark, sf), frames.edges(spark, sf)
    project = spark.range(1).select(F.lit("p").alias("project_id"), F.lit("main").alias("branch"), F.lit(True).alias("all_modules"))

    def measure(wanted):
        return {"coupling_edge": edges.join(wanted.select("version_id"), "version_id", "left_semi")}, spark.createDataFrame([], schemas.FAILURE)

    incremental.analyze_pending(kept, versions, measure, project=tables.conform(project, schemas.PROJECT))
    other = tables.conform(project.withColumn("branch", F.lit("next")), schemas.PROJECT)
    try:
        incremental.analyze_pending(kept, versions, lambda wanted: ({}, None), project=other)
    except store.ScopeConflict:
        return kept.read("coupling_edge").select("version_id", "source", "target", F.col("score").cast("long").alias("score"))
    raise AssertionError("another scope was not refused")


def _modules_by_priority(spark, sf):
    """Small module rows of every version: orders by priority."""
    return frames.table(spark, sf, "orders").select(*frames.version_columns(), "o_orderpriority").groupBy(
        "version_id", F.col("o_orderpriority").alias("module")
    ).agg(F.count(F.lit(1)).alias("total_lines"))


_MODULES = """SELECT version_id, o_orderpriority AS module, count(*) AS n FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) || '-Q'
    || CAST(quarter(o_orderdate) AS VARCHAR) AS version_id FROM orders) GROUP BY ALL"""


@query(
    "version_fails_alone",
    f"""SELECT 'module' AS part, version_id, module AS detail, n FROM ({_MODULES}) WHERE version_id NOT IN ('1993-Q3', '1996-Q1', '1995-Q2')
       UNION ALL SELECT 'failure', version_id, CASE version_id WHEN '1995-Q2' THEN 'no tree' ELSE 'cannot read ' || version_id END, NULL
       FROM x_version WHERE version_id IN ('1993-Q3', '1996-Q1', '1995-Q2')
       UNION ALL SELECT 'recorded', version_id, NULL, version_order FROM x_version WHERE version_id NOT IN ('1993-Q3', '1996-Q1', '1995-Q2')
       UNION ALL SELECT 'run', 'completed', 'succeeded', count(*) - count(*) FILTER (version_id IN ('1993-Q3', '1996-Q1', '1995-Q2')) FROM x_version
       UNION ALL SELECT 'run', 'completed', 'failed', count(*) FILTER (version_id IN ('1993-Q3', '1996-Q1', '1995-Q2')) FROM x_version""",
)
def _(spark, sf):
    """Two versions break while they are measured, one has no files; all others are stored and the run is tallied."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    rows, versions = _modules_by_priority(spark, sf), frames.versions(spark, sf)
    broken = F.raise_error(F.concat(F.lit("cannot read "), F.col("version_id"))).cast("long")

    def measure(wanted):
        found = rows.join(wanted.select("version_id"), "version_id", "left_semi")
        total = F.when(F.col("version_id").isin("1993-Q3", "1996-Q1"), broken).otherwise(F.col("total_lines"))
        return {"module_aggregate": found.withColumn("total_lines", total)}, spark.createDataFrame([], schemas.FAILURE)

    unreadable = versions.where("version_id = '1995-Q2'").select("version_id", F.lit("no tree").alias("error_text"))
    incremental.analyze_pending(kept, versions, measure, run_id="one", branch="main", unreadable=unreadable)
    none = F.lit(None)
    said = F.coalesce(F.nullif(F.regexp_extract("error_text", "cannot read [0-9]+-Q[0-9]", 0), F.lit("")), F.col("error_text"))
    parts = [
        kept.read("module_aggregate").select(F.lit("module").alias("part"), "version_id", F.col("module").alias("detail"), F.col("total_lines").alias("n")),
        kept.read("failure").select(F.lit("failure"), "version_id", said, none.cast("long")),
        kept.read("version").select(F.lit("recorded"), "version_id", none.cast("string"), F.col("version_order").cast("long")),
        kept.runs().select(F.lit("run"), "status", F.lit("succeeded"), F.col("versions_succeeded").cast("long")),
        kept.runs().select(F.lit("run"), "status", F.lit("failed"), F.col("versions_failed").cast("long")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query(
    "run_ledger",
    """SELECT * FROM (SELECT 'first' AS run_id, 'incremental' AS mode, 'completed' AS status, CAST(count(*) AS INTEGER) AS total,
         CAST(count(*) AS INTEGER) AS succeeded, 0 AS failed, true AS timed FROM x_version WHERE version_order <= 7990)
       UNION ALL SELECT 'second', 'incremental', 'failed', CAST(count(*) AS INTEGER), NULL, NULL, true FROM x_version WHERE version_order > 7990
       UNION ALL SELECT 'third', 'incremental', 'completed', CAST(count(*) AS INTEGER), CAST(count(*) FILTER (version_id NOT LIKE '%-Q4') AS INTEGER),
         CAST(count(*) FILTER (version_id LIKE '%-Q4') AS INTEGER), true FROM x_version WHERE version_order > 7990""",
)
def _(spark, sf):
    """A run that completes, one that breaks off, and one that does its work later with failures."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    rows, versions = _modules_by_priority(spark, sf), frames.versions(spark, sf)

    def measure(failing=""):
        def run(wanted):
            found = rows.join(wanted.select("version_id"), "version_id", "left_semi")
            bad = F.col("version_id").endswith(failing) if failing else F.lit(False)
            failed = wanted.where(bad).select("version_id", F.lit("broken").alias("error_text"))
            return {"module_aggregate": found.where(~bad)}, failed
        return run

    incremental.analyze_pending(kept, versions.where("version_order <= 7990"), measure(), run_id="first")
    try:
        incremental.analyze_pending(kept, versions, lambda wanted: 1 / 0, run_id="second", fail_fast=True)
    except ZeroDivisionError:
        pass
    incremental.analyze_pending(kept, versions, measure("-Q4"), run_id="third")
    return kept.runs().select(
        "run_id", "mode", "status", F.col("versions_total").alias("total"), F.col("versions_succeeded").alias("succeeded"),
        F.col("versions_failed").alias("failed"), (F.col("finished_at") >= F.col("started_at")).alias("timed"),
    )


@query(
    "replayed_batch",
    f"""SELECT 'module' AS part, version_id, module AS detail, n FROM ({_MODULES}) WHERE version_id NOT LIKE '%-Q4'
       UNION ALL SELECT 'failure', version_id, 'broken', 1 FROM x_version WHERE version_id LIKE '%-Q4'""",
)
def _(spark, sf):
    """Two batches of a stream come, and both come again as after a restart: nothing is measured twice or doubled."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=4)
    rows, versions = _modules_by_priority(spark, sf), frames.versions(spark, sf)
    times = iter((1, 1, 0, 0))

    def measure(wanted):
        factor = next(times)
        found = rows.join(wanted.select("version_id"), "version_id", "left_semi").withColumn("total_lines", F.col("total_lines") * factor)
        last = F.col("version_id").endswith("-Q4")
        return {"module_aggregate": found.where(~last)}, wanted.where(last).select("version_id", F.lit("broken").alias("error_text"))

    halves = [versions.where("version_order <= 7990"), versions.where("version_order > 7990")]
    for number, half in [*enumerate(halves), *enumerate(halves)]:
        incremental.analyze_pending(kept, half, measure, batch=("arrivals", number))
    failed = kept.read("failure").groupBy("version_id", "error_text").agg(F.count(F.lit(1)).alias("n"))
    found = kept.read("module_aggregate").select(F.lit("module").alias("part"), "version_id", F.col("module").alias("detail"), F.col("total_lines").alias("n"))
    return found.union(failed.select(F.lit("failure"), "version_id", "error_text", "n"))


@query(
    "interrupted_upsert",
    f"""SELECT reader, version_id, module, CASE WHEN reader = 'later' AND version_id LIKE '%-Q2' THEN 2 * n ELSE n END AS n, summary FROM ({_MODULES})
       JOIN x_version USING (version_id), (VALUES ('after a break'), ('pinned'), ('later')) r(reader)
       UNION ALL SELECT 'later', version_id, 'left over', 1, summary FROM x_version WHERE version_id LIKE '%-Q2'""",
)
def _(spark, sf):
    """An upsert that breaks in its second table shows nothing; a pinned reader keeps its snapshot while a whole one replaces buckets."""
    kept = store.HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=4)
    rows, versions = _modules_by_priority(spark, sf), frames.versions(spark, sf)
    nothing = spark.createDataFrame([], schemas.FAILURE)
    kept.upsert_versions(versions, {"module_aggregate": rows}, nothing)
    pinned = kept.pinned()
    again = versions.where(F.col("version_id").endswith("-Q2"))
    mine = rows.join(again.select("version_id"), "version_id", "left_semi").withColumn("total_lines", F.col("total_lines") * 2)
    broken = mine.select("version_id", F.lit("a").alias("source"), F.lit("b").alias("target"), F.raise_error(F.lit("lost")).cast("long").alias("score"))
    try:
        kept.upsert_versions(again, {"module_aggregate": mine, "coupling_edge": broken}, nothing)
        raise AssertionError("the broken table was stored")
    except Exception as error:
        if "lost" not in str(error):
            raise

    def seen(reader, name):
        return reader.read("module_aggregate").join(reader.read("version"), "version_id").select(
            F.lit(name).alias("reader"), "version_id", "module", F.col("total_lines").alias("n"), "summary"
        )

    after = cut_lineage(seen(kept, "after a break"))
    extra = again.select("version_id", F.lit("left over").alias("module"), F.lit(1).cast("long").alias("total_lines"))
    kept.upsert_versions(again, {"module_aggregate": mine.unionByName(extra)}, nothing)
    out = after.union(seen(pinned, "pinned")).union(seen(kept, "later"))
    found = cut_lineage(out)
    kept.vacuum()
    assert kept.read("module_aggregate").count() == found.where("reader = 'later'").count(), "vacuum took rows that count"
    return found


@query(
    "storable_versions",
    "SELECT version_id FROM x_version WHERE version_id NOT IN (SELECT version_id FROM x_line WHERE version_id LIKE '%-Q1')",
)
def _(spark, sf):
    versions = frames.versions(spark, sf)
    failed = versions.where(F.col("version_id").rlike("-Q[12]$")).select("version_id", F.lit("x").alias("error_text"))
    measured = frames.modules(spark, sf).where(~F.col("version_id").endswith("-Q1"))
    return store.storable_versions(versions, failed, measured).select("version_id")


@query(
    "latest_runs",
    """SELECT CAST(o_custkey AS VARCHAR) AS run_id, max_by(o_orderstatus, o_orderkey) AS status, CAST(max(o_orderkey) AS INTEGER) AS versions_total
       FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    kept = store.HistoryStore(spark, scratch_path(spark, "ledger"))
    runs = frames.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").cast("int").alias("versions_total"),
    )
    kept.append_run(runs.where("versions_total % 2 = 0"))
    kept.append_run(runs.where("versions_total % 2 = 1"))
    return store.latest_runs(kept.read("analysis_run"), "versions_total").select("run_id", "status", "versions_total")


@query("upsert_project", "SELECT substr(sha256(c_name), 1, 16) AS project_id, c_name AS repo_path, CASE WHEN c_custkey % 3 = 0 THEN 'dev' ELSE 'main' END AS branch FROM customer")
def _(spark, sf):
    named = frames.table(spark, sf, "customer").select(
        project_id("c_name").alias("project_id"), F.col("c_name").alias("repo_path"), F.lit("main").alias("branch"), "c_custkey"
    )
    changed = named.where("c_custkey % 3 = 0").withColumn("branch", F.lit("dev"))
    return store.upsert_project(named.where("c_custkey % 5 <> 0 OR c_custkey % 3 <> 0"), changed).drop("c_custkey")


@query(
    "scope_conflicts",
    """SELECT CAST(c_custkey AS VARCHAR) AS project_id, 'branch' AS field FROM customer WHERE c_custkey % 3 = 0
       UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'all_modules' FROM customer WHERE c_custkey % 7 = 0""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    stored = frames.table(spark, sf, "customer").select(
        key.cast("string").alias("project_id"), F.lit("main").alias("branch"), F.lit("default").alias("profile"),
        F.array(F.col("c_mktsegment")).alias("module_prefixes"), F.array("c_name").alias("include_modules"),
        F.lit(False).alias("all_modules"), key,
    )
    asked = stored.withColumn("branch", F.when(key % 3 == 0, "dev").otherwise("main")).withColumn("all_modules", key % 7 == 0)
    return store.scope_conflicts(stored, asked).select("project_id", "field")


@query(
    "check_schema",
    """SELECT 'coupling_edge' AS "table", true AS present, '' AS differences, 4 AS stored_version, 4 AS expected_version,
       (SELECT count(*) > 0 FROM x_edge) AS compatible UNION ALL
       SELECT 'version', true, 'missing summary; version_order is bigint, expected int', 4, 4, false FROM x_latest
       ORDER BY 1""",
)
def _(spark, sf):
    kept = store.HistoryStore(spark, scratch_path(spark, "schema"))
    kept.write_meta("0.1.0")
    frames.edges(spark, sf).write.parquet(kept.path("coupling_edge"))
    frames.versions(spark, sf).withColumn("version_order", F.col("version_order").cast("long")).drop("summary").write.parquet(kept.path("version"))
    differences = F.array_join(F.array_sort(F.split("differences", "; ")), "; ")
    return tables.check_schema(spark, kept.root).where("table in ('version', 'coupling_edge')").withColumn("differences", differences)


@query("conform", "SELECT version_id, version_order, summary, CAST(NULL AS VARCHAR) AS author_name FROM x_version")
def _(spark, sf):
    older = frames.versions(spark, sf).drop("author_name")
    return tables.conform(older, schemas.VERSION).select("version_id", "version_order", "summary", "author_name")


@query("write_result", "SELECT version_id, module, CAST(total_lines AS VARCHAR) AS total_lines, '{\"xml_lines\":' || CAST(xml_lines AS VARCHAR) || '}' AS line_counts FROM x_lines_m")
def _(spark, sf):
    path = scratch_path(spark, "result")
    rows = frames.module_line_counts(spark, sf).select(
        "version_id", "module", "total_lines", F.create_map(F.lit("xml_lines"), "xml_lines").alias("line_counts")
    )
    sinks.write_result(rows, path, "csv")
    return spark.read.option("header", "true").option("escape", "\\").csv(path)


@query(
    "apply_error_policy",
    "SELECT version_id, version_id LIKE '%-Q3' AS failed, CASE WHEN version_id LIKE '%-Q3' THEN 'bad 1' END AS error_text FROM x_version",
)
def _(spark, sf):
    bad = frames.lines(spark, sf).where(F.col("version_id").endswith("-Q3")).select(
        "version_id", F.concat(F.lit("bad "), F.col("lines").cast("string")).alias("error_text")
    )
    rows = apply_error_policy(bad, frames.versions(spark, sf))
    return rows.select("version_id", "failed", "error_text")


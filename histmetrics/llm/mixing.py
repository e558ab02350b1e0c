"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Sources weigh 5, 2, 1, repeating in code point order; their targets are water
levels: a source never takes more than twice its size, what it cannot take is
shared by the others. Point n of the golden-ratio sequence falls on the
cumulative weights of the sources and so gives slot n to one of them; slots are
ranked within their source. A source's documents are shuffled by hash into one
stream of words, the stream is laid twice in a row and dealt into equal blocks
of ``block`` words, and slot r of the source takes block r. The last slot of a
source takes only the words up to its target; slots that the points gave in
excess take none, and slots still missing come at the end of the schedule.

Ranks and running sums are counted in buckets first (of slot numbers, of
shuffle hashes), so a source with a third of all rows is ranked by many tasks.

Defined results: null texts have size 0; documents without words take none;
null sources are a source of their own, last in order; ties in the shuffle are
settled by doc_id and size, equal rows are interchangeable; an empty table gives
an empty result. Whole texts are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmetrics.llm.common import written
from histmetrics.operators.ordering import global_position
from histmetrics.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 512
GOLDEN = (math.sqrt(5) - 1) / 2
#: Documents and slots that one bucket of ranks holds, about.
BUCKET_ROWS = 4096
SEED = "mix"


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, size -> also weight and target. One row per source."""
    bucket = F.struct(F.col("source").isNull().alias("last"), F.substring("source", 1, 2).alias("head"))
    ranked = global_position(sizes, [F.col("source").asc_nulls_last()], bucket, "_place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = cut_lineage(ranked.select("source", "size", weight.alias("weight")))
    # Resharing: each round fixes the sources above their limit and raises the others' level.
    # The rounds end when no further source is above; only scalars come to the driver.
    limit, level, capped = MOST * F.col("size"), None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        at = weighed.agg(
            F.sum("size").alias("all"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(full).alias("capped"),
        ).first()
        if not at["all"] or not at["weights"] or at["capped"] == capped:
            level = level or 0.0
            break
        level, capped = (SHARE * at["all"] - at["fixed"]) / at["weights"], at["capped"]
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double")))


def streams(sized: DataFrame, buckets: int) -> DataFrame:
    """Each document with ``begin``, the words before it in its source's shuffled stream."""
    hashed = sized.withColumn("_hash", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    head = F.conv(F.substring("_hash", 1, 7), 16, 10).cast("long")
    hashed = hashed.withColumn("_bucket", F.floor(head * buckets / 16**7))
    sums = hashed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = hashed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = offsets.withColumnsRenamed({"source": "_source", "_bucket": "_of"})
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    return joined.withColumn("begin", F.col("_inside") + F.col("_offset")).drop(
        "_hash", "_bucket", "_inside", "_source", "_of", "_offset"
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, source, rank, words: which source each slot takes, the how-manieth of it, and how many words."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    count = math.ceil(total / block)
    spread = Window.partitionBy("_one").orderBy(F.col("source").asc_nulls_last())
    # One row per source: positions on the unit interval.
    shares = targets.withColumn("_one", F.lit(1)).withColumn("_end", F.sum("target").over(spread.rowsBetween(Window.unboundedPreceding, 0)))
    shares = shares.select("source", "target", (F.col("_end") - F.col("target")).alias("_from"), "_end")
    # A source's share of the unit interval is cut into cells, so that points find it by equality.
    cells = 4096
    # Bounded: cells plus sources rows.
    cell = F.explode(F.sequence(F.floor(F.col("_from") / total * cells), F.floor(F.col("_end") / total * cells)))
    where = shares.where(F.col("target") > 0).withColumn("_cell", cell) if total else shares.where("false").withColumn("_cell", F.lit(0))
    points = spark.range(count).withColumn("_at", F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)) * F.lit(total))
    points = points.withColumn("_cell", F.floor(F.col("_at") / F.lit(total or 1.0) * cells))
    dealt = points.join(where, "_cell").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_end")))
    dealt = dealt.select(F.col("id").alias("slot"), "source", "target")
    slots = cut_lineage(dealt.withColumn("_bucket", F.floor(F.col("slot") / BUCKET_ROWS)))
    sizes = slots.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("slot")
    ranked = (
        slots.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
        .select("slot", "source", "target", (F.col("_inside") + F.col("_before")).cast("long").alias("rank"))
    )
    given = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("_rows").alias("_given"))
    short = targets.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_given", F.coalesce("_given", F.lit(0)))
    short = short.withColumn("_needed", F.ceil(F.round("target") / block)).where(F.col("_needed") > F.col("_given"))
    missing = short.select(
        F.lit(count).cast("long").alias("slot"), "source", "target", F.explode(F.sequence("_given", F.col("_needed") - 1)).alias("rank")
    )
    words = F.least(F.lit(block), F.round("target").cast("long") - F.col("rank") * block)
    return ranked.unionByName(missing).withColumn("words", words).where("words > 0").drop("target")


def mix(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the words taken in the first and second pass, per document.

    All columns of ``documents`` are kept in the struct ``row``. Rows are numbered
    in a table first, so that their texts cross the network once, by number.
    """
    body = F.struct(*[F.col(f"`{c}`").alias(c) for c in documents.columns]).alias("row")
    numbered = documents.select(body, F.monotonically_increasing_id().alias("number"), "doc_id", "source", n_words("text").alias("size"))
    numbered = written(numbered, "numbered")
    return _mix(numbered.drop("row"), block).join(numbered.select("number", "row"), "number").drop("number")


def _mix(sized: DataFrame, block: int) -> DataFrame:
    narrow = cut_lineage(sized)
    sums = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_n"))
    sums = cut_lineage(sums)
    count = sums.agg(F.sum("_n").alias("n")).first()["n"] or 0
    targets = cut_lineage(source_targets(sums.drop("_n")))
    placed = streams(narrow, max(1, count // BUCKET_ROWS))
    per_source = targets.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target")
    # Narrow rows that are read twice: cut here, the plans of what follows stay small in the driver.
    placed = cut_lineage(placed.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    # Two passes over the stream; a document lies in the blocks from its first to its last word.
    begin = F.col("begin") + F.col("pass") * F.col("source_size")
    passes = placed.where(F.col("size") > 0).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    passes = passes.withColumn("_begin", begin).where(F.col("_begin") < F.round("target"))
    last = F.floor((F.col("_begin") + F.col("size") - 1) / block)
    parts = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_begin") / block), last)))
    slots = schedule(targets, block).select(F.col("source").alias("_source"), "rank", "words")
    joined = parts.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (parts["rank"] == slots["rank"])).drop(slots["rank"])
    start = F.col("rank") * block
    overlap = F.least(F.col("_begin") + F.col("size"), start + F.col("words")) - F.greatest(F.col("_begin"), start)
    keys = [c for c in ("number", "doc_id", "source", "begin", "size", "source_size", "target") if c in placed.columns]
    narrow_keys = ["number"] if "number" in placed.columns else ["doc_id", "source", "begin", "size"]
    taken = joined.groupBy(*narrow_keys).agg(
        *[F.sum(F.when(F.col("pass") == k, F.greatest(overlap, F.lit(0))).otherwise(0)).alias(f"_pass{k}") for k in (0, 1)]
    )
    taken = taken.withColumnsRenamed({k: f"_{k}_" for k in narrow_keys})
    same = F.lit(True)
    for k in narrow_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    done = placed.join(taken, same, "left")
    first, second = (F.coalesce(F.col(f"_pass{k}"), F.lit(0)).cast("long") for k in (0, 1))
    return done.select(*keys, (first + second).alias("taken"), first.alias("first_pass"), second.alias("second_pass"))


def mix_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = documents.select("doc_id", "source", n_words("text").alias("size"))
    return _mix(sized, block).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, cut to those words."""
    done = mix(documents, block)
    words = F.explode(F.array("first_pass", "second_pass"))
    rows = done.withColumn("_words", words).where(F.col("_words") > 0)
    pattern = F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, F.col("_words").cast("int")), "")
    new = F.when(F.col("_words") == F.col("size"), text).otherwise(cut)
    columns = []
    for name, kind in documents.dtypes:
        column = F.col("row").getField(name)
        if name == "text":
            column = new
        elif name == "n_chars":
            column = F.when(column.isNotNull(), F.char_length(new)).cast(kind)
        columns.append(column.alias(name))
    return rows.select(*columns)


#: The same result by closed form: taken words are the overlaps with the first round(target) words of the doubled stream.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM per
), levels AS (
  SELECT a.source, (1.5::DOUBLE * a.total - coalesce(sum(2.0::DOUBLE * b.source_size) FILTER (b.ratio < a.ratio), 0))
         / sum(b.weight) FILTER (b.ratio >= a.ratio) AS level, a.ratio
  FROM filled a, filled b GROUP BY a.source, a.ratio, a.total
), chosen AS (
  SELECT arg_min(level, ratio) FILTER (level <= ratio) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(weight * (SELECT level FROM chosen), 2.0::DOUBLE * source_size) AS target FROM filled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(lo + size, round(target)) - lo) + greatest(0, least(lo + source_size + size, round(target)) - lo - source_size) AS BIGINT) AS taken
FROM placed
"""

"""Columns over metric maps, timestamps, labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics import schemas
from histmetrics.functions.catalog import AGGREGATIONS, CATEGORY_LABEL, METRIC_LABEL
from histmetrics.functions.text import _col, title_case

MISSING = "—"

JSON_COLUMNS: dict[str, T.DataType] = {
    "metrics": schemas.METRICS,
    "line_counts": schemas.COUNTS,
    "distributions": schemas.DISTRIBUTIONS,
    "kinds": schemas.KINDS,
    "breakdown": schemas.KINDS,
}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def metric_key(metric: Column | str, agg: str) -> Column:
    """``metric`` when it already ends in ``_agg``, else ``metric_agg``."""
    m = _col(metric)
    return F.when(m.endswith(f"_{agg}"), m).otherwise(F.concat(m, F.lit(f"_{agg}")))


def metric_key_of(metric: str, agg: str) -> str:
    """The same rule for a key that is known when the plan is built."""
    return metric if metric.endswith(f"_{agg}") else f"{metric}_{agg}"


def metric_at(source: Column | str, key: Column | str, json_text: bool = False) -> Column:
    """One value of a metrics map (or JSON text) as double; missing is NULL."""
    k = F.lit(key) if isinstance(key, str) else key
    c = _col(source)
    if json_text:
        c = F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    return F.try_element_at(c, k).try_cast("double")


def metric_value(metrics: Column | str, line_counts: Column | str, metric: str, agg: str) -> Column:
    """``metric_agg``, then the bare key, then the line counts: for scalar metrics too."""
    return F.coalesce(
        metric_at(metrics, metric_key_of(metric, agg)),
        metric_at(metrics, metric),
        metric_at(line_counts, metric),
    )


def parse_json_columns(df: DataFrame) -> DataFrame:
    """JSON text columns to maps; an unreadable text stays in ``<name>_raw``."""
    out = df
    for name, kind in JSON_COLUMNS.items():
        if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
            continue
        parsed = F.from_json(F.col(name), kind)
        out = out.withColumn(f"{name}_raw", F.when(parsed.isNull(), F.col(name)))
        out = out.withColumn(name, parsed)
    return out


def epoch_ts(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def iso_ts(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def format_ts(ts: Column | str) -> Column:
    """``YYYY-MM-DD HH:mm``; text that is no timestamp gives NULL."""
    return F.date_format(_col(ts).try_cast("timestamp"), "yyyy-MM-dd HH:mm")


def metric_label(key: Column | str) -> Column:
    """Catalog label, ``label Aggregation``, or the key in title case."""
    k = _col(key)
    labels = _literal_map(METRIC_LABEL)
    plain = title_case(F.translate(k, "_.", "  "))
    out = F.coalesce(F.try_element_at(labels, k), plain)
    for agg, _, _ in AGGREGATIONS:
        base = F.regexp_replace(k, f"_{agg}$", "")
        found = F.try_element_at(labels, base)
        out = F.when(
            k.endswith(f"_{agg}") & found.isNotNull(),
            F.concat(found, F.lit(" "), title_case(F.lit(agg))),
        ).otherwise(out)
    return out


def category_label(key: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(CATEGORY_LABEL), _col(key)), metric_label(key))


def fallback_label(identifier: Column | str) -> Column:
    """Words capitalised one by one; a dash when nothing readable is left."""
    raw = F.trim(_col(identifier))
    words = F.filter(F.split(raw, r"[\s._\-/]+"), lambda w: F.length(w) > 0)
    cased = F.transform(
        words,
        lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2)))),
    )
    return F.when(raw.rlike("[A-Za-z0-9]"), F.array_join(cased, " ")).otherwise(F.lit(MISSING))


def edge_label(key: Column | str, configured: Column | None = None) -> Column:
    """Configured label if it is not blank, else the key as words, first one capitalised."""
    words = F.filter(F.split(F.regexp_replace(_col(key), "[_-]+", " "), " "), lambda w: F.length(w) > 0)
    text = F.array_join(words, " ")
    readable = F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))
    if configured is None:
        return readable
    return F.when(F.length(F.trim(configured)) > 0, configured).otherwise(readable)


def fmt_lines(value: Column | str) -> Column:
    """Thousands separators."""
    return F.format_number(F.coalesce(_col(value), F.lit(0)), 0)


def fmt_compact(value: Column | str) -> Column:
    """``1.2k`` and ``3M``: one decimal, dropped when it is zero."""
    v = F.coalesce(_col(value), F.lit(0)).cast("decimal(28,0)")

    def scaled(unit: int, mark: str) -> Column:
        tenths = F.round(v / F.lit(unit).cast("decimal(10,0)"), 1).cast("decimal(28,1)")
        return F.concat(F.regexp_replace(tenths.cast("string"), "[.]0$", ""), F.lit(mark))

    return (
        F.when(v >= 1_000_000, scaled(1_000_000, "M"))
        .when(v >= 1_000, scaled(1_000, "k"))
        .otherwise(v.cast("string"))
    )


def fmt_metric(value: Column | str) -> Column:
    """Two decimals."""
    return F.format_string("%.2f", F.coalesce(_col(value).cast("double"), F.lit(0.0)))


def fmt_duration(seconds: Column | str) -> Column:
    """``XmYs`` from whole seconds, ``Ys`` below a minute."""
    total = F.floor(_col(seconds)).cast("long")
    minutes, rest = F.floor(total / 60).cast("long"), F.pmod(total, F.lit(60))
    return F.when(minutes > 0, F.format_string("%dm%ds", minutes, rest)).otherwise(
        F.format_string("%ds", rest)
    )


def version_label(order: Column | str, version_id: Column | str, summary: Column | str | None = None) -> Column:
    """``#order hash8 summary``; the short form when no summary is asked for."""
    head = F.concat(
        F.lit("#"), _col(order).cast("string"), F.lit(" "), F.substring(_col(version_id), 1, 8)
    )
    if summary is None:
        return head
    return F.concat(head, F.lit(" "), F.coalesce(_col(summary), F.lit("")))


def project_id(path: Column | str) -> Column:
    return F.substring(F.sha2(_col(path), 256), 1, 16)


def nested_at(dotted: str) -> Column:
    """``metrics.x`` to a map lookup, resolved when the plan is built."""
    head, _, rest = dotted.partition(".")
    return F.try_element_at(F.col(head), F.lit(rest)) if rest else F.col(head)


def cell_at(dotted: str) -> Column:
    """A numeric cell as shown in a table; a dash when missing."""
    v = nested_at(dotted).cast("double")
    whole = v == F.floor(v)
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING)).otherwise(
        F.when(whole, F.format_number(v, 0)).otherwise(fmt_metric(v))
    )

"""The same frames as DuckDB common table expressions, for checking results."""

from __future__ import annotations

import re

P95 = "list_sort(list(value))[greatest(1, CAST(ceil(CAST(0.95 AS DOUBLE) * count(*)) AS BIGINT))]"
FAMILIES = ("cyclomatic", "cognitive", "jones")
STATS = ("count", "mean", "median", "p95", "max")
CATEGORIES = ("python_lines", "js_lines", "python_test_lines", "xml_lines", "css_lines", "html_lines")


def _stats(keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, family, count(*) AS count, avg(value) AS mean, median(value) AS median,
           {P95} AS p95, max(value) AS max
    FROM {source} GROUP BY ALL"""


def _wide(stats: tuple[str, ...] = STATS) -> str:
    return ", ".join(
        f"max(CASE WHEN family = '{f}' THEN {s} END) AS {f}_{s}" for f in FAMILIES for s in stats
    )


_CATEGORY = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'python_lines' WHEN 'AO' THEN 'js_lines'
    WHEN 'NF' THEN 'python_test_lines' WHEN 'NO' THEN 'xml_lines' WHEN 'RF' THEN 'css_lines' ELSE 'html_lines' END"""
_KIND = """CASE o_orderpriority WHEN '1-URGENT' THEN 'python_many2one' WHEN '2-HIGH' THEN 'python__inherit'
    WHEN '3-MEDIUM' THEN 'xml_ref' WHEN '4-NOT SPECIFIED' THEN 'python_field_property_access'
    ELSE 'manifest_depends' END"""
_GROUP = """CASE kind WHEN 'python_many2one' THEN 'model_reuse' WHEN 'python__inherit' THEN 'extension_or_method'
    WHEN 'xml_ref' THEN 'view' WHEN 'python_field_property_access' THEN 'field_property'
    WHEN 'manifest_depends' THEN 'extension_or_method' END"""
_VERSION = """CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS version_id,
    CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INTEGER) AS version_order"""

CTES: dict[str, str] = {
    "x_version": f"""SELECT version_id, version_order, min(o_orderdate) AS authored_at, max(o_orderdate) AS committed_at,
        CAST(count(*) AS VARCHAR) || ' orders' AS summary
        FROM (SELECT {_VERSION}, o_orderdate FROM orders) GROUP BY ALL""",
    "x_latest": "SELECT max_by(version_id, version_order) AS version_id FROM x_version",
    "x_line": f"""SELECT {_VERSION}, replace(p_brand, '#', '_') AS module,
        lower(p_type) || '/size_' || CAST(p_size AS VARCHAR) AS relative_path, {_CATEGORY} AS line_category_id,
        CAST(l_quantity AS BIGINT) AS lines, l_quantity AS cyclomatic, round(l_extendedprice * 100) AS cognitive,
        round(l_discount * 100) AS jones
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "x_obs": """SELECT version_id, module, relative_path, 'cyclomatic' AS family, cyclomatic AS value FROM x_line
        UNION ALL SELECT version_id, module, relative_path, 'cognitive', cognitive FROM x_line
        UNION ALL SELECT version_id, module, relative_path, 'jones', jones FROM x_line""",
    "x_dist_m": _stats("version_id, module", "x_obs"),
    "x_dist_f": _stats("version_id, module, relative_path", "x_obs"),
    "x_lines_m": "SELECT version_id, module, "
    + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN line_category_id = '{c}' THEN lines END), 0) AS BIGINT) AS {c}" for c in CATEGORIES
    )
    + ", CAST(sum(lines) AS BIGINT) AS total_lines, count(DISTINCT relative_path) AS python_file_count"
    " FROM x_line GROUP BY ALL",
    "x_module": f"""SELECT * FROM x_lines_m JOIN
        (SELECT version_id, module, {_wide()} FROM x_dist_m GROUP BY ALL) USING (version_id, module)""",
    "x_file": f"""SELECT * FROM (SELECT version_id, module, relative_path, min(line_category_id) AS line_category_id,
        CAST(sum(lines) AS BIGINT) AS lines FROM x_line GROUP BY ALL) JOIN
        (SELECT version_id, module, relative_path, {_wide()} FROM x_dist_f GROUP BY ALL)
        USING (version_id, module, relative_path)""",
    "x_ship": f"""SELECT {_VERSION}, cn.n_name AS source, sn.n_name AS target, c_nationkey, s_nationkey,
        {_KIND} AS kind, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey
        JOIN nation sn ON sn.n_nationkey = s_nationkey""",
    "x_fact": "SELECT * FROM x_ship WHERE source <> target",
    "x_kind": f"""SELECT *, {_GROUP} AS grp FROM
        (SELECT version_id, source, target, kind, count(*) AS n FROM x_fact GROUP BY ALL)""",
    "x_edge": """SELECT version_id, source, target, CAST(sum(n) AS BIGINT) AS score,
        CAST(sum(n) AS BIGINT) AS occurrences, min(kind) AS first_kind,
        string_agg(kind || '=' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS kinds,
        CAST(sum(CASE WHEN grp = 'model_reuse' THEN n END) AS BIGINT) AS model_reuse,
        CAST(sum(CASE WHEN grp = 'extension_or_method' THEN n END) AS BIGINT) AS extension_or_method,
        CAST(sum(CASE WHEN grp = 'view' THEN n END) AS BIGINT) AS view_points,
        CAST(sum(CASE WHEN grp = 'field_property' THEN n END) AS BIGINT) AS field_property
        FROM x_kind GROUP BY ALL""",
    "x_strict_edge": """SELECT version_id, source, target,
        CAST(coalesce(sum(CASE WHEN kind <> 'manifest_depends' THEN n END), 0) AS BIGINT) AS score,
        CAST(sum(n) AS BIGINT) AS occurrences FROM x_kind GROUP BY ALL""",
    "x_nation_module": """SELECT DISTINCT version_id, source AS module FROM x_ship
        UNION SELECT DISTINCT version_id, target FROM x_ship""",
    "x_owner": """SELECT DISTINCT version_id, 'part.k' || CAST(l_partkey AS VARCHAR) AS model, target AS module
        FROM x_ship WHERE l_returnflag = 'R'""",
    "x_use": """SELECT version_id, source AS module, 'part.k' || CAST(l_partkey AS VARCHAR) AS model,
        CASE WHEN l_linestatus = 'F' THEN '_ship' ELSE 'ship' END AS member FROM x_ship WHERE l_returnflag = 'A'""",
    "x_doc": """SELECT doc_id, 'v' || CAST(doc_id % 3 AS VARCHAR) AS version_id, source AS module,
        (CASE WHEN doc_id % 5 = 0 THEN 'tests/' WHEN doc_id % 7 = 0 THEN '' ELSE lang || '/' END)
        || (CASE WHEN doc_id % 11 = 0 THEN 'test_' ELSE '' END) || CAST(doc_id AS VARCHAR) || '.'
        || ['py','js','xml','html','css','scss','txt','test.js'][doc_id % 8 + 1] AS relative_path, text AS content
        FROM documents""",
    "x_doc_lines": r"""SELECT *, length(u) - length(replace(u, chr(10), ''))
        + CASE WHEN u <> '' AND u NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines
        FROM (SELECT *, regexp_replace(content, '\r\n?', chr(10), 'g') AS u FROM x_doc)""",
    "x_doc_cat": r"""SELECT *, CASE
        WHEN name LIKE '%.py' AND is_test THEN 'python_test_lines' WHEN name LIKE '%.py' THEN 'python_lines'
        WHEN name LIKE '%.js' THEN 'js_lines' WHEN name LIKE '%.xml' THEN 'xml_lines'
        WHEN name LIKE '%.html' THEN 'html_lines' WHEN name LIKE '%.css' OR name LIKE '%.scss' THEN 'css_lines' END
        AS line_category_id FROM (SELECT *, lower(split_part(relative_path, '/', -1)) AS name,
        (relative_path LIKE 'tests/%' OR starts_with(split_part(relative_path, '/', -1), 'test_')
         OR relative_path LIKE '%.test.js') AS is_test FROM x_doc_lines)""",
    "x_progress": """SELECT CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'purchase' THEN 'run_completed'
        WHEN 'error' THEN 'run_failed' ELSE 'commit_progress' END AS type, CAST(user_id AS VARCHAR) AS run_id,
        event_id AS seq, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS commits_total,
        CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value) AS INTEGER) END AS processed FROM events""",
}


def sql(query: str) -> str:
    """The query with every expression it uses, directly or not, in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(query)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {query}" if parts else query

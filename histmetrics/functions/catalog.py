"""Kinds, groups, metrics and display options."""

from __future__ import annotations

# --- fixed values (identifiers and labels that results must carry) -----------

LINE_CATEGORIES = (
    "python_lines",
    "js_lines",
    "python_test_lines",
    "xml_lines",
    "css_lines",
    "html_lines",
)

SUFFIX_CATEGORY = {
    ".py": "python_lines",
    ".js": "js_lines",
    ".xml": "xml_lines",
    ".html": "html_lines",
    ".css": "css_lines",
    ".scss": "css_lines",
    ".less": "css_lines",
    ".sass": "css_lines",
}

KIND_GROUP = {
    "python_many2one": "model_reuse",
    "python_one2many": "model_reuse",
    "python_many2many": "model_reuse",
    "python_related": "model_reuse",
    "python_api_depends": "model_reuse",
    "python_api_onchange": "model_reuse",
    "python_api_constrains": "model_reuse",
    "python_env_model": "model_reuse",
    "python_field_property_access": "field_property",
    "python__inherit": "extension_or_method",
    "python_method_call": "extension_or_method",
    "python_private_method_call": "extension_or_method",
    "xml_inherit_id": "view",
    "xml_ref": "view",
    "xml_percent_ref": "view",
    "security_ir_rule_ref": "view",
    "security_ir_rule_model_ref": "model_reuse",
    "security_xml_ref": "view",
    "security_csv_ref": "view",
    "manifest_depends": "extension_or_method",
}

# Kinds the written specification scores with zero points.
ZERO_POINT_KINDS = (
    "manifest_depends",
    "security_csv_ref",
    "security_xml_ref",
    "security_ir_rule_ref",
)

GROUPS = ("model_reuse", "extension_or_method", "view", "field_property")

# (metric id, label, scope, unit, default enabled, readable per file)
METRICS = (
    ("cyclomatic", "Cyclomatic complexity", "both", None, True, True),
    ("cognitive", "Cognitive complexity", "both", None, True, True),
    ("jones", "Jones complexity", "both", None, True, True),
    ("python_file_count", "Python file count", "module", "files", False, False),
    ("lines", "Total lines", "both", "lines", True, True),
    ("lines_by_category", "Lines by category", "module", "lines", False, False),
    ("jones_line_count", "Jones measured lines", "file", "lines", False, True),
    ("function_count", "Function count", "file", "functions", False, True),
)

AGGREGATIONS = (
    ("mean", "Mean", True),
    ("median", "Median", True),
    ("p95", "P95", False),
    ("max", "Max", False),
)

RELATION_TYPES = (
    ("manifest_depends", "Manifest depends on", True),
    ("model_reuse", "Model reuse", True),
    ("extension_or_method", "Extension / method", True),
    ("view", "View", True),
    ("field_property", "Field / property", True),
)

CATEGORY_OPTIONS = (
    ("python_lines", "Python", True),
    ("css_lines", "CSS", False),
    ("html_lines", "HTML", False),
    ("js_lines", "JS", False),
    ("xml_lines", "XML", False),
    ("test_lines", "Tests", True),
)

NODE_SIZE_OPTIONS = (
    ("total_lines", "Total Lines", True),
    ("visible_lines", "Visible Lines", False),
    ("method_count", "Methods", False),
    ("score_in", "Score In", False),
    ("score_out", "Score Out", False),
    ("fixed", "Fixed", False),
)

LINK_THICKNESS_OPTIONS = (
    ("score", "Score", True),
    ("total_points", "Total Points", False),
    ("selected_kind_points", "Kind Points", False),
    ("fixed", "Fixed", False),
)

# The option list says ``test_lines`` where stored rows say ``python_test_lines``.
CATEGORY_ALIAS = {"test_lines": "python_test_lines"}

# --- end of fixed values ------------------------------------------------------

STRICT_KIND_GROUP = {k: g for k, g in KIND_GROUP.items() if k not in ZERO_POINT_KINDS}
METRIC_LABEL = {m[0]: m[1] for m in METRICS}
CATEGORY_LABEL = {c[0]: c[1] for c in CATEGORY_OPTIONS}
FAMILIES = ("cyclomatic", "cognitive", "jones")

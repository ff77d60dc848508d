"""Scalar rules over finding, task and artifact columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.jsontext import to_text
from siftlake.functions.text import blank, byte_length, column, trim_all


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def norm_severity(value: Column | str) -> Column:
    """One of the five severities; anything unknown or empty counts as HIGH."""
    text = F.upper(trim_all(value))
    return F.when(text.isin("CRITICAL", "MEDIUM", "LOW", "INFO"), text).otherwise("HIGH")


def effective_severity(severity: Column | str, reviewed: Column | str) -> Column:
    return F.when(blank(reviewed), norm_severity(severity)).otherwise(norm_severity(reviewed))


def severity_rank(label: Column | str) -> Column:
    return _lookup(column(label), dims.SEVERITY_RANK, 0)


def verification_status(value: Column | str) -> Column:
    text = F.lower(trim_all(value))
    return F.when(text.isin("confirmed", "uncertain", "rejected"), text).otherwise("unreviewed")


def norm_task_status(value: Column | str) -> Column:
    text = F.lower(trim_all(value))
    return F.when(text.isin("running", "paused", "completed", "failed"), text).otherwise("pending")


def norm_run_kind(value: Column | str) -> Column:
    text = trim_all(F.lower(column(value)))
    return F.when(text.isin("gap_check", "revalidate"), text).otherwise("initial")


def stage_label(stage: Column | str) -> Column:
    return _lookup(column(stage), dict(dims.STAGES), "")


def stage_type(stage: Column | str) -> Column:
    return _lookup(column(stage), dims.STAGE_TYPES, "")


def is_completed(status: Column | str) -> Column:
    return F.coalesce(F.lower(column(status)) == "completed", F.lit(False))


def format_location(file: Column | str, line: Column | str) -> Column:
    """`file`, or `file:line`; empty without a file."""
    f, n = F.coalesce(column(file), F.lit("")), F.coalesce(column(line), F.lit(""))
    return F.when(f == "", "").when(n == "", f).otherwise(F.concat(f, F.lit(":"), n))


def format_trigger(method: Column | str, path: Column | str) -> Column:
    m, p = F.coalesce(trim_all(method), F.lit("")), F.coalesce(trim_all(path), F.lit(""))
    return trim_all(F.concat(m, F.lit(" "), p))


def trigger_signature_ui(method: Column | str, path: Column | str) -> Column:
    """The user interface joins the parts first and trims only the whole."""
    m, p = F.coalesce(column(method), F.lit("")), F.coalesce(column(path), F.lit(""))
    return trim_all(F.concat(m, F.lit(" "), p))


def component_label(name: Column | str, version: Column | str) -> Column:
    n, v = F.coalesce(column(name), F.lit("")), F.coalesce(column(version), F.lit(""))
    return F.when(n == "", "").when(v == "", n).otherwise(F.concat(n, F.lit(" @ "), v))


def _pretty_object(v: Column) -> Column:
    indented = F.to_json(F.try_variant_get(v, "$", "map<string,variant>"), {"pretty": "true"})
    return F.regexp_replace(indented, r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")


def format_value(value: Column | str) -> Column:
    """Display text: strings trimmed, lists one item per line, objects as indented JSON."""
    v = column(value)
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    lines = F.array_join(
        F.filter(F.transform(items, lambda x: trim_all(to_text(x))), lambda s: s != ""), "\n"
    )
    return (
        F.when(v.isNull() | F.is_variant_null(v), "")
        .when(kind.startswith("ARRAY"), lines)
        .when(kind.startswith("OBJECT"), _pretty_object(v))
        .otherwise(trim_all(to_text(v)))
    )


def pretty_label(key: Column | str) -> Column:
    """snake_case key as Title Words."""
    words = F.regexp_replace(trim_all(F.replace(column(key), F.lit("_"), F.lit(" "))), r"\s+", " ")
    return F.initcap(F.lower(words))


def is_code_field(key: Column | str, value: Column | str) -> Column:
    return (
        F.contains(column(value), F.lit("\n"))
        | F.lower(trim_all(key)).isin(dims.CODE_FIELDS)
        | (byte_length(value) > 140)
    )


def short_id(value: Column | str) -> Column:
    return F.substring(column(value), 1, 8)


def format_ts(value: Column | str) -> Column:
    return F.coalesce(
        F.date_format(column(value), "yyyy-MM-dd HH:mm:ss"), F.lit(dims.NO_TIMESTAMP)
    )


def line_range_label(start: Column | str, end: Column | str, unknown: str = "lines unknown") -> Column:
    a, b = F.coalesce(column(start), F.lit(0)), F.coalesce(column(end), F.lit(0))
    return (
        F.when((a > 0) & (b > 0), F.format_string("lines %d-%d", a, b))
        .when(a > 0, F.format_string("line %d+", a))
        .otherwise(unknown)
    )


def is_read_success(value: Column | str) -> Column:
    text = F.coalesce(trim_all(value), F.lit(""))
    return (text != "") & ~text.startswith("Error") & ~text.startswith(
        "File is shorter than start_line"
    )


def _contains_any(text: Column, markers: list[str]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(text, F.lit(marker))
    return hit


def classify_error(value: Column | str) -> Column:
    """timeout / non_retryable / retryable / other; a timeout wins."""
    text = F.lower(column(value))
    return (
        F.when(_contains_any(text, dims.TIMEOUT_MARKERS), "timeout")
        .when(_contains_any(text, dims.NON_RETRYABLE_MARKERS), "non_retryable")
        .when(_contains_any(text, dims.RETRYABLE_MARKERS), "retryable")
        .otherwise("other")
    )


def is_retryable(value: Column | str) -> Column:
    return classify_error(value).isin("timeout", "retryable")


def is_placeholder(value: Column | str) -> Column:
    """Secret values that are obviously filled in later."""
    text = F.coalesce(trim_all(value), F.lit(""))
    lower = F.lower(text)
    return (
        (text == "")
        | lower.startswith("replace-with-")
        | lower.startswith("your-")
        | F.contains(lower, F.lit("placeholder"))
        | text.startswith("$")
        | (text.startswith("%") & text.endswith("%"))
    )



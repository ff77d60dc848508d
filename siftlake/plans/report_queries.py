"""Queries over tasks and stages: joins, roll-ups, report tables, sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import jsontext
from siftlake.operators import deltas, findings, report, rollup
from siftlake.plans.finding_queries import (
    ARRAY_SHAPES,
    COMPONENT,
    EFFECTIVE,
    KNOWN,
    LOCATION,
    RANK,
    RAW_HEAD,
    STAGES,
    TASK_STATUS,
    TASKS,
    TRIGGER,
    VERIFICATION,
)
from siftlake.plans.registry import query
from siftlake.plans.views import STAGE_ROWS_SQL, TASK_ROWS_SQL, Views, cte, flat_findings_sql
from siftlake.session import drop_at_end, work_folder
from siftlake.sources import results, tables

BOTH = cte(r=STAGE_ROWS_SQL, t=TASK_ROWS_SQL)
ROUTES_N = "case when shape = 1 then 0 else n end"
# Completed known stages and their active findings with effective severity.
ROLL = f"""{BOTH}, done as (select * from r where lower(status) = 'completed' and stage in {KNOWN}),
  a as (select stage_id, task_id, stage, {EFFECTIVE} as sev from ({flat_findings_sql('done')})
    where {ARRAY_SHAPES} and {VERIFICATION} <> 'rejected')"""
SEVS = ", ".join(f"count(*) filter (sev = '{s}') as {s.lower()}" for s in dims.SEVERITY_RANK)


@query(
    "dashboard_stats",
    f"""{ROLL} select (select count(*) from t) as projects, (select sum({ROUTES_N})::bigint from t) as interfaces,
      (select count(*) from done) as completed_audits, (select count(*) from a) as vulns""",
)
def dashboard_stats(v: Views):
    return rollup.dashboard_stats(v.tasks, v.stages)


_STATUSES = ", ".join(f"('{s}')" for s in dims.TASK_STATUSES)


@query(
    "status_breakdown",
    f"""{TASKS}, d(status) as (values {_STATUSES}), c as (select {TASK_STATUS} as status, count(*) as n from t group by all)
    select status, coalesce(n, 0) as n from d left join c using (status)""",
)
def status_breakdown(v: Views):
    return rollup.status_breakdown(v.tasks)


@query(
    "status_percent",
    f"""{TASKS}, d(status) as (values {_STATUSES}), c as (select {TASK_STATUS} as status, count(*) as n from t group by all)
    select status, coalesce(n, 0) as n, floor(coalesce(n, 0) * 100 / (select count(*) from t) + 0.5)::bigint as percent
    from d left join c using (status)""",
)
def status_percent(v: Views):
    return rollup.status_percent(v.tasks)


@query(
    "severity_breakdown",
    f"{ROLL} select sev as severity, count(*) as n, {RANK.format('sev')} as rank, lower(sev) as tone from a group by all",
)
def severity_breakdown(v: Views):
    return rollup.severity_breakdown(rollup.stage_rows(v.stages))


@query(
    "severity_scale",
    f"""{ROLL}, c as (select sev as severity, count(*) as n, {RANK.format('sev')} as rank, lower(sev) as tone from a group by all)
    select *, greatest(12, floor(n * 100 / (select max(n) from c) + 0.5)::bigint) as width from c""",
)
def severity_scale(v: Views):
    return rollup.severity_scale(rollup.stage_rows(v.stages))


@query(
    "dominant_severity",
    f"""{ROLL} select sev as severity, count(*) as n from a group by sev order by {RANK.format('sev')} desc limit 1""",
)
def dominant_severity(v: Views):
    return rollup.dominant_severity(rollup.stage_rows(v.stages))


_DIM = ", ".join(f"({i}, '{k}', '{n}')" for i, (k, n) in enumerate(dims.STAGES))


@query(
    "stage_coverage",
    f"""{ROLL}, d(ordinal, stage, label) as (values {_DIM})
    select d.*, count(stage_id) as n from d left join done using (stage) group by all""",
)
def stage_coverage(v: Views):
    return rollup.stage_coverage(v.stages)


@query(
    "stage_dimension_join",
    f"""{ROLL}, d(ordinal, stage, label) as (values {_DIM}), c as (select stage, count(*) as k from a group by all)
    select d.*, coalesce(k, 0) as findings from d left join c using (stage)""",
)
def stage_dimension_join(v: Views):
    counts = (
        rollup.stage_rows(v.stages).filter("is_active").groupBy("stage").agg(F.count("*").alias("findings"))
    )
    dimension = F.broadcast(dims.stage_dimension(v.spark))
    return dimension.join(counts, "stage", "left").fillna(0, ["findings"])


@query(
    "task_list",
    f"""{ROLL}, s as (select task_id, count(*) as k, bool_or(shape in (2, 4, 5)) as raw from done group by all),
      x as (select task_id, count(*) as fc, max({RANK.format('sev')}) as top from a group by all)
    select t.task_id, t.name, t.remark, t.status, t.created_at, {ROUTES_N} as route_count, coalesce(fc, 0) as finding_count,
      coalesce(k, 0) as completed_stage_count, 9 as total_stage_count,
      case when fc is not null then case top when 5 then 'CRITICAL' when 4 then 'HIGH' when 3 then 'MEDIUM' when 2 then 'LOW' else 'INFO' end
        when raw then 'UNKNOWN' else 'NONE' end as highest_severity
    from t left join s using (task_id) left join x using (task_id)""",
)
def task_list(v: Views):
    return rollup.task_list(v.tasks, v.stages)


_ATTACHED = """select t.task_id, t.name, t.status, t.created_at, r.stage_id, r.stage, r.status as stage_status,
  r.created_at as stage_created_at from t left join r using (task_id)"""


@query("tasks_with_stages", f"{BOTH} {_ATTACHED}")
def tasks_with_stages(v: Views):
    return tables.tasks_with_stages(v.tasks, v.stages)


@query("read_tasks", f"{BOTH} {_ATTACHED}")
def read_tasks(v: Views):
    return tables.read_tasks(v.tasks, v.stages)


@query("read_task_detail", f"{BOTH} {_ATTACHED} where task_id = '77'")
def read_task_detail(v: Views):
    return tables.read_task_detail(v.tasks, v.stages, F.lit("77"))


@query(
    "task_completion_rollup",
    f"""{STAGES} select task_id, case when count(*) filter (status = 'running') = 0 then 'completed' end as new_status
    from r group by task_id""",
)
def task_completion_rollup(v: Views):
    return tables.completion(v.stages)


_DELETE = f"""{BOTH}, q as (select cast(o_orderkey * 3 as string) as task_id from orders),
  o as (select q.task_id, case when t.task_id is null then 'not_found' when t.status = 'running' then 'conflict'
    else 'deleted' end as outcome from q left join t using (task_id))"""


def _deletion(v: Views):
    ids = v.table("orders").select((F.col("o_orderkey") * 3).cast("string").alias("task_id"))
    return tables.delete_tasks(v.tasks, v.stages, ids)


@query("delete_tasks", f"{_DELETE} select * from o")
def delete_tasks(v: Views):
    return _deletion(v)[2]


@query(
    "delete_stages",
    f"{_DELETE} select stage_id, task_id from r where task_id not in (select task_id from o where outcome = 'deleted')",
)
def delete_stages(v: Views):
    return _deletion(v)[1].select("stage_id", "task_id")


LATEST = "l as (select * from r qualify row_number() over (partition by task_id, stage order by created_at desc, stage_id desc) = 1)"
FIRST = "l as (select * from r qualify row_number() over (partition by task_id, stage order by created_at, stage_id) = 1)"


@query("latest_stage_by_name", f"{STAGES}, {LATEST} select stage_id, task_id, stage from l")
def latest_stage_by_name(v: Views):
    return rollup.latest_stage_by_name(v.stages).select("stage_id", "task_id", F.col("name").alias("stage"))


@query(
    "stage_cards",
    f"""{BOTH}, {FIRST}, d(ordinal, stage, label) as (values {_DIM}),
      u as (select *, case when shape in (0, 2, 3, 4, 5) then null else n end as k, shape not in (0, 2, 3) as payload from l)
    select t.task_id, d.ordinal, d.stage, coalesce(u.status, 'pending') as status, k as finding_count,
      case when u.status = 'running' then 'running' when u.status = 'failed' then 'failed'
        when u.status = 'completed' and k = 0 then 'clean' when u.status = 'completed' and k is not null then 'findings'
        when u.status = 'completed' and payload then 'raw' else 'waiting' end as detail
    from t cross join d left join u on u.task_id = t.task_id and u.stage = d.stage""",
)
def stage_cards(v: Views):
    return rollup.stage_cards(v.tasks, v.stages)


# ---- report ----

_AUDIT = "('rce', 'injection', 'auth', 'access', 'xss', 'config', 'fileop', 'logic')"
REPORT = f"""{BOTH}, {LATEST}, doc as (select * from l where lower(status) = 'completed' and shape <> 3 and stage in {_AUDIT}),
  f as (select *, {EFFECTIVE} as sev, {VERIFICATION} as verification, {LOCATION} as location, {TRIGGER} as trigger
    from ({flat_findings_sql('doc')}) where {ARRAY_SHAPES}),
  num as (select *, verification = 'rejected' as rejected,
    row_number() over (partition by stage_id, verification = 'rejected' order by pos) as number from f)"""
_LABEL = "case stage " + " ".join(f"when '{k}' then '{n}'" for k, n, _ in dims.REPORT_STAGES) + " end"


def _reported(v: Views, read: jsontext.Reader = report.TEXTS):
    return report.report_documents(v.stages, read)


@query(
    "report_findings",
    f"""{REPORT} select stage_id, task_id, stage, rejected, concat(stage, '-', number) as anchor, sev as severity, verification,
      trim(coalesce(verification_reason, '')) as review_reason, trim(coalesce(origin, '')) as origin,
      case when trim(coalesce(subtype, '')) = '' then {_LABEL} else trim(subtype) end as subtype,
      coalesce(description, '{dims.NO_DESCRIPTION}') as description, location, trigger, coalesce(parameter, '') as trigger_parameter
    from num""",
)
def report_findings(v: Views):
    return report.report_findings(_reported(v))


_SHOWN_FIELDS = ["vulnerable_code", "impact", "execution_logic", "proof_type", "file_operation", "storage_point",
                 "component_name", "component_version"]
_FIELD_DIM = ", ".join(
    f"('{s}', '{k}', {i}, '{label}', {str(code).lower()})"
    for s, fields in dims.REPORT_FIELDS.items()
    for i, (k, label, code) in enumerate(fields)
)


_FIELD_ROWS = f"""k as (select stage_id, task_id, stage, rejected, number, {COMPONENT} as component,
        unnest([{', '.join(f"'{n}'" for n in _SHOWN_FIELDS)}, 'affected_endpoints', 'risk_score']) as key,
        unnest([{', '.join(_SHOWN_FIELDS)}, case endpoints when 'items' then concat('/a', chr(10), '/b') end, risk_score]) as val
        from num),
      z as (select * from k where trim(coalesce(val, '')) <> '' and not (stage = 'config' and component <> '' and key like 'component_%'))"""


@query(
    "report_fields",
    f"""{REPORT}, d(stage, key, ordinal, label, code) as (values {_FIELD_DIM}),
      {_FIELD_ROWS}
    select stage_id, task_id, z.stage, rejected, number, case when d.key is null then 2 else 1 end as section,
      coalesce(d.ordinal, 0) as ordinal, z.key,
      coalesce(d.label, (select string_agg(upper(w[1]) || w[2:], ' ') from (select unnest(string_split(z.key, '_')) as w))) as label,
      trim(val) as value, coalesce(d.code, z.key in ({', '.join(f"'{c}'" for c in dims.CODE_FIELDS)}) or contains(val, chr(10)) or strlen(val) > 140) as code
    from z left join d on z.stage = d.stage and z.key = d.key
    union all select stage_id, task_id, stage, rejected, number, 0, 0, 'component', '{dims.COMPONENT_LABEL}', {COMPONENT}, false
    from num where stage = 'config' and component_name is not null""",
)
def report_fields(v: Views):
    return report.report_fields(_reported(v, report.DETAILS))


@query(
    "report_stages",
    f"""{REPORT}, c as (select stage_id, count(*) filter (not rejected) as finding_count, count(*) filter (rejected) as rejected_count,
        count(distinct location) filter (not rejected and location <> '') as unique_files,
        count(distinct trigger) filter (not rejected and trigger <> '') as unique_interfaces,
        {SEVS.replace('(sev', '(not rejected and sev')} from num group by all),
      x as (select doc.*, coalesce(finding_count, 0) as fc, coalesce(rejected_count, 0) as rc, c.* exclude (stage_id, finding_count, rejected_count)
        from doc left join c using (stage_id))
    select stage_id, task_id, stage, {_LABEL} as label, list_position({_AUDIT.replace('(', '[').replace(')', ']')}, stage) - 1 as ordinal,
      fc as finding_count, rc as rejected_count, shape in (2, 4, 5) as raw_only, shape not in (2, 4, 5) and fc = 0 as zero_findings,
      coalesce(unique_files, 0) as unique_files, coalesce(unique_interfaces, 0) as unique_interfaces,
      {', '.join(f"coalesce({s.lower()}, 0) as {s.lower()}" for s in dims.SEVERITY_RANK)},
      {RAW_HEAD},
      case when shape in (2, 4, 5) then '{dims.SUMMARY_RAW}' when fc = 0 and rc > 0 then '{dims.SUMMARY_ALL_REJECTED}'
        when fc = 0 then '{dims.SUMMARY_CLEAN}' else printf('{dims.SUMMARY_FINDINGS}', fc) end as summary,
      strftime(created_at + to_hours(ln), '%Y-%m-%d %H:%M:%S') as completed_at from x""",
)
def report_stages(v: Views):
    shown = report.report_stages(_reported(v))
    return shown.withColumn("raw_head", F.substring_index("raw_text", "```json", 1)).drop("raw_text")


@query(
    "report_overview",
    f"""{REPORT}, n as (select stage_id, count(*) as k from num where not rejected group by all),
      s as (select task_id, count(*) as completed_stage_count,
        count(*) filter (shape not in (2, 4, 5) and k is null) as clean_stage_count, coalesce(sum(k), 0)::bigint as total_findings
        from doc left join n using (stage_id) group by all),
      d as (select task_id, count(distinct location) filter (location <> '') as uf, count(distinct trigger) filter (trigger <> '') as ui, {SEVS}
        from num where not rejected group by all)
    select s.*, coalesce(uf, 0) as unique_files, greatest(coalesce(ui, 0), {ROUTES_N}) as unique_interfaces, {ROUTES_N} as route_count,
      {', '.join(f"coalesce({x.lower()}, 0) as {x.lower()}" for x in dims.SEVERITY_RANK)}
    from s join t using (task_id) left join d using (task_id)""",
)
def report_overview(v: Views):
    return report.report_overview(v.tasks, _reported(v))


@query("report_errors", f"{REPORT} select task_id from t where task_id not in (select task_id from doc)")
def report_errors(v: Views):
    return report.report_errors(v.tasks, _reported(v))


@query(
    "distinct_files_interfaces",
    f"""{REPORT} select stage, count(distinct location) filter (location <> '') as files, count(distinct trigger) filter (trigger <> '') as interfaces
    from num where not rejected group by all""",
)
def distinct_files_interfaces(v: Views):
    shown = report.report_findings(_reported(v)).filter(~F.col("rejected"))
    return shown.groupBy("stage").agg(
        F.count_distinct(F.nullif("location", F.lit(""))).alias("files"),
        F.count_distinct(F.nullif("trigger", F.lit(""))).alias("interfaces"),
    )


@query(
    "ui_report_overview",
    f"""{BOTH}, {FIRST}, doc as (select * from l where status = 'completed' and shape not in (0, 2, 3) and stage in {KNOWN}),
      f as (select *, {EFFECTIVE} as sev, trim(concat(coalesce(method, ''), ' ', coalesce(path, ''))) as trig
        from ({flat_findings_sql('doc')}) where shape not in (4, 5) and {VERIFICATION} <> 'rejected'),
      n as (select stage_id, count(*) as k from f group by all),
      s as (select task_id, count(*) as stage_count, coalesce(sum(k), 0)::bigint as total_findings,
        count(*) filter (shape not in (4, 5) and k is null) as clean_stage_count,
        count(*) filter (shape in (4, 5)) as raw_only_stage_count from doc left join n using (stage_id) group by all),
      d as (select task_id, count(distinct file) as uf, count(distinct trig) filter (trig <> '') as ui, {SEVS} from f group by all),
      x as (select task_id, case when shape = 1 then 0 else len(list_filter(range(1, n + 1), lambda i: (c + i) % 5 <> 0)) end as rc from t)
    select s.*, coalesce(uf, 0) as unique_files, greatest(coalesce(ui, 0), rc) as unique_interfaces, rc as route_count,
      {', '.join(f"coalesce({y.lower()}, 0) as {y.lower()}" for y in dims.SEVERITY_RANK)}
    from s join x using (task_id) left join d using (task_id)""",
)
def ui_report_overview(v: Views):
    return report.ui_report_overview(v.tasks, v.stages)


# ---- sinks: written to the shared folder and read back ----


AGAIN = "stage in ('rce', 'auth')"


@query(
    "write_stage_result",
    f"""{STAGES}, f as (select stage_id as task_id, stage, pos, coalesce(description, '') as d from ({flat_findings_sql()}) where {ARRAY_SHAPES}),
      k as (select task_id, stage, {AGAIN} as again, count(*) as all_n, string_agg(d, '|' order by pos) as all_said,
        count(*) filter (pos > 0) as few_n, coalesce(string_agg(d, '|' order by pos) filter (pos > 0), '') as few_said from f group by all)
    select task_id, stage, case when again then 'completed' else 'running' end as status,
      case when again then 'revalidate' else 'initial' end as run_kind, case when again then few_n else all_n end as findings,
      case when again then few_said else all_said end as said, timestamp '2024-01-01 00:00:00' as created_at,
      case when again then timestamp '2024-01-02 00:00:00' else timestamp '2024-01-01 00:00:00' end as updated_at from k""",
)
def write_stage_result(v: Views):
    """All results are written, then those of two stages again with less; others stay."""
    found = findings.stage_findings(v.stages)
    items = found.select(F.col("stage_id").alias("task_id"), "stage", "pos", F.to_json("item").alias("item"))
    path = work_folder(v.spark, "stage-results")
    drop_at_end(v.spark, path)
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    results.write_stage_result(tables.stage_documents(items, results.KEY), path, "running", at=at(1))
    again = items.where(AGAIN)
    fewer = tables.stage_documents(again.where("pos > 0"), results.KEY)
    results.write_stage_result(fewer, path, "completed", "revalidate", at(2), scope=again)
    results.compact_results(v.spark, path)
    stored = results.stored_stages(v.spark, path).withColumn("items", jsontext.decode_array("output_json"))
    said = F.array_join(F.transform("items", lambda x: jsontext.text_at(x, "description")), "|")
    return stored.select(
        "task_id", F.col("name").alias("stage"), "status", F.col("meta.last_run_kind").alias("run_kind"),
        F.size("items").cast("long").alias("findings"), said.alias("said"), "created_at", "updated_at",
    )


LIVE = f"""{STAGES}, f as (select stage_id as task_id, stage, {EFFECTIVE} as sev,
    {VERIFICATION} <> 'rejected' and not ({AGAIN} and pos = 0) as counted
    from ({flat_findings_sql()}) where {ARRAY_SHAPES} and stage in {KNOWN})"""


def _live(v: Views) -> DataFrame:
    """Results are written and counted, then written again in part and counted again."""
    found = findings.stage_findings(v.stages)
    items = found.select(F.col("stage_id").alias("task_id"), "stage", "pos", F.to_json("item").alias("item"))
    path, counts = work_folder(v.spark, "stage-results"), work_folder(v.spark, "stage-counts")
    drop_at_end(v.spark, path)
    drop_at_end(v.spark, counts)
    results.write_stage_result(tables.stage_documents(items, results.KEY), path)
    deltas.update_counts(v.spark, path, counts)
    again = items.where(AGAIN)
    results.write_stage_result(tables.stage_documents(again.where("pos > 0"), results.KEY), path, scope=again)
    deltas.update_counts(v.spark, path, counts)
    return deltas.stored_counts(v.spark, counts)


@query(
    "live_stage_counts",
    f"""{LIVE} select task_id, stage, 1 as completed, 0 as raw, count(*) filter (counted) as findings,
      {', '.join(f"count(*) filter (counted and sev = '{x}') as {x.lower()}" for x in dims.SEVERITY_RANK)} from f group by all""",
)
def live_stage_counts(v: Views):
    return deltas.live_counts(_live(v))


@query(
    "live_severities",
    f"""{LIVE} select sev as severity, count(*) as n, {RANK.format('sev')} as rank, lower(sev) as tone
    from f where counted group by all""",
)
def live_severities(v: Views):
    return deltas.live_severities(_live(v))


@query(
    "write_report_tables",
    f"""{REPORT}, d(stage, key, ordinal, label, code) as (values {_FIELD_DIM}),
      {_FIELD_ROWS} select 'findings' as name, count(*) as n, count(distinct stage_id) as documents from num
    union all select 'stages', count(*), count(distinct stage_id) from doc
    union all select 'overview', count(distinct task_id), count(distinct task_id) from doc
    union all select 'tasks', count(*), count(distinct task_id) from t
    union all select 'fields', (select count(*) from z)
        + (select count(*) from num where stage = 'config' and component_name is not null), count(distinct stage_id)
      from (select stage_id from z union all select stage_id from num where stage = 'config' and component_name is not null)""",
)
def write_report_tables(v: Views):
    path = work_folder(v.spark, "report")
    tables.write_report_tables(report.report_tables(v.tasks, v.stages), path)
    drop_at_end(v.spark, path)
    counts = []
    for name in ("findings", "stages", "overview", "tasks", "fields"):
        back = v.spark.read.parquet(f"{path}/{name}")
        key = "task_id" if name in ("overview", "tasks") else "stage_id"
        counts.append(
            back.agg(F.count("*").alias("n"), F.count_distinct(key).alias("documents")).select(
                F.lit(name).alias("name"), "n", "documents"
            )
        )
    return functools.reduce(DataFrame.unionByName, counts)

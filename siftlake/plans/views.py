"""Audit-shaped views over the driver's tables.

The SQL texts in this module are read by Spark and by DuckDB alike, with
`{table}` standing for a table. Where a view carries JSON, Spark builds it from
the flat columns so that parsing is exercised, while the SQL twins keep to the
flat columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

FILES_SQL = """
select source as task_id,
  concat(case doc_id % 11 when 0 then 'vendor/' when 1 then '.hidden/' when 2 then 'projects/'
      when 3 then 'frontend/dist/' when 4 then 'data/' when 5 then '' else 'src/' end,
    lang, case when doc_id % 11 = 5 then '-' else '/' end, 'doc', cast(doc_id as string),
    case doc_id % 9 when 0 then '.php' when 1 then '.go' when 2 then '.js' when 3 then '.java'
      when 4 then '.py' when 5 then '.jsp' when 6 then '.MD' when 7 then '.exe' else '.json' end) as path,
  text as content
from {documents}
"""

SECRET_FILES_SQL = """
select source as task_id,
  concat(case doc_id % 7 when 0 then 'release/' when 1 then 'data/' else 'src/' end, 'doc', cast(doc_id as string),
    case doc_id % 5 when 0 then '.zip' when 1 then '.go' else '.json' end) as path,
  concat(text, chr(10), case doc_id % 9
    when 0 then concat('  "api_key": "sk-', repeat('a', 24), '",')
    when 1 then concat('"password" : "$', chr(123), 'ENV', chr(125), '"')
    when 2 then concat('"Password": "s3cret', cast(doc_id as string), '"')
    when 3 then '"auth_key": "your-key"'
    when 4 then 'dsn = postgres://user:pw@host/db'
    when 5 then '-----BEGIN RSA PRIVATE KEY-----'
    when 6 then '"auth_key":"k1", "auth_key":"placeholder"'
    when 7 then '"password": "%PW%", "api_key": "abc"' else '' end, chr(10)) as content
from {documents}
"""

ROUTE_FILES_SQL = """
select concat('site', cast(page_id % 20 as string)) as task_id, concat('web/p', cast(page_id as string), '.html') as path,
  concat(html, chr(10), case page_id % 8
    when 0 then 'r.GET("/api/items", list)' when 1 then 'r.Delete("/api/items", del)'
    when 2 then '@app.route("/home")' when 3 then '@PostMapping("/orders")'
    when 4 then 'app.get(''/users'', f)' when 5 then 'http.HandleFunc("/health", h)'
    when 6 then 'urlpatterns = [path("/admin", v)]' else 'plain text' end) as content
from {pages}
"""


# One stage document per order line; `n` findings each, laid out by `shape`.
STAGE_ROWS_SQL = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
    cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) as stage_id,
  cast(l_orderkey as string) as task_id,
  case when l_orderkey % 23 = 0 then 'notes' else case (l_linenumber + l_orderkey) % 9 when 0 then 'static_scan'
    when 1 then 'rce' when 2 then 'injection' when 3 then 'auth' when 4 then 'access' when 5 then 'xss'
    when 6 then 'config' when 7 then 'fileop' else 'logic' end end as stage,
  l_orderkey as o, l_partkey as p, l_suppkey as s, l_linenumber as ln,
  case when l_returnflag = 'A' then 'completed' when l_returnflag = 'R' then 'Completed' else
    case l_suppkey % 4 when 0 then 'running' when 1 then 'paused' when 2 then 'failed' else 'completed' end end as status,
  l_shipdate as created_at, l_partkey % 9 as shape, cast(l_quantity as bigint) % 4 as n
from {lineitem}
"""

STAGE_TYPE_SQL = """case stage when 'rce' then 'RCE' when 'injection' then 'Injection' when 'auth' then 'Authentication'
  when 'access' then 'Authorization' when 'xss' then 'XSS' when 'config' then 'Configuration'
  when 'fileop' then 'FileOperation' when 'logic' then 'BusinessLogic' else '' end"""

# Fields of finding i of a document; {j} repeats finding 1 as finding 3.
FINDING_SQL = {
    "type": f"case (p + {{j}}) % 5 when 0 then '' when 1 then null when 2 then 'Custom' else {STAGE_TYPE_SQL} end",
    "subtype": """case (s + {j}) % 6 when 0 then 'Session Fixation' when 1 then 'Stored XSS' when 2 then 'Path Traversal'
      when 3 then 'Race Condition' when 4 then '' else null end""",
    "severity": """case (p + i) % 7 when 0 then 'critical' when 1 then 'High' when 2 then ' medium ' when 3 then 'LOW'
      when 4 then 'info' when 5 then '' else null end""",
    "reviewed_severity": "case (s + i) % 10 when 0 then 'low' when 1 then ' ' when 2 then 'Critical' else null end",
    "verification_status": """case (p + s + i) % 6 when 0 then 'Confirmed' when 1 then 'rejected'
      when 2 then ' UNCERTAIN ' when 3 then '' when 4 then 'other' else null end""",
    "verification_reason": "case (s + i) % 3 when 0 then 'checked' when 1 then '  ' else null end",
    "origin": "case (p + i) % 4 when 0 then 'gap_check' when 1 then ' ' when 2 then null else 'initial' end",
    "file": "case when (p + {j}) % 11 = 0 then null else concat('src/P', cast((p + {j}) % 50 as string), '.go') end",
    "line": "case when (s + {j}) % 5 = 4 then null else (s + {j}) % 5 end",
    "function": "case when (p + {j}) % 3 = 0 then 'Handle' else null end",
    "method": "case (o + {j}) % 3 when 0 then 'get' when 1 then 'POST' else '' end",
    "path": "case when (s + {j}) % 7 = 0 then null else concat('/api/', cast((s + {j}) % 20 as string)) end",
    "parameter": "case when {j} = 2 then 'id' else null end",
    "description": "case when (p + i) % 8 = 0 then null else concat('finding ', cast(p as string)) end",
    "vulnerable_code": "case when i % 2 = 1 then concat('exec(', cast(p as string), ')') else '' end",
    "impact": "case i when 3 then 'revised impact' when 1 then 'base impact' else null end",
    "execution_logic": "concat('step one', chr(10), 'step ', cast(i as string))",
    "proof_type": "case s % 4 when 0 then 'HTTP' when 1 then 'Static' when 2 then 'guess' else null end",
    "file_operation": "case p % 4 when 0 then 'upload' when 1 then 'rename' else null end",
    "storage_point": "case s % 3 when 0 then 'db' when 1 then '' else null end",
    "component_name": "case when stage = 'config' and s % 2 = 0 then 'log4j' else null end",
    "component_version": "case when s % 4 = 0 then '2.1' else null end",
}
SAME_AS_FIRST = "(case when i = 3 then 1 else i end)"


def finding_sql(name: str, j: str = SAME_AS_FIRST) -> str:
    return FINDING_SQL[name].replace("{j}", j)


def flat_findings_sql(rows: str = "r") -> str:
    """DuckDB: the findings of stage rows as flat columns, position 0-based."""
    fields = ",\n".join(f'{finding_sql(n)} as "{n}"' for n in FINDING_SQL)
    return f"""select stage_id, task_id, stage, status, shape, created_at, ln, o, p, s, n, cast(i - 1 as int) as pos,
      case s % 3 when 0 then 'items' when 1 then 'empty' else 'absent' end as endpoints,
      case p % 3 when 0 then '88' when 1 then '7.5' else '' end as risk_score, {fields}
    from (select *, unnest(range(1, n + 1)) as i from {rows})"""


def _item_sql(fields: dict[str, str]) -> str:
    """Spark: one finding as a struct; nulls are left out when it is printed as JSON."""
    top = [n for n in fields if n not in ("file", "line", "function", "method", "path", "parameter")]
    location = ", ".join(f"'{n}', {fields[n]}" for n in ("file", "line", "function"))
    trigger = ", ".join(f"'{n}', {fields[n]}" for n in ("method", "path", "parameter"))
    named = ", ".join(f"'{n}', {fields[n]}" for n in top)
    return f"""named_struct({named},
      'location', case when {fields['file']} is null then null else named_struct({location}) end,
      'trigger', named_struct({trigger}),
      'affected_endpoints', case s % 3 when 0 then array('/a', '/b', ' ') when 1 then array() else null end,
      'risk_score', case p % 3 when 0 then 88.0D when 1 then 7.5D else null end)"""


def items_sql(fields: dict[str, str], count: str = "n", item: Callable[[dict[str, str]], str] = _item_sql) -> str:
    """Spark: the JSON array of `count` items. Up to three are written out, as a lambda's body is not compiled."""
    one = item(fields)
    few = [re.sub(r"\bi\b", str(i), one) for i in (1, 2, 3)]
    cases = " ".join(f"when {count} = {n} then to_json(array({', '.join(few[:n])}))" for n in (1, 2, 3))
    return f"case when {count} = 0 then '[]' {cases} else to_json(transform(sequence(1, {count}), i -> {one})) end"


# Answers of later runs: the kind goes by line number, some are not usable.
ANSWER_ROWS_SQL = f"""
select r.*, case ln % 3 when 0 then 'initial' when 1 then ' GAP_CHECK' else 'revalidate' end as kind,
  (p + s) % 4 as m,
  case when s % 13 = 0 then 'unreadable' when s % 13 = 1 then 'object' else 'array' end as form
from ({STAGE_ROWS_SQL}) r
"""
# A gap check's second finding is new, all others repeat stored signatures.
ANSWER_J = "(case when ln % 3 = 1 and i >= 2 then 9 when i = 3 then 1 else i end)"
ANSWER_FIELDS = {
    **{n: finding_sql(n, ANSWER_J) for n in FINDING_SQL},
    "severity": "case when i = 1 then 'Low' else null end",
    "reviewed_severity": "case when i = 1 then 'info' else null end",
    "verification_status": """case (s + i) % 4 when 0 then 'confirmed' when 1 then 'rejected' when 2 then null
      else ' Uncertain' end""",
    "origin": "case (p + i) % 2 when 0 then null else 'manual' end",
    "impact": "case when i = 1 then 'reviewed impact' when i = 2 then '' else null end",
}


def flat_answers_sql(rows: str = "a") -> str:
    fields = ",\n".join(f'{sql} as "{n}"' for n, sql in ANSWER_FIELDS.items())
    return f"""select stage_id, task_id, stage, status, shape, ln, o, p, s, n, m, kind, form, cast(i - 1 as int) as pos,
      {fields} from (select *, unnest(range(1, m + 1)) as i from {rows})"""


# Tasks are orders; the route inventory has `n` routes laid out by `shape`.
TASK_ROWS_SQL = """
select cast(o_orderkey as string) as task_id,
  case when o_orderkey % 13 = 0 then '  ' else concat(' task ', cast(o_orderkey as string)) end as name,
  o_orderpriority as remark,
  case o_orderstatus when 'F' then 'Completed ' when 'O' then case when o_custkey % 3 = 0 then 'running' else 'paused' end
    else case when o_custkey % 2 = 0 then 'failed' else 'queued' end end as status,
  o_orderdate as created_at, o_orderkey as o, o_custkey as c, o_orderkey % 7 as shape, o_custkey % 4 as n
from {orders}
"""
ROUTE_SQL = {
    "method": "case when (c + i) % 5 = 0 then '' when (c + i) % 2 = 0 then 'get' else 'POST' end",
    "path": "concat('/r/', cast((c + i) % 3 as string))",
    "source": "case when (o + i) % 4 = 0 then null else 'routes.go' end",
    "description": "case when i = 2 then concat('route ', cast(c as string)) else '' end",
}


# Transcripts: long sessions from the events of a user, text-heavy ones from the conversations.
MESSAGES_SQL = """
select concat('u', cast(user_id as string)) as session, event_id as seq,
  case event_type when 'click' then 'tool' when 'error' then 'tool' when 'signup' then 'user' else 'assistant' end as role,
  case when event_type = 'signup' and event_id % 11 = 0 then 'compact_boundary'
    when event_type = 'signup' and event_id % 11 = 1 then 'microcompact_event' else 'normal' end as kind,
  concat(event_type, ' ', props, repeat(' é log', cast(event_id % 30 as int))) as content,
  case when event_type = 'view' then cast(1 + event_id % 2 as int) else 0 end as n_calls,
  concat('q=', cast(event_id % 7 as string)) as args,
  case when event_type in ('click', 'error') then case when event_id % 5 = 4 then '' else concat('call-', cast(event_id % 3 as string)) end
    end as tool_call_id,
  case when event_type in ('click', 'error') then case event_id % 4 when 0 then 'read_file' when 1 then 'grep_files'
    when 2 then 'get_artifact' else 'list_files' end end as tool_name,
  case when event_type in ('click', 'error') and event_id % 3 = 0 then concat('art-', cast(event_id as string)) end as artifact_id
from {events}
union all
select concat('c', cast(conv_id as string)), turn, case when role = 'user' and turn % 4 = 2 then 'tool' else role end, 'normal',
  text, case when role = 'assistant' and turn % 4 = 1 then 1 else 0 end, concat('turn=', cast(turn as string)),
  case when role = 'user' and turn % 4 = 2 then case when conv_id % 5 = 0 then 'call-1' else 'call-0' end end,
  case when role = 'user' and turn % 4 = 2 then 'read_file' end, null
from {conversations}
"""
STATES_SQL = f"""
select session, max(case when kind = 'compact_boundary' then seq end) as boundary_seq,
  min(case when seq % 3 = 0 then seq end) as head_seq, min(case when seq % 5 = 0 then seq end) as tail_seq,
  max(case when seq % 7 = 0 then seq end) as memory_seq,
  case when count(*) % 3 = 0 then ' ' else concat('notes ', cast(count(*) as string)) end as memory_text
from ({MESSAGES_SQL}) m group by session
"""


class Views:
    """Views of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A driver table, in the partitions that the read settings of the session give.

        The setting `spark.siftlake.spread` deals the rows out to so many partitions first; it is for test tables
        of one row group, which a scan can't split, while the views are all CPU work.
        """
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        spread = self.spark.conf.get("spark.siftlake.spread", None)
        return df.repartition(int(spread)) if spread else df

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(FILES_SQL)

    @cached_property
    def secret_files(self) -> DataFrame:
        return self.sql(SECRET_FILES_SQL)

    @cached_property
    def route_files(self) -> DataFrame:
        return self.sql(ROUTE_FILES_SQL)

    @cached_property
    def stages(self) -> DataFrame:
        """Stage documents whose JSON sits in `output_json`, in a fence, between prose, or nowhere."""
        items = F.expr(items_sql({n: finding_sql(n) for n in FINDING_SQL}))
        rows = self.sql(STAGE_ROWS_SQL).withColumn("arr", F.when(F.col("shape").isin(2, 3, 4), None).otherwise(items))
        shape, arr = F.col("shape"), F.col("arr")
        output = (
            F.when(shape.isin(0, 2), "{}").when(shape.isin(1, 5), "").when(shape == 3, "null")
            .when(shape == 4, "not json").otherwise(arr)
        )
        result = (
            F.when(shape == 0, F.concat(F.lit("Audit notes\n```json\n"), arr, F.lit("\n```\nend")))
            .when(shape == 1, F.concat(F.lit("Found: "), arr, F.lit(" done.")))
            .when(shape == 2, "  Raw note without a list ")
            .when(
                shape == 5,
                F.concat(F.lit("First draft:\n```\n[draft]\n```\nfinal:\n```json\n"), arr, F.lit("\n```\n")),
            )
            .otherwise("")
        )
        return rows.select(
            "stage_id",
            "task_id",
            F.col("stage").alias("name"),
            "status",
            result.alias("result"),
            output.alias("output_json"),
            "created_at",
            F.expr("created_at + make_interval(0, 0, 0, 0, ln)").alias("updated_at"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Answers of later runs: (stage_id, kind, content)."""
        arr = F.expr(items_sql(ANSWER_FIELDS, "m"))
        content = (
            F.when(F.col("form") == "unreadable", "no list here")
            .when(F.col("form") == "object", '{"a": 1}')
            .otherwise(F.concat(F.lit("See [1] below.\n```\n[old]\n```\n```json\n"), arr, F.lit("\n```")))
        )
        return self.sql(ANSWER_ROWS_SQL).select("stage_id", "kind", content.alias("content"))

    @cached_property
    def tasks(self) -> DataFrame:
        """Tasks with their route inventory as JSON."""
        def route(fields: dict[str, str]) -> str:
            return "named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in fields.items()) + ")"

        arr = F.expr(items_sql(ROUTE_SQL, item=route))
        shape = F.col("shape")
        return (
            self.sql(TASK_ROWS_SQL)
            .withColumn("arr", arr)
            .select(
                "task_id",
                "name",
                "remark",
                "status",
                "created_at",
                F.when(shape == 0, F.concat(F.lit("routes: "), F.col("arr"), F.lit("."))).otherwise("").alias("result"),
                F.when(shape.isin(0, 1), "").otherwise(F.col("arr")).alias("output_json"),
            )
        )

    @cached_property
    def messages(self) -> DataFrame:
        calls = """case when n_calls = 0 then cast(array() as array<struct<id: string, name: string, arguments: string>>)
          else transform(sequence(0, n_calls - 1), i -> named_struct('id', concat('call-', cast(i as string)),
            'name', 'grep_files', 'arguments', args)) end"""
        rows = self.sql(MESSAGES_SQL)
        return rows.select(
            "session", "seq", F.concat(F.lit("m-"), "seq").alias("id"), "role", "kind", "content",
            F.expr(calls).alias("tool_calls"), "tool_call_id", "tool_name", "artifact_id",
        )

    @cached_property
    def states(self) -> DataFrame:
        """Session states: active boundary and memory cursor as message ids, and the memory text."""

        def name(column: str) -> Column:
            return F.concat(F.lit("m-"), F.col(column))

        return self.sql(STATES_SQL).select(
            "session",
            name("boundary_seq").alias("active_boundary_id"),
            name("memory_seq").alias("last_memory_message_id"),
            "memory_text",
        )

    @cached_property
    def bounded_messages(self) -> DataFrame:
        """Messages whose active boundary holds the first and last id of its preserved segment."""
        ends = self.sql(STATES_SQL).select(
            "session",
            F.col("boundary_seq").alias("seq"),
            F.struct(
                F.concat(F.lit("m-"), "head_seq").alias("head_id"), F.concat(F.lit("m-"), "tail_seq").alias("tail_id")
            ).alias("boundary"),
        )
        return self.messages.join(ends, ["session", "seq"], "left")


def duck(text: str) -> str:
    """The same text for DuckDB, where the tables are views of that name."""
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text


def cte(**views: str) -> str:
    return "with " + ",\n".join(f"{name} as ({duck(text)})" for name, text in views.items())



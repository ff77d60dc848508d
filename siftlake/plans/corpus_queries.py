"""Queries over files: sources, lines, listings, rule scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import labels, paths
from siftlake.operators import lines, rule_tables, scans
from siftlake.plans.registry import query
from siftlake.plans.views import FILES_SQL, ROUTE_FILES_SQL, SECRET_FILES_SQL, Views, cte
from siftlake.session import drop_at_end, work_folder, written_table
from siftlake.sources import gram_index, ranges, tables

# The test documents hold tokens and page scripts, which the default rules do not look for.
EXTRA_RULES = [
    *dims.STATIC_RULES,
    (r'token\s*=\s*"[0-9a-f]{40}"', "Configuration", "Hard-coded Token", "HIGH", "Token in source"),
    (r"(?i)\b(license|copyright)\b", "Configuration", "License Text", "INFO", "License line"),
    (r"[a-z]+tion\b", "Configuration", "Word Match", "LOW", "Frequent word"),
]

FILES = cte(f=FILES_SQL)
IGNORED = "[" + ", ".join(f"'{d}'" for d in dims.IGNORED_DIRECTORIES) + "]"
PARTS = "string_split(path, '/')"
DIRS = f"{PARTS}[1:-2]"
SPLIT_LINES = """, l as (select task_id, path, content, unnest(string_split(content, chr(10))) as text,
  generate_subscripts(string_split(content, chr(10)), 1) as line from f)"""
# Scanner lines: no empty line after a final line feed.
SCANNED = """, l as (select * from (select task_id, path, content, unnest(string_split(content, chr(10))) as text,
    generate_subscripts(string_split(content, chr(10)), 1) as line, len(string_split(content, chr(10))) as n_lines from f)
  where not (text = '' and line = n_lines))"""
WALK = "replace(path, '/', chr(1))"


@query(
    "read_corpus",
    f"{FILES} select task_id, path, strlen(content) as bytes, md5(content) as digest from f",
)
def read_corpus(v: Views):
    return tables.corpus_table(v.files).select("task_id", "path", "bytes", F.md5("content").alias("digest"))


@query(
    "corpus_quota",
    f"""{FILES}, t as (select task_id, count(*) as file_count, sum(strlen(content))::bigint as bytes, 0 as escaping
      from f group by all)
    select *, case when bytes > 120000 then 'too_large' else 'ok' end as reason, bytes <= 120000 as admitted from t""",
)
def corpus_quota(v: Views):
    return tables.corpus_quota(v.files, 120_000)


@query("source_lines", f"{FILES}{SPLIT_LINES} select task_id, path, line, text from l")
def source_lines(v: Views):
    return lines.source_lines(v.files)


@query("scanner_lines", f"{cte(f=SECRET_FILES_SQL)}{SCANNED} select task_id, path, line, text from l")
def scanner_lines(v: Views):
    return lines.source_lines(v.secret_files, "scanner")


@query(
    "corpus_lines",
    f"""{FILES}, l as (select task_id, regexp_replace(unnest(string_split(content, chr(10))), '\\r$', '') as text from f)
    select task_id, text, count(*) as copies, true as numbered from l group by all""",
)
def corpus_lines(v: Views):
    """The corpus is written as text files, several contents in each, and read by byte ranges."""
    root = work_folder(v.spark, "corpus")
    drop_at_end(v.spark, root)
    v.files.where("content is not null").select("task_id", "content").write.partitionBy("task_id").text(root)
    found = ranges.corpus_lines(v.spark, root, "*.txt", "scanner")
    task = F.regexp_replace("task_id", "^task_id=", "")
    per_file = found.groupBy("task_id", "path").agg(
        F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.sum("line").alias("total")
    )
    right = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("total") * 2 == F.col("n") * (F.col("n") + 1))
    # A table of known size: it is broadcast only where it is small, and then lines are dealt out once.
    per_task = written_table(per_file.groupBy(task.alias("task_id")).agg(F.bool_and(right).alias("numbered")), "numbered")
    copies = found.groupBy(task.alias("task_id"), "text").agg(F.count("*").alias("copies"))
    return copies.join(per_task, "task_id")


_RULES_SQL = ", ".join(
    "({}, '{}', '{}', '{}', '{}', '{}')".format(i, *[x.replace("'", "''") for x in r])
    for i, r in enumerate(EXTRA_RULES)
)
STATIC = f"""{FILES}, rules(rule_no, pattern, type, subtype, severity, description) as (values {_RULES_SQL})
  {SPLIT_LINES}, hits as (select l.task_id, l.path, l.line, rule_no, type, subtype, severity, description,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as vulnerable_code
  from l join rules on regexp_matches(text, pattern)
  where regexp_matches(lower(path), '\\.(php|go|js|java|py|jsp)$')
    and len(list_filter({DIRS}, lambda d: starts_with(d, '.') or d in ('vendor', 'node_modules'))) = 0)"""


@query("static_scan", f"{STATIC} select * from hits")
def static_scan(v: Views):
    return scans.static_scan(v.files, EXTRA_RULES)


@query(
    "static_rules",
    f"""{STATIC} select r.rule_no, r.type, r.subtype, r.severity, count(h.path) as findings,
      count(distinct (h.task_id, h.path)) filter (h.path is not null) as files
    from rules r left join hits h using (rule_no) group by all""",
)
def static_rules(v: Views):
    return scans.static_rule_counts(v.files, EXTRA_RULES)


# One more rule for each benchmark item: its first pair of plain words, in any case.
PHRASE = "([a-z]+ [a-z]+)"


def _rule_rows(v: Views):
    fixed = v.spark.createDataFrame(
        rule_tables.static_rule_table(EXTRA_RULES),
        "rule_no long, pattern string, type string, subtype string, severity string, description string",
    )
    phrases = v.table("benchmark").select(
        (F.col("item_id").cast("long") + 1000).alias("rule_no"),
        F.concat(F.lit("(?i)"), F.regexp_extract("text", PHRASE, 1)).alias("pattern"),
        F.lit("Phrase").alias("type"),
        F.lit("Benchmark").alias("subtype"),
        F.lit("INFO").alias("severity"),
        F.col("item_id").cast("string").alias("description"),
    )
    return fixed.unionByName(phrases.where("pattern <> '(?i)'"))


@query(
    "static_scan_table",
    f"""{STATIC}, phrases as (select cast(item_id as bigint) + 1000 as rule_no, regexp_extract(text, '{PHRASE}', 1) as words,
        cast(item_id as varchar) as description from benchmark)
    select * from hits union all
    select l.task_id, l.path, l.line, p.rule_no, 'Phrase', 'Benchmark', 'INFO', p.description,
      trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))
    from l join phrases p on contains(lower(text), words)
    where words <> '' and regexp_matches(lower(path), '\\.(php|go|js|java|py|jsp)$')
      and len(list_filter({DIRS}, lambda d: starts_with(d, '.') or d in ('vendor', 'node_modules'))) = 0""",
)
def static_scan_table(v: Views):
    return rule_tables.static_scan_table(v.files, _rule_rows(v))


def _grep_sql(pattern: str) -> str:
    return f"""{FILES}{SCANNED}, hits as (select task_id, path, line, trim(text, ' ' || chr(9) || chr(13)) as t from l
        where not list_has_any({DIRS}, {IGNORED}) and regexp_matches(text, '{pattern}')
          and not regexp_matches(lower(path), '\\.exe$'))
    select task_id, path, line,
      hex(case when strlen(t) > 100 then encode(t)[1:97] else encode(t) end) as shown
    from hits"""


def _shown_bytes(found: DataFrame) -> DataFrame:
    # A cut may split a character, which shows as a mark in Spark: compare the bytes before it.
    raw = F.col("shown").cast("binary")
    return found.withColumn(
        "shown", F.hex(F.when(F.octet_length("shown") > 100, F.substring(raw, 1, 97)).otherwise(raw))
    )


@query("grep_lines", _grep_sql("(?i)TION"))
def grep_lines(v: Views):
    return _shown_bytes(lines.grep_lines(v.files, "TION", ignore_case=True))


SEARCHED = r"(token|secret|passw(or)?d)\w*\s*[:=]|licen[cs]e"


@query("grep_lines_indexed", _grep_sql(f"(?i){SEARCHED}"))
def grep_lines_indexed(v: Views):
    path = work_folder(v.spark, "gram-index")
    drop_at_end(v.spark, path)
    gram_index.write_file_index(v.files, path, blocks=16)
    return _shown_bytes(gram_index.grep_indexed(v.spark, path, SEARCHED, ignore_case=True))


ENTRIES = f"""{FILES}, e as (select distinct task_id, depth,
    case when depth = 0 then '.' else array_to_string(parts[1:depth], '/') end as path,
    case when depth = 0 then task_id else parts[depth] end as name, depth < len(parts) as is_dir
  from (select task_id, {PARTS} as parts, unnest(range(0, len({PARTS}) + 1)) as depth from f)
  where not list_has_any(case when depth < len(parts) then parts[1:depth] else parts[1:depth - 1] end, {IGNORED}))"""


PATHS_FOUND = (
    f"{ENTRIES} select task_id, path, is_dir from e where regexp_matches(path, '^src/[^/]*/doc[^/]*\\.[jp][^/]*$')"
)


@query("search_paths", PATHS_FOUND)
def search_paths(v: Views):
    return lines.search_paths(v.files, "**/src/*/doc*.[jp]*")


@query("search_paths_indexed", PATHS_FOUND)
def search_paths_indexed(v: Views):
    path = work_folder(v.spark, "gram-index")
    drop_at_end(v.spark, path)
    gram_index.write_path_index(v.files, path, blocks=16)
    return gram_index.search_indexed(v.spark, path, "**/src/*/doc*.[jp]*")


@query(
    "search_names",
    f"{ENTRIES} select task_id, path, is_dir from e where regexp_matches(name, '^[^/]?n[^/]*$')",
)
def search_names(v: Views):
    return lines.search_paths(v.files, "?n*")


@query(
    "list_children",
    f"""{FILES}, k as (select task_id, split_part(substr(path, 5), '/', 1) as name,
        max(contains(substr(path, 5), '/')) as is_dir, max(strlen(content)) as b
      from f where starts_with(path, 'src/') group by all)
    select task_id, case when is_dir then 'D' else 'F' end as kind, name, case when not is_dir then b end as bytes from k""",
)
def list_children(v: Views):
    return lines.list_children(v.files, "src")


@query(
    "list_root",
    f"""{FILES}, k as (select task_id, split_part(path, '/', 1) as name, max(contains(path, '/')) as is_dir,
        max(strlen(content)) as b from f group by all),
      r as (select * from k where not (is_dir and name in (select unnest({IGNORED}))))
    select task_id, case when is_dir then 'D' else 'F' end as kind, name, case when not is_dir then b end as bytes
    from r""",
)
def list_root(v: Views):
    return lines.list_children(v.files)


@query(
    "tree",
    f"""{ENTRIES}, r as (select *, row_number() over (partition by task_id
        order by case when depth = 0 then '' else {WALK} end) as ordinal from e where depth <= 2)
    select task_id, ordinal, path, depth,
      concat(repeat('  ', depth), case when is_dir then '[D] ' else '[F] ' end, name) as shown
    from r""",
)
def tree(v: Views):
    return lines.tree(v.files)


# One request per document: range by id, some automatic, open-ended, reversed, too far or for a missing file.
REQUESTS_SQL = (
    """select doc_id as request_id, source as task_id, f.path as path, start_line, end_line from (
  select doc_id, source, case when doc_id % 13 = 0 then 'no/such.go' else p.path end as path,
    case doc_id % 5 when 0 then 0 when 1 then 3 when 2 then 9 when 3 then 500 else 2 end as start_line,
    case doc_id % 5 when 0 then 0 when 1 then 12 when 2 then 4 when 3 then 0 else 0 end as end_line
  from {documents} d join ("""
    + FILES_SQL.replace("select source as task_id,", "select doc_id as id,").replace("text as content", "1 as one")
    + """) p on d.doc_id = p.id) f"""
)
RANGES = f"""{cte(f=FILES_SQL, q=REQUESTS_SQL)}{SCANNED},
  counts as (select task_id, path, count(*) as total_lines from l group by all),
  s as (select request_id, task_id, path, greatest(start_line, 1) as first,
      case when end_line <= 0 then total_lines else end_line end as last, end_line, total_lines
    from q left join counts using (task_id, path)),
  r as (select *, case when total_lines is null then 'missing' when end_line > 0 and first > end_line then 'bad_range'
      when total_lines < first then 'short' else 'ok' end as status from s)"""


def _requests(v: Views):
    return v.sql(REQUESTS_SQL)


@query(
    "read_range_status",
    f"{RANGES} select request_id, task_id, path, first, last, total_lines, status from r",
)
def read_range_status(v: Views):
    return lines.read_range_status(_requests(v), v.files)


@query(
    "read_range",
    f"""{RANGES} select r.request_id, l.task_id, l.path, l.line, l.text
      from r join l on r.task_id = l.task_id and r.path = l.path and l.line between r.first and r.last
      where r.status = 'ok'""",
)
def read_range(v: Views):
    return lines.read_range(_requests(v), v.files)


@query(
    "ignored_component",
    f"{FILES} select task_id, path, list_has_any({PARTS}, {IGNORED}) as ignored from f",
)
def ignored_component(v: Views):
    return v.files.select("task_id", "path", paths.has_ignored_component("path").alias("ignored"))


# Requested paths: plain, climbing inside, climbing out, absolute inside, ignored, and the root itself.
PATH_REQUESTS_SQL = """select doc_id, concat('/srv/', source) as base,
  case doc_id % 7 when 0 then concat('src/', lang, '/a.go') when 1 then concat('src/../lib/./', lang, '.go')
    when 2 then '../other/x.go' when 3 then concat('/srv/', source, '/src//b.go') when 4 then 'src/vendor/c.go'
    when 5 then '' else '/etc/passwd' end as asked
  from {documents}"""


@query(
    "resolve_path",
    f"""{cte(q=PATH_REQUESTS_SQL)} select doc_id,
      case doc_id % 7 when 0 then concat(base, '/', asked) when 1 then concat(base, replace(replace(asked, 'src/..', ''), '/.', ''))
        when 2 then '/srv/other/x.go' when 3 then concat(base, '/src/b.go') when 4 then concat(base, '/', asked)
        when 5 then base else asked end as resolved,
      case doc_id % 7 when 2 then 'outside' when 6 then 'outside' when 4 then 'ignored' else 'ok' end as status,
      case doc_id % 7 when 0 then asked when 1 then replace(replace(asked, 'src/../', ''), './', '') when 2 then 'x.go'
        when 3 then 'src/b.go' when 4 then asked when 5 then '.' else 'passwd' end as shown
    from q""",
)
def resolve_path(v: Views):
    return v.sql(PATH_REQUESTS_SQL).select(
        "doc_id",
        paths.resolve_path("base", "asked").alias("resolved"),
        paths.resolve_status("base", "asked").alias("status"),
        paths.display_path("base", "asked").alias("shown"),
    )


EXCLUDED = """(regexp_matches(path, '^(\\.git|\\.cache|bin|projects|release|frontend/\\.cache|frontend/node_modules|frontend/dist)(/|$)')
  or path in ('data/config.json', 'data/tasks.json') or regexp_matches(lower(path), '\\.(zip|exe)$'))"""


@query("release_scope", f"{FILES} select task_id, path from f where not {EXCLUDED}")
def release_scope(v: Views):
    return scans.release_scope(v.files).select("task_id", "path")


def _placeholder(value: str) -> str:
    return (
        f"(trim({value}) = '' or regexp_matches(lower(trim({value})), '^(replace-with-|your-)') "
        f"or contains(lower({value}), 'placeholder') or starts_with(trim({value}), '$') "
        f"or regexp_matches(trim({value}), '^%.*%$'))"
    )


def _field_rule(key: str) -> str:
    p = f"""'(?i)"{key}"\\s*:\\s*"([^"]+)"'"""
    return (
        f"case when regexp_matches(text, {p}) and not {_placeholder(f'regexp_extract(text, {p}, 1)')} "
        f"then 'config_{key}' end"
    )


_SECRETS = f"""{SCANNED}, h as (select task_id, path, line, trim(text) as excerpt, unnest([
    case when regexp_matches(text, 'sk-[A-Za-z0-9_-]{{20,}}') then 'openai_api_key' end,
    {_field_rule('auth_key')}, {_field_rule('api_key')}, {_field_rule('password')},
    case when regexp_matches(text, '(?i)(?:mysql|postgres(?:ql)?|mongodb(?:\\+srv)?)://[^/\\s"''`]+:[^@\\s"''`]+@')
      then 'credential_dsn' end,
    case when regexp_matches(text, 'BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY') then 'private_key' end]) as rule from l),
  secrets as (select * from h where rule is not null)"""
SECRETS = f"{cte(f=SECRET_FILES_SQL)}{_SECRETS}"


@query("secret_scan", f"{SECRETS} select task_id, path, line, rule, excerpt from secrets")
def secret_scan(v: Views):
    return scans.secret_scan(v.secret_files)


@query("secret_scan_table", f"{SECRETS} select task_id, path, line, rule, excerpt from secrets")
def secret_scan_table(v: Views):
    rules = v.spark.createDataFrame(dims.SECRET_RULES, "rule string, pattern string, value_group int")
    return rule_tables.secret_scan_table(v.secret_files, rules)


@query(
    "secret_gate",
    f"""{SECRETS} select a.task_id, a.file_count, coalesce(b.n, 0) as secrets, b.n is null as passes
    from (select task_id, count(*) as file_count from f where not {EXCLUDED} group by all) a
    left join (select task_id, count(*) as n from secrets where not {EXCLUDED} group by all) b using (task_id)""",
)
def secret_gate(v: Views):
    return scans.secret_gate(v.secret_files)


@query(
    "is_placeholder",
    f"""{cte(f=SECRET_FILES_SQL)}{SCANNED}, x as (select regexp_extract(text, ':\\s*"([^"]*)"', 1) as value from l
      where regexp_matches(text, '"\\s*:\\s*"'))
    select value, {_placeholder('value')} as placeholder, count(*) as n from x group by all""",
)
def is_placeholder(v: Views):
    found = lines.source_lines(v.secret_files, "scanner").filter(F.col("text").rlike(r'"\s*:\s*"'))
    value = F.regexp_extract("text", r':\s*"([^"]*)"', 1)
    return (
        found.select(value.alias("value"))
        .withColumn("placeholder", labels.is_placeholder("value"))
        .groupBy("value", "placeholder")
        .agg(F.count("*").alias("n"))
    )


def _entries(v: Views):
    directories = v.secret_files.select(
        "task_id",
        F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/")).alias("path"),
        F.lit(True).alias("is_dir"),
        F.lit("").alias("content"),
    ).distinct()
    return v.secret_files.withColumn("is_dir", F.lit(False)).unionByName(directories)


_DIRECTORIES = ", dirs as (select distinct task_id, split_part(path, '/', 1) as path from f)"


@query(
    "validate_archive_entries",
    f"""{SECRETS}{_DIRECTORIES} select a.task_id, a.file_count, a.bad + coalesce(c.n, 0) as unexpected_count,
      coalesce(b.n, 0) as secret_count
    from (select task_id, count(*) as file_count, count(*) filter ({EXCLUDED}) as bad from f group by all) a
    left join (select task_id, count(*) as n from secrets where not {EXCLUDED} group by all) b using (task_id)
    left join (select task_id, count(*) as n from dirs where path = 'release' group by all) c using (task_id)""",
)
def validate_archive_entries(v: Views):
    return scans.archive_summary(_entries(v))


@query(
    "unexpected_entries",
    f"""{cte(f=SECRET_FILES_SQL)}{_DIRECTORIES} select task_id, path from f where {EXCLUDED}
    union all select task_id, path from dirs where path = 'release'""",
)
def unexpected_entries(v: Views):
    return scans.unexpected_entries(_entries(v))


_ROUTES_SQL = ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in dims.ROUTE_RULES)


ROUTES_FOUND = f"""{cte(f=ROUTE_FILES_SQL)}{SCANNED}, rules(framework, pattern) as (values {_ROUTES_SQL}),
  x as (select task_id, path, line, framework, text,
    upper(regexp_extract(regexp_extract(text, pattern, 0), '(?i)(get|post|put|delete|patch)', 1)) as verb
    from l join rules on regexp_matches(text, pattern))
select task_id, path, line, framework, case when verb = '' then 'ANY' else verb end as method,
  regexp_extract(text, '["''](/[^"'']*)["'']', 1) as route from x"""


@query("route_candidates", ROUTES_FOUND)
def route_candidates(v: Views):
    return scans.route_candidates(v.route_files)


@query("route_candidates_table", ROUTES_FOUND)
def route_candidates_table(v: Views):
    rules = v.spark.createDataFrame(dims.ROUTE_RULES, "framework string, pattern string")
    return rule_tables.route_candidates_table(v.route_files, rules)


@query(
    "order_and_page",
    f"""{SECRETS} select task_id, path, line, rule, row_number() over (order by task_id, path, line, rule) as ordinal
    from secrets qualify ordinal between 101 and 150""",
)
def order_and_page(v: Views):
    found = scans.secret_scan(v.secret_files).select("task_id", "path", "line", "rule")
    page = found.orderBy("task_id", "path", "line", "rule").limit(150)
    # The page is already cut to 150 rows, so numbering it in one task is bounded.
    ordinal = F.row_number().over(Window.orderBy("task_id", "path", "line", "rule"))
    return page.withColumn("ordinal", ordinal).filter(F.col("ordinal") > 100)

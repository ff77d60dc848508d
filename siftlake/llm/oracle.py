"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from siftlake.llm.host_rank import BLOCK_AT, DAMPING, DIGITS, LINK, LOWER, ROUNDS, RULES, UPPER

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = rf"""
with dw as (
  select doc_id, regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (
  select coalesce(cast(item_id as varchar), '') item,
    regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') k
  from (select item, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i
        from bw where len(w) > 0)),
docwin as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i
        from dw, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, i, d.n, item from docwin d join win w on d.n = w.n and d.k = w.k),
hits as (select doc_id, count(distinct p) n_hit
  from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
items as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) names
  from hit group by doc_id)
select dw.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hits using (doc_id) left join items using (doc_id)
"""

LINE_QUALITY = rf"""
with d as (
  select doc_id, coalesce(source, '') host, coalesce(text, '') t, {WORDS} w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from documents),
win as (
  select doc_id, i, count(*) over (partition by doc_id, k) c
  from (select doc_id, i, array_to_string(w[i:i + 7], ' ') k
        from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8))),
rep as (
  select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from win where c > 1)
  group by doc_id),
line as (
  select doc_id, host, t,
    trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) line,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n
  from (select doc_id, host, t, unnest(lines) x from d)),
freq as (
  select host, line from (select host, line, count(distinct t) c from line group by host, line)
  join (select host, count(distinct t) texts from d group by host) using (host)
  where c > 20 and c > least(texts * 0.001, 1000)),
gone as (
  select doc_id, count(*) n_lines, sum(n) n_words from line join freq using (host, line) group by doc_id),
b as (
  select d.doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
    len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
    coalesce(gone.n_lines, 0) n_removed_lines, coalesce(gone.n_words, 0) n_removed_words
  from d left join rep using (doc_id) left join gone using (doc_id)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, n_words - n_removed_words rest from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
  n_removed_words, not base_failed and not (n_removed_words > 0 and ((rest < 20 and rest < n_removed_words) or rest < n_words * 0.2)) kept
from v
"""

NEAR_DUP = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({LOWER_TEXT}, '[^\x20\x09-\x0D]+') w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
size as (select doc_id, count(*) n from sh group by doc_id),
both_ as (
  select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id),
link as (
  select a, b from both_ join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (
  select doc_id n, doc_id m from d
  union
  select reach.n, edge.b from reach join edge on reach.m = edge.a)
select doc_id, coalesce(size.n, 0) n_shingles, c.component_id, doc_id = c.component_id kept
from d left join size using (doc_id) join (select n, min(m) component_id from reach group by n) c on c.n = doc_id
"""

LINE_RUNS = rf"""
with d as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) lines from documents),
l as (
  select doc_id, i - 1 raw, lines[i] line, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) w
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) i from d)),
nb as (
  select *, row_number() over (partition by doc_id order by raw) pos, sum(w) over (partition by doc_id order by raw) c
  from l where w > 0),
fit as (
  select a.doc_id, a.pos s, b.pos e from nb a join nb b
    on a.doc_id = b.doc_id and b.pos >= a.pos and b.c >= a.c - a.w + 50),
run as (
  select doc_id, s, min(e) e from fit group by doc_id, s
  union
  select doc_id, max(s), e from fit group by doc_id, e),
keyed as (
  select run.doc_id, s, e, string_agg(line, chr(10) order by pos) k
  from run join nb on nb.doc_id = run.doc_id and nb.pos between s and e group by run.doc_id, s, e),
later as (
  select doc_id, s, e from (select *, row_number() over (partition by k order by doc_id, s) r from keyed) where r > 1),
gone as (
  select distinct nb.doc_id, raw from later join nb on nb.doc_id = later.doc_id and nb.pos between s and e),
removed as (
  select doc_id, count(*) n, string_agg(raw, ',' order by raw) places from gone group by doc_id),
clean as (
  select l.doc_id, string_agg(line, chr(10) order by l.raw) t
  from l left join gone on gone.doc_id = l.doc_id and gone.raw = l.raw where gone.raw is null group by l.doc_id)
select d.doc_id, len(lines) n_lines, coalesce(n, 0) n_removed_lines, coalesce(places, '') removed_lines,
  length(coalesce(clean.t, '')) n_chars, sha256(coalesce(clean.t, '')) clean_sha256
from d left join removed using (doc_id) left join clean using (doc_id)
"""


def _host_rank() -> str:
    """Rules, and both propagations as series over the links."""
    cases = " ".join(
        f"when (host = '{h}' or suffix(host, '.{h}')) and prefix(path, '/{p}') then '{v} {r}'"
        for v, r in sorted(RULES, key=lambda x: -len(x[1]))
        for h, _, p in [r.partition("/")]
    )
    link = LINK.replace("'", "''")
    return f"""
with recursive p as (
  select page_id, coalesce(html, '') html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path
  from pages),
r as (select *, case {cases} end rule from p),
link as materialized (
  select src, dst, count(*) n from (select host src,
    translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') dst from p)
  where src != '' and src != dst group by src, dst),
own as (
  select host, count(*) pages, count(*) filter (rule like 'allow %') allowed, count(*) filter (rule like 'block %') blocked
  from r group by host),
seed as materialized (
  select host, allowed / pages good, blocked / pages bad from own
  union all
  select distinct dst, 0, 0 from link where dst not in (select host from own)),
edge as materialized (
  select 'trust' kind, src a, dst b, n / sum(n) over (partition by src) part from link
  union all
  select 'distrust', dst, src, n / sum(n) over (partition by dst) from link),
walk as (
  select 0 k, kind, host, {1 - DAMPING} * seed term
  from (select 'trust' kind, host, good seed from seed union all select 'distrust', host, bad from seed) where seed > 0
  union all
  select k + 1, kind, b, {DAMPING} * sum(part * term) from walk join (select kind kind2, * exclude (kind) from edge)
    on kind2 = kind and a = host where k < {ROUNDS} group by k, kind, b),
score as (
  select host, good, bad, coalesce(sum(term) filter (kind = 'trust'), 0) trust,
    coalesce(sum(term) filter (kind = 'distrust'), 0) distrust
  from seed left join walk using (host) group by host, good, bad),
share as materialized (
  select *, case when greatest(distrust, bad) > 0
    then round(greatest(distrust, bad) / (greatest(distrust, bad) + greatest(trust, good)), 6) else 0 end share from score),
led as (
  select src host, sum(n) filter (share >= {BLOCK_AT}) / sum(n) led from link join share on host = dst group by src)
select page_id, r.host, path, split_part(rule, ' ', 2) rule,
  coalesce(split_part(rule, ' ', 1),
    case when share >= {BLOCK_AT} and greatest(bad, coalesce(led, 0)) >= {BLOCK_AT} then 'block' else 'allow' end) verdict,
  round(trust, {DIGITS}) trust, round(distrust, {DIGITS}) distrust
from r join share using (host) left join led using (host)
"""


LEXICAL_SEARCH = rf"""
with d as (
  select row_number() over () id, doc_id,
    regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
whole as (select count(*)::bigint n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
q as (
  select distinct item_id, unnest(regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) term
  from benchmark),
tf as (select id, term, count(*)::bigint tf from (select id, unnest(w) term from d) group by id, term),
weight as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint w
  from tf, whole group by term),
m as (select id, doc_id, 100 - 90 + ((90 * len(w)::bigint * n_docs) // n_terms) m from d, whole where len(w) > 0),
score as (
  select item_id, id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join tf using (term) join weight using (term) join m using (id) group by item_id, id),
ranked as (
  select item_id, doc_id, score,
    row_number() over (partition by item_id order by score desc, doc_id nulls last)::int "rank"
  from score join m using (id) where score > 0)
select item_id, "rank", doc_id, score from ranked where "rank" <= 10
"""


ORACLE = {
    "op13_lexical_search": LEXICAL_SEARCH,
    "op3_decontamination": DECONTAMINATION,
    "op6_line_quality": LINE_QUALITY,
    "op7_near_dup": NEAR_DUP,
    "op9_line_runs": LINE_RUNS,
    "op10_host_rank": _host_rank(),
}

"""DuckDB counterparts of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from headwise.llm.host_trust import DAMPING_PERCENT, ROUNDS, RULES, SCALE

SQL: dict[str, str] = {}

# --- op1: every query against every row, in whole numbers
SQL["op1_impact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024.0::double * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as int) as rank, vec_id, score from r where k <= 10"""

# --- op2: the walks as a chain of common table expressions, one per round
_HOST = "translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or host like '%.{host}') and starts_with(path, '{path}'))"


def _case(value) -> str:
    return "case " + " ".join(f"when {_fits(h, p)} then '{value(v, h, p)}'" for v, h, p in _LONGEST) + " end"


def _url_trust() -> str:
    steps = [f"""judged as (
  select *, {_case(lambda v, h, p: h + p)} as rule, {_case(lambda v, h, p: v)} as rule_verdict from (
    select page_id, html, {_HOST.format(u='url')} as host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages))""", f"""linked as (
  select host as src, {_HOST.format(u='link')} as dst, count(*) as n from (
    select distinct page_id, rid, host, {_HOST.format(u='raw')} as dst_host, {_HOST.format(u='raw')} as link_host,
      'x://' || {_HOST.format(u='raw')} as link from (
        select page_id, row_number() over () as rid, host,
          unnest(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''>]+)', 1),
            lambda r: case when starts_with(r, '//') then 'x:' || r else r end)) as raw
        from judged)) group by 1, 2)""", """links as (select * from linked where src <> '' and dst <> '' and src <> dst)""", """hosts as (
  select host from judged union select dst from links)""", """above as (
  select distinct array_to_string(list_slice(l, i, len(l)), '.') as child, array_to_string(list_slice(l, i + 1, len(l)), '.') as parent
  from (select l, unnest(range(1, len(l) - 1)) as i from (select string_split(host, '.') as l from hosts) where len(l) >= 3))""",
        """edges as (
  select src, dst, cast(sum(n) as bigint) as n from (
    select src, dst, n from links union all select child, parent, 1 from above union all select parent, child, 1 from above)
  group by 1, 2)""", """moves as (
  select src as host, dst as target, n, sum(n) over (partition by src) as whole, true as good from edges
  union all select dst, src, n, sum(n) over (partition by dst), false from edges)""", f"""seeds as (
  select host, coalesce(cast(good as hugeint) * {SCALE} // nullif(cast(sum(good) over () as hugeint), 0), 0) as trust,
    coalesce(cast(bad as hugeint) * {SCALE} // nullif(cast(sum(bad) over () as hugeint), 0), 0) as distrust
  from (select host, sum(good) as good, sum(bad) as bad from (
          select host, cast(coalesce(rule_verdict = 'allow', false) as int) as good,
            cast(coalesce(rule_verdict = 'block', false) as int) as bad from judged where host <> ''
          union all values {', '.join(f"('{h}', {int(v == 'allow')}, {int(v == 'block')})" for v, h, _ in RULES)}) group by 1))""", """starts as (
  select h.host, coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust
  from (select src as host from edges union select dst from edges union select host from seeds) h left join seeds using (host))"""]
    last = "starts"
    for k in range(ROUNDS):
        steps.append(f"""r{k} as (
  select s.host, s.trust * {100 - DAMPING_PERCENT} // 100 + coalesce(a.trust, 0) as trust,
    s.distrust * {100 - DAMPING_PERCENT} // 100 + coalesce(a.distrust, 0) as distrust
  from starts s left join (
    select target, sum(case when good then trust * n * {DAMPING_PERCENT} // (whole * 100) end) as trust,
      sum(case when not good then distrust * n * {DAMPING_PERCENT} // (whole * 100) end) as distrust
    from moves join {last} using (host) group by 1) a on s.host = a.target)""")
        last = f"r{k}"
    return "with " + ",\n".join(steps) + f"""
select page_id, j.host, path, rule, coalesce(rule_verdict, case when coalesce(distrust > trust, false) then 'block' else 'allow' end) as verdict,
  cast(trust as bigint) as trust, cast(distrust as bigint) as distrust
from judged j left join {last} using (host)"""


SQL["op2_url_trust"] = _url_trust()

# --- op3: all pairs of a label, and the closure of the links
SQL["op3_collision_dedup"] = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach(u, w) as (select u, w from p union select r.u, p.w from reach r join p on r.w = p.u),
c as (select u, min(w) as least from reach group by 1),
n as (select u, count(*) as links from p group by 1)
select vec_id, coalesce(links, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) as kept
from embeddings e left join c on c.u = e.vec_id left join n on n.u = e.vec_id"""

# --- op7: shared shingles of all pairs, and the closure of the links
SQL["op7_adaptive_jaccard"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as l from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(l, i, i + 3), ' ') as g from (
    select doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) as i from w where len(l) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (
  select u, v from (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
                    group by 1, 2) x
  join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * c >= 85 * (nu.n + nv.n - c)),
reach(u, v) as (select u, v from p union select r.u, p.v from reach r join p on r.v = p.u),
c as (select u, min(v) as least from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.u = d.doc_id"""

# --- op13: letters left out by a bitwise crc32, near words by what is left when one letter is taken out
SQL["op13_spelling_variants"] = r"""
with recursive found as (
  select doc_id, w, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{C0}-\x{FF}]+')) as w from documents)
  where length(w) >= 7 group by 1, 2),
bits as (
  select w, n, flatten(list_transform(flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || w, ''),
      lambda c: case when ord(c) < 128 then [ord(c)] else [195, ord(c) - 64] end)),
    lambda b: list_transform(range(8), lambda k: (cast(b as bigint) >> cast(k as int)) & 1))) as l from found),
hashed as (
  select w, n, xor(list_reduce(list_prepend(4294967295, l), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) as h
  from bits),
words as (
  select word, cast(sum(n) as bigint) as n from (
    select n, case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word from hashed)
  where length(word) >= 7 group by 1 having sum(n) >= 2),
shorter as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (
    select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n from shorter a join shorter b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.d = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.d = b.word),
best as (
  select word, cast(count(*) as bigint) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by 1),
judged as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form,
    case when other_n >= 10 * w.n then other_n end as form_n from words w left join best b on b.word = w.word),
walk(word, here) as (
  select word, word from judged union all select walk.word, form from walk join judged on judged.word = walk.here where form is not null),
ends as (select walk.word, here as root from walk join judged on judged.word = walk.here where form is null)
select j.word, form, root, n, n_near, form_n from judged j join ends e on e.word = j.word"""

"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat import END, SEP, START
from .linkgraph import DAMPING, ROUNDS, RULES, THRESHOLD
from .mixing import CAP, PICKS, WEIGHTS
from .topk import EVERY, SCALE, TOP


def mixing_sql(seed: str = "mix") -> str:
    """The mix by plain window sums over all documents of a source, one block for each pick."""
    weight = "case (row_number() over (order by source is null, encode(source)) - 1) % 3 " + " ".join(f"when {i} then {w}.0" for i, w in enumerate(WEIGHTS)) + " end"
    key = f"(cast('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0"
    out = f"""with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size, {key} u from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, {weight} w, source_size * {CAP}.0 most from s),
c as (select *, coalesce(sum(most) over p, 0) capped, sum(w) over () - coalesce(sum(w) over p, 0) w_left, sum(source_size) over () total from w
      window p as (order by most / w, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
l as (select *, max(case when (total - capped) / w_left * w <= most then (total - capped) / w_left end) over () level from c),
t as (select source, source_size, coalesce(least(most, level * w), 0.0)::double target from l),
k as (select source, length(bin(size)) m, cast(sum(size) as bigint) words from d group by all),
i as (select k.*, target, (target - {CAP}.0 * coalesce(sum(words) over (a rows between unbounded preceding and 1 preceding), 0)) /
       nullif(sum(words * m) over (a rows between current row and unbounded following), 0) lev
      from k join t on k.source is not distinct from t.source window a as (partition by k.source order by m desc)),
v as (select source, max(case when lev * m <= {CAP}.0 then lev end)::double lev from i group by source),
x as (select d.doc_id, d.source, size, u, source_size, target, coalesce(least({CAP}.0::double, lev * length(bin(size))), {CAP}.0)::double want
      from d join t on d.source is not distinct from t.source join v on d.source is not distinct from v.source),
y as (select *, cast(floor(want + 1e-9::double) as bigint) copies, case when size > 0 then greatest(want - floor(want + 1e-9::double), 0.0) else 0.0 end::double p from x),
q as (select *, case when p > 0 then u / (1 - u) / (p / (1 - p)) end as rank, greatest(target - sum(size * copies) over (partition by source), 0.0)::double gap from y),
f as (select *, coalesce(p > 0 and sum(case when p > 0 then size else 0 end) over (partition by source order by rank nulls last) <= gap, false) taken from q),
r0 as (select * exclude gap, gap - sum(case when taken then size else 0 end) over (partition by source) gap from f)"""
    for k in range(PICKS):
        out += f""",
o{k} as (select *, p > 0 and not taken and abs(size - gap) < gap may from r{k}),
n{k} as (select *, may and dense_rank() over (partition by source order by may desc, abs(size - gap), rank, size) = 1 best from o{k}),
m{k} as (select *, best and abs(gap - sum(case when best then size else 0 end) over (partition by source)) < gap now from n{k}),
r{k + 1} as (select doc_id, source, size, source_size, target, copies, p, rank, taken or now taken, gap - sum(case when now then size else 0 end) over (partition by source) gap from m{k})"""
    return out + f"""
select doc_id, size, source_size, target, cast(size * (copies + case when taken then 1 else 0 end) as bigint) taken from r{PICKS}"""


TOPK_SQL = f"""with v as (select row_number() over () pos, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.pos own, q.vec_id query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score from v q join v c on q.pos <> c.pos and len(q.v) = len(c.v) where q.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by own order by score desc, vec_id) pos from s)
select query_id, cast(pos as integer) rank, vec_id, score from r where pos <= {TOP}"""

PROBE = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = f"""with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  cast(sum(case when r = 'assistant' then length(x) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn nulls first, r, x), '')) loss_sha256,
  cast(sum({len(START + SEP + END) + 1} + length(r) + length(x) + len(regexp_extract_all(r || ' ' || x, '<\\\\*\\|'))) as bigint) formatted_chars
from c group by conv_id"""


def linkgraph_sql() -> str:
    """The rules as a chain of cases, and the propagation as one block for each round."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host = lambda rest: f"translate(regexp_extract({rest}, '^[^/?#]*'), {lower})"
    after = lambda url: f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    out = f"""with p as (select page_id, html, {host('rest')} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from (select *, coalesce({after('url')}, '') rest from pages)),
j as (select page_id, host, path, case {" ".join(f"when {fits(r)} then '{r}'" for _, r in rules)} end rule, case {" ".join(f"when {fits(r)} then '{v}'" for v, r in rules)} end ruled from p),
h as (select host src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1)) href from p),
l as (select src, {host(after("href"))} dst from (select src, case when starts_with(href, '//') then 'http:' || href else href end href from h)),
e as (select src, dst, count(*) n from l where src <> '' and dst <> '' and src <> dst group by src, dst),
b as (select true good, src, dst, n from e union all select false, dst, src, n from e),
w as (select good, src host, dst, n / sum(n) over (partition by good, src) share from b),
s as (select ruled = 'allow' good, host, count(*) n from j where ruled is not null group by all),
r0 as (select good, host, n * ((1 - {DAMPING}::double) / (select sum(n) from s)) mass from s)"""
    for k in range(ROUNDS):
        out += f""",
r{k + 1} as (select good, host, sum(mass) mass from (select * from r0 union all select good, w.dst, mass * share * {DAMPING}::double from r{k} join w using (good, host)) group by good, host)"""
    return (
        out
        + f""",
v as (select host, coalesce(sum(mass) filter (good), 0.0) trust, coalesce(sum(mass) filter (not good), 0.0) distrust from r{ROUNDS} group by host)
select page_id, host, path, rule, coalesce(ruled, case when coalesce(distrust, 0) > coalesce(trust, 0) * {THRESHOLD} then 'block' else 'allow' end) verdict,
  round(coalesce(trust, 0.0)::double, 9) trust, round(coalesce(distrust, 0.0)::double, 9) distrust from j left join v using (host)"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mixing": mixing_sql(), "op3_impact_topk": TOPK_SQL, "op5_linkgraph_filter": linkgraph_sql(), "op7_chat_format": CHAT_SQL}

"""DuckDB SQL that computes what the queries of this subpackage return."""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
g as (
  select html, max(page_id) as newest, count(*) as n from p where payload_bytes >= 1000 group by html having count(*) > 1)
select p.page_id, p.payload_bytes, sha1(p.html) as payload_digest,
  case when g.newest is not null and p.page_id is distinct from g.newest then 'revisit' else 'response' end as record_type,
  case when g.newest is not null and p.page_id is distinct from g.newest then g.newest end as refers_to
from p left join g on p.html = g.html
"""

OP8 = f"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (
  select *, {_LOW.format(f"trim(line, {_WS})")} as key from l),
f as (
  select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (key in (select key from f)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (key not in (select key from f)), '')) as kept_sha256
from k group by r
"""

OP9 = r"""
with z as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) as digest, row_number() over () as rid from documents),
s0 as (
  select source, sum(size)::bigint as source_size from z group by source),
s1 as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as w,
    (2 * source_size)::double as cap, 1.5::double * (sum(source_size) over ())::double as want from s0),
s2 as (
  select *, cap / w as ratio from s1),
s3 as (
  select *, (want - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level from s2),
s4 as (
  select *, max(level) over () as lv from s3),
s5 as (
  select *, least(cap, lv * w) as target from s4),
src as (
  select source, source_size, target, coalesce(sum(target) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    row_number() over (order by source nulls last) as number, count(*) over () as sources from s5),
tot as (select sum(target) as words from src),
t as (
  select z.*, p.turn, src.source_size, src.target,
    p.turn * src.source_size + coalesce(sum(size) over (partition by z.source, p.turn order by md5(p.turn || '|' || coalesce(z.doc_id::varchar, '') || '|' || digest), z.doc_id, rid rows between unbounded preceding and 1 preceding), 0) as lo
  from z join src on z.source is not distinct from src.source, (select unnest([0, 1]) as turn) p where size > 0),
pieces as (
  select rid, source, lo::bigint as lo, least(lo + size, floor(target))::bigint as hi from t where lo < floor(target)),
blocks as (
  select rid, source, rank, least(hi, (rank + 1) * 256) - greatest(lo, rank * 256) as n
  from (select *, unnest(range(lo // 256, (hi - 1) // 256 + 1)) as rank from pieces)),
points as (
  select slot, x - floor(x) as u from (
    select i as slot, i % 1048576 * 0.6180339887498949::double + (i // 1048576) * 0.607787409740351::double as x
    from range((select ceil(words / 256)::bigint from tot)) r(i))),
hit as (
  select src.source, slot, ceil(floor(target) / 256) as need, row_number() over (partition by src.source order by slot) - 1 as rank
  from points, src, tot where target > 0 and u >= before / words and u < (before + target) / words),
got as (
  select source, count(*) as got from hit group by source),
slots as (
  select source, rank, slot from hit where rank < need
  union all
  select source, rank, (select ceil(words / 256)::bigint from tot) + (rank - got) * sources + number - 1 as slot
  from (select *, unnest(range(got, need)) as rank
  from (select src.source, number, sources, coalesce(got, 0) as got, ceil(floor(target) / 256)::bigint as need from src left join got on src.source is not distinct from got.source where target > 0))),
taken as (
  select rid, sum(n) as taken, count(*) as n_pieces, min(slot) as first_slot from blocks join slots on blocks.source is not distinct from slots.source and blocks.rank = slots.rank group by rid)
select doc_id, size, src.source_size, src.target, coalesce(taken, 0)::bigint as taken, coalesce(n_pieces, 0)::bigint as n_pieces, first_slot
from z join src on z.source is not distinct from src.source left join taken using (rid)
"""

OP10 = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as win
  from (select item_id, w, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
m as (
  select r, item_id, i, dw.k from dw join bw on dw.k = bw.k and dw.win = bw.win),
h as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from m) group by r),
it as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join it using (r)
"""

OP3 = r"""
with recursive bits as (
  select i, 0 as k, i::bigint as c from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as l from bits where k = 8),
d as (
  select row_number() over () as r, doc_id,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 10 = 0 as held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as w
  from documents, crc),
t as (
  select r, held_out, unnest(list_prepend(chr(10), w[:-2])) as v, unnest(w) as w from d),
u as (select w, count(*) as c from t where not held_out group by w),
tot as (select sum(c) as n, sum(c) + 0.1::double * (count(*) + 1) as norm from u),
p as (select v, w, count(*) as c from t where not held_out group by v, w),
x as (select v, sum(c)::double as c from p group by v),
s as (
  select t.r, coalesce(u.c, 0) as c, (coalesce(u.c, 0) + 0.1::double) / norm as p1, p.c as cp, x.c as cx
  from t cross join tot left join u on u.w = t.w left join p on p.v = t.v and p.w = t.w left join x on x.v = t.v),
g as (
  select r, count(*) filter (c > 0) as n_known, sum(log10(p1)) as base_score,
    sum(case when cp is not null then -least(round(-log10((cp + 30 * p1) / (cx + 30)) * 4096), 65535) / 4096
      when cx is not null then log10(p1) - round(-log10(30 / (cx + 30)) * 4096) / 4096 else log10(p1) end) as score
  from s group by r)
select doc_id, held_out, len(w)::bigint as n_tokens, n_known, n::bigint as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score
from d join g using (r) cross join tot
"""

OP5 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (
  select vec_id as a, vec_id as c from v
  union
  select p.b, r.c from r join p on r.a = p.a),
g as (select a, min(c) as c from r group by a),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join g on vec_id = g.a left join n on vec_id = n.a
"""

OP6 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
z as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a, b, j = 1 as same from (
    select x.doc_id as a, y.doc_id as b, count(*) / (any_value(zx.n) + any_value(zy.n) - count(*)) as j
    from s x join s y on x.g = y.g and x.doc_id <> y.doc_id join z zx on zx.doc_id = x.doc_id join z zy on zy.doc_id = y.doc_id
    group by 1, 2) where j >= 0.8),
r as (
  select doc_id as a, doc_id as c from z
  union
  select p.b, r.c from r join p on r.a = p.a),
g as (select a, min(c) as c from r group by a),
n as (select a, count(*) as n, min(b) filter (same) as lo from p group by a)
select doc_id, coalesce(c, doc_id) as class_id, least(doc_id, coalesce(lo, doc_id)) as copy_id, coalesce(n, 0)::bigint as n_links, coalesce(c, doc_id) = doc_id as kept
from documents left join g on doc_id = g.a left join n on doc_id = n.a
"""

OP12 = r"""
with recursive bits as (
  select i, 0 as k, i::bigint as c from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as l from bits where k = 8),
d0 as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) as h
  from documents, crc),
d1 as (select *, len(w)::bigint as n, h // 10 as g from d0),
d2 as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from d1),
d as (select *, 1 + (n - a) // (3 + g % 8) as p from d2),
t as (
  select r, n, i, case when a is not null and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as x
  from (select *, unnest(range(n)) as i from d where n > 0)),
m as (
  select s.r, s.i, e.i - s.i as q from t s join t e on s.r = e.r and s.x = e.x and e.i > s.i and 3 * (e.i - s.i) <= s.n),
z as (
  select r, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by r, q order by i) as island from m)
  group by r, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select r, start, length, min(q) as period from z group by r, start, length),
best as (
  select r, count(*) as n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-(length / period), start, period)) as b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select t.r, string_agg(x, ' ' order by t.i) as words from t left join gone on gone.r = t.r and gone.i = t.i where gone.r is null group by t.r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period, (1000 * b.l // b.p)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from d left join best using (r) left join kept using (r)
"""


def _clustering(rounds: int = 10) -> str:
    """Rounds one after the other; vectors and centroids as rows (id, dimension, value)."""
    near = lambda k: f"""
n{k} as materialized (
  select r, arg_min(cid, (d, cid)) as cid, min(d) as d from (
    select v.r, c.cid, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{k} c on v.j = c.j group by 1, 2) group by r)"""  # noqa: E731
    parts = ["""
e as (
  select row_number() over () as r, vec_id, list_transform(embedding::double[], lambda x: floor(1024 * x)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select r, unnest(range(64)) as j, unnest(x) as x from e),
c0 as materialized (
  select cid, unnest(range(64)) as j, unnest(x) as x from (
    select row_number() over (order by sha256('3:' || vec_id), x) - 1 as cid, x from e qualify cid < 8))"""]
    for k in range(rounds):
        parts.append(near(k))
        parts.append(f"""
m{k} as (
  select cid, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x from n{k} join v using (r) group by 1, 2),
c{k + 1} as materialized (select c.cid, c.j, coalesce(m.x, c.x)::bigint as x from c{k} c left join m{k} m on m.cid = c.cid and m.j = c.j)""")
    parts.append(near(rounds))
    return "with " + ",".join(parts) + f"""
select vec_id, n.cid::int as cluster, n.d as distance, sum(n.d) over (partition by n.cid)::bigint as cluster_inertia, sum(n.d) over ()::bigint as inertia, h.digest as centroid_sha256
from e join n{rounds} n using (r) join (select cid, sha256(string_agg(x::varchar, ',' order by j)) as digest from c{rounds} group by 1) h on h.cid = n.cid
"""


OP13 = _clustering()

SQL = {"op1_warc": OP1, "op3_lm_scoring": OP3, "op5_embedding_near_dedup": OP5, "op6_ngram_jaccard_join": OP6, "op8_line_dedup": OP8, "op9_mixing": OP9, "op10_decontaminate": OP10, "op12_periodic_runs": OP12, "op13_centroid_clustering": OP13}

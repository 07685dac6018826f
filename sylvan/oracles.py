"""DuckDB SQL that computes what the named queries return."""

from __future__ import annotations

from math import comb

from sylvan.queries import GRID, NM, Q, REPS, RUNS, SEED
from sylvan.sources.generators import BULL, TUTTE


def _u(tag: str, *key: str) -> str:
    """The SQL of functions.rng.uniform; key parts are SQL expressions."""
    return f"(cast('0x' || substr(md5(concat_ws('|', '{tag}', {', '.join(f'cast({k} as varchar)' for k in key)})), 1, 13) as bigint) / 4503599627370496.0::double)"


TRADE = """
trade as (
  select c_nationkey::bigint as a, s_nationkey::bigint as b, count(*)::double as w
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey group by 1, 2),
e as (select src, dst, sum(w) as weight from (select a as src, b as dst, w from trade union all select b, a, w from trade) group by 1, 2),
v as (select n_nationkey::bigint as id from nation)"""

FLOW = """
flow as (select lag(user_id) over (order by ts, event_id) as a, user_id as b from events),
e as (select src, dst, sum(w)::double as weight from (select a as src, b as dst, 1 as w from flow where a <> b union all select b, a, 1 from flow where a <> b) group by 1, 2),
v as (select distinct src as id from e)"""

PARTS = """
ps as (select l_partkey as a, l_suppkey + 10000000 as b, count(*)::double as w from lineitem group by 1, 2),
e as (select a as src, b as dst, w as weight from ps union all select b, a, w from ps),
v as (select distinct src as id from e)"""

KNN = """
vec as (select vec_id, embedding::double[] as x from embeddings),
near as (
  select a.vec_id as a, b.vec_id as b, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.x, b.x), 6) desc, b.vec_id) as r
  from vec a join vec b on a.vec_id <> b.vec_id),
pairs as (select distinct least(a, b) as a, greatest(a, b) as b from near where r <= 5),
e as (select a as src, b as dst, 1.0::double as weight from pairs union all select b, a, 1.0::double from pairs),
v as (select vec_id as id from embeddings)"""

BASE = """
deg as (select v.id, coalesce(sum(weight), 0.0)::double as d from v left join e on v.id = e.src group by 1),
cum as (select src, dst, sum(weight) over w - weight as lo, sum(weight) over w as hi from e window w as (partition by src order by dst))"""

SIGNAL = """
y as (
  select v.id, 0 as k, coalesce(m.y, 0.0)::double as y from v left join
    (select c_nationkey::bigint as id, sum(round(c_acctbal * 100)::bigint)::double / count(*) / 100 as y from customer group by 1) m on v.id = m.id)"""


def forest(rate: str, reps: int, doublings: int, p: str = "") -> str:
    """CTEs ending in {p}forest(rep, qi, id, next, root); ``rate`` selects (qi, id, q, sd) with the seed as text;
    ``p`` prefixes the names of graph tables and of these CTEs."""
    arrows = lambda s: f"""
    select s.rep, s.qi, s.id, s.level, c.dst as nxt
    from {s} s join {p}rate r on r.qi = s.qi and r.id = s.id join {p}deg g on g.id = s.id
      left join {p}cum c on c.src = s.id and not ({_u('u', 'r.sd', 's.rep', 's.id', 's.level')} * (r.q + g.d) < r.q)
        and c.lo <= {_u('v', 'r.sd', 's.rep', 's.id', 's.level')} * g.d and {_u('v', 'r.sd', 's.rep', 's.id', 's.level')} * g.d < c.hi"""  # noqa: E731
    double = lambda first: ",\n".join([f"f0 as (select rep, qi, id, coalesce(nxt, id) as t from {first})"] + [f"f{k} as (select x.rep, x.qi, x.id, z.t from f{k - 1} x join f{k - 1} z on x.rep = z.rep and x.qi = z.qi and x.t = z.id)" for k in range(1, doublings + 1)])
    return f"""
{p}rate as ({rate}),
{p}stack as (
  select 0 as round, rep::int as rep, qi, id, 0::bigint as level from range({reps}) t(rep), {p}rate
  union all
  select round + 1, rep, qi, id, level + pop from (
    with s as (select * from {p}stack), a as ({arrows('s')}), {double('a')},
    lp as (select a.rep, a.qi, a.id from a join (select distinct rep, qi, t from f{doublings}) i on a.rep = i.rep and a.qi = i.qi and a.id = i.t where a.nxt is not null)
    select s.round, s.rep, s.qi, s.id, s.level, case when lp.id is null then 0 else 1 end as pop
    from s left join lp on s.rep = lp.rep and s.qi = lp.qi and s.id = lp.id where (select count(*) from lp) > 0)),
{p}last as (select rep, qi, id, level from {p}stack where round = (select max(round) from {p}stack)),
{p}top as ({arrows(p + 'last')}),
{p}forest as (
  with {double(p + 'top')}
  select a.rep, a.qi, a.id, a.nxt as next, f.t as root from {p}top a join f{doublings} f on a.rep = f.rep and a.qi = f.qi and a.id = f.id)"""


def rate(q: str, seed=SEED) -> str:
    return f"select 0 as qi, id, ({q})::double as q, '{seed}' as sd from v"


def grid_rate(indep: bool = False) -> str:
    return " union all ".join(f"select {k} as qi, id, {q}::double as q, '{f'{SEED}.{k}' if indep else SEED}' as sd from v" for k, q in enumerate(GRID))


def sql(*ctes: str, select: str) -> str:
    return "with recursive " + ",".join(ctes) + "\n" + select


def events(high: float, low: float, reps: int = REPS, doublings: int = 5) -> str:
    """CTE events: a step pops the cycles there are, or, if a repetition has none, lets its next root die.
    ``was`` holds the roots before that; rows of the last step have no q."""
    u, v = _u("u", str(SEED), "s.rep", "s.id", "s.level"), _u("v", str(SEED), "s.rep", "s.id", "s.level")
    doubled = ",\n".join(["f0 as (select rep, id, coalesce(nxt, id) as t from a)"] + [f"f{k} as (select x.rep, x.id, z.t from f{k - 1} x join f{k - 1} z on x.rep = z.rep and x.t = z.id)" for k in range(1, doublings + 1)])
    return f"""
steps as (
  select 0 as step, 0 as event, false as fresh, rep::int as rep, id, 0::bigint as level, {high}::double as q, null::bigint as died, null::bigint as was from range({reps}) t(rep), v
  union all
  select * from (
    with s as (select * from steps where q is not null),
    r as (select s.*, {u} / (1 - {u}) * d as star, {v} * d as t, d from s join deg on deg.id = s.id),
    a as (select r.*, c.dst as nxt from r left join cum c on c.src = r.id and not (q > star) and c.lo <= t and t < c.hi),
    {doubled},
    lp as (select distinct a.rep, a.id from a join (select distinct rep, t from f{doublings}) i on a.rep = i.rep and a.id = i.t where a.nxt is not null),
    nx as (select rep, max(case when star >= {low} then star end) as q, arg_max(id, star) filter (star >= {low}) as died from a where nxt is null and rep not in (select rep from lp) group by rep)
    select a.step + 1, case when nx.rep is null then a.event else a.event + 1 end, nx.rep is not null, a.rep, a.id, case when lp.id is null then a.level else a.level + 1 end,
      case when nx.rep is null then a.q else nx.q end, nx.died, f{doublings}.t
    from a join f{doublings} on f{doublings}.rep = a.rep and f{doublings}.id = a.id left join lp on lp.rep = a.rep and lp.id = a.id left join nx on nx.rep = a.rep)),
events as (
  select b.rep, b.event, b.q, b.died as root, count(*) filter (b.was <> e.was) as n_rerooted, count(*) filter (e.id = e.was) as n_roots
  from steps b join steps e on b.fresh and e.fresh and e.rep = b.rep and e.event = b.event + 1 and e.id = b.id where b.q is not null group by b.rep, b.event, b.q, b.died)"""


TREES = (TRADE, BASE, SIGNAL, forest(rate(f"{Q}"), REPS, 5))
VECTOR = (TRADE, BASE, SIGNAL, forest(rate("id * 50.0 + 500"), REPS, 5))
PART = """
part as (select rep, id, root, dense_rank() over (partition by rep order by root)::int as part from forest)"""
SIZE = """
size as (select rep, part, count(*) as size from part group by 1, 2)"""


def jacobi(q: str, rounds: int, graph: str = "e", deg: str = "deg", y: str = "y", name: str = "jac") -> str:
    """{name}(t, id, k, x), the t-th iterate; q is SQL over (id)."""
    return f"""
{name} as (
  select 0 as t, id, k, y as x from {y}
  union all
  select j.t + 1, s.id, s.k, (any_value(({q}) * s.y) + sum(g.weight * j.x)) / any_value(({q}) + d.d)
  from {name} j join {graph} g on g.dst = j.id join {y} s on s.id = g.src and s.k = j.k join {deg} d on d.id = s.id
  where j.t < {rounds} group by j.t, s.id, s.k)"""


def exact(q: str, rounds: int = 400) -> tuple[str, str]:
    return jacobi(q, rounds), f"\nsol as (select id, k, x from jac where t = {rounds})"


_REGION = (
    TRADE, BASE, SIGNAL,
    "\np as (select n_nationkey::bigint as id, n_regionkey::bigint as part from nation)",
    "\nre as (select a.part as src, b.part as dst, sum(weight) as weight from e join p a on a.id = e.src join p b on b.id = e.dst where a.part <> b.part group by 1, 2)",
    "\nrd as (select src as id, sum(weight) as d from re group by 1)",
)
_MS = (*_REGION, "\nry as (select part as id, 0 as k, avg(y) as y, count(*) as n from p join y on p.id = y.id group by 1)", jacobi(f"{Q} * s.n", 400, "re", "rd", "ry"))
_MS_SELECT = "select p.id, 0 as k, round(x, 6) as x from p join jac on p.part = jac.id where t = 400"

_CHAIN = ["\nc1 as (select run, qi, m as last, id, root as pos from maps)"] + [
    f"\nc{k} as (select a.run, a.qi, b.m as last, a.id, b.root as pos from c{k - 1} a join maps b on a.run = b.run and a.qi = b.qi and a.pos = b.id where b.m > a.last)" for k in range(2, NM + 1)
]
_COUNTS = "\nns as (" + " union all ".join(f"select run, qi, {k} as k, count(*) filter (id = pos) / {c}.0::double as cnt from c{k} group by 1, 2" for k, c in zip(range(1, NM + 1), (NM, NM * (NM - 1) // 2, 1))) + ")"
_SUBSETS = f"(case k when 1 then {NM}.0 when 2 then {NM * (NM - 1) // 2}.0 else 1.0 end)::double"
assert NM == 3


def maps(runs: int, nm: int = NM, indep: bool = False) -> tuple[str, ...]:
    return (TRADE, BASE, forest(grid_rate(indep), runs * nm, 5), f"\nmaps as (select (rep // {nm})::int as run, (rep % {nm})::int as m, qi, id, root from forest)")


_FLOW_CHAIN = ["\nc1 as (select rep as last, id, root as pos from forest)"] + [
    f"\nc{k} as (select b.rep as last, a.id, b.root as pos from c{k - 1} a join forest b on a.pos = b.id where b.rep > a.last)" for k in range(2, 7)
]
_FLOW_COUNTS = " union all ".join(f"select 0 as run, 0 as q_index, {k} as k, round(count(*) filter (id = pos) / {comb(6, k)}::double, 6) as count from c{k}" for k in range(1, 7))

_PATHS = """
pth as (
  select rep, id, next, root, [id] as path, 0::bigint as depth from forest where next is null
  union all
  select f.rep, f.id, f.next, f.root, list_append(p.path, f.id), p.depth + 1 from forest f join pth p on f.rep = p.rep and f.next = p.id)"""
_TOUR = (
    PARTS, BASE, forest(rate("20.0"), 2, 12), _PATHS, "\nsz as (select rep, u as id, count(*) as size from (select rep, unnest(path) as u from pth) group by 1, 2)",
    """
tour as (
  select p.rep, p.id, p.next, p.root, 2 * pre - depth as enter, 2 * pre - depth + 2 * size - 1 as leave, size, depth
  from (select *, row_number() over (partition by rep, root order by path) - 1 as pre from pth) p join sz on sz.rep = p.rep and sz.id = p.id)""",
)
_QVAL = f"(list_value({', '.join(f'{q}::double' for q in GRID)}))[qi + 1]"
_COLLECT = (*maps(RUNS), *_CHAIN, _COUNTS, f"\nag as (select qi, k, greatest(sum(cnt) / {RUNS}, 1.0) / 25 as y, var_pop(cnt) as vp from ns group by 1, 2)")

_SSL = (
    KNN, BASE,
    f"\ny as (select v.id, l.k, case when b.label = l.k and {_u('train', str(SEED), 'v.id')} < 0.3 then 1.0 else 0.0 end::double as y from v join embeddings b on b.vec_id = v.id cross join (select distinct label as k from embeddings where {_u('train', str(SEED), 'vec_id')} < 0.3) l)",
    *exact("1.0", 200),
    "\nlab as (select id, arg_max(k, (round(x, 9), -k)) as label from sol group by id)",
)

_FIRST = "(select min(year(o_orderdate)) from orders)"
_YEARS = "(select max(year(o_orderdate)) - min(year(o_orderdate)) + 1 from orders)"
_CALENDAR = f"""
v as (select id from range(12 * {_YEARS}) t(id)),
half as (select id as src, id + 1 as dst from v where id % 12 < 11 union all select id, id + 12 from v where id < 12 * ({_YEARS} - 1)),
e as (select src, dst, 1.0::double as weight from half union all select dst, src, 1.0::double from half)"""


_DENOISE = (
    _CALENDAR, BASE, f"\ny as (select ((year(o_orderdate) - {_FIRST}) * 12 + month(o_orderdate) - 1)::bigint as id, 0 as k, count(*)::double as y from orders group by 1)",
    "\nyz as (select v.id, 0 as k, coalesce(y, 0.0) as y from v left join y on y.id = v.id)", jacobi("0.4", 400, y="yz"), "\nsol as (select id, k, x from jac where t = 400)", forest(rate("0.4"), REPS, 7), PART,
    f"\nv1 as (select f.id, sum(y.y) / {REPS} as x from forest f join y on f.root = y.id group by 1)",
    "\nz as (select rep, part, avg(y) as z from part join yz on part.id = yz.id group by 1, 2)",
    f"\nv2 as (select id, sum(z) / {REPS} as x from part join z on part.rep = z.rep and part.part = z.part group by 1)",
)

# the quotient by the first forest, and a forest on it
_LEVEL1 = (
    TRADE, BASE, forest(rate(f"{Q}"), 1, 5), PART,
    "\nxe as (select a.part::bigint as src, b.part::bigint as dst, sum(weight) as weight from e join part a on a.id = e.src join part b on b.id = e.dst where a.part <> b.part group by 1, 2)",
    "\nxv as (select distinct part::bigint as id from part)",
    "\nxdeg as (select xv.id, coalesce(sum(weight), 0.0)::double as d from xv left join xe on xv.id = xe.src group by 1)",
    "\nxcum as (select src, dst, sum(weight) over w - weight as lo, sum(weight) over w as hi from xe window w as (partition by src order by dst))",
    forest(f"select 0 as qi, id, {Q}::double as q, '{SEED + 1}' as sd from xv", 1, 5, "x"),
    "\nxpart as (select id, dense_rank() over (order by root) as part from xforest)",
)

_ALIAS = """
sh as (
  select src, dst, weight * count(*) over (partition by src) / sum(weight) over (partition by src) as share, row_number() over (partition by src order by dst) - 1 as slot from e),
cl as (
  select *, share >= 1 as rich, coalesce(sum(abs(share - 1)) over (partition by src, share >= 1 order by dst rows between unbounded preceding and 1 preceding), 0) as lo from sh),
ps as (
  select *, round(lo, 9) as s, round(lo + abs(share - 1), 9) as t from cl),
giver as (
  select a.src, a.dst, arg_max(b.dst, (b.s, b.dst)) as giver from ps a join ps b on a.src = b.src and not a.rich and b.rich and b.s <= a.s group by 1, 2),
reach as (
  select a.src, a.dst, min(b.t) as reached, (select min(c.dst) from ps c where c.src = a.src and c.rich and c.dst > a.dst) as next_rich
  from ps a join ps b on a.src = b.src and a.rich and not b.rich and b.t >= a.t group by 1, 2),
al as (
  select ps.src, slot::int as slot, ps.dst,
    case when not rich then share when next_rich is not null and reached > t then 1 + t - reached else 1.0 end as prob,
    case when not rich then coalesce(giver, ps.dst) when next_rich is not null and reached > t then next_rich else ps.dst end as alias
  from ps left join giver on giver.src = ps.src and giver.dst = ps.dst left join reach on reach.src = ps.src and reach.dst = ps.dst)"""
_DRAWS = "\ndr as (select draw::int as draw, id from range(20) t(draw), v)"
_Z = "\nz as (select rep, part, k, avg(y) as z, sum(y) as s from part join y on part.id = y.id group by 1, 2, 3)"
_EST2 = f"\nest as (select part.id, k, sum(z) / {REPS} as x from part join z on part.rep = z.rep and part.part = z.part group by 1, 2)"
_FOREST_COLS = "select rep, id, next, root from forest"


def times(name: str, s: str) -> str:
    """L x for a table (id, x)."""
    return f"\n{name} as (select s.id, d.d * s.x - sum(e.weight * o.x) as lx from {s} s join deg d on d.id = s.id join e on e.src = s.id join {s} o on o.id = e.dst group by s.id, d.d, s.x)"


_LX = times("lx", "s")


_MONTHS = f"""
mon as (select ((year(o_orderdate) - {_FIRST}) * 12 + month(o_orderdate) - 1)::bigint as id, count(*)::double as x from orders group by 1),
size as (select count(*) // 4 * 4 as n from mon),
x as (select mon.* from mon, size where id < n)"""


def _multigrid() -> str:
    """Two cycles on the path of months: a gradient step, the residual's correction on the path of half the length (by Jacobi), added."""
    alpha, q, parts = 0.6, 0.5, [_MONTHS]
    for half, name in ((1, "a"), (2, "b")):
        parts.append(f"""
{name}e as (select i as src, i + 1 as dst, 1.0::double as weight from range((select n // {half} - 1 from size)) t(i) union all select i + 1, i, 1.0::double from range((select n // {half} - 1 from size)) t(i)),
{name}d as (select src as id, sum(weight) as d from {name}e group by 1)""")
    parts.append("\ny as (select id, x as y from x),\nx0 as (select id, y as x from y)")
    lap = lambda x: f"(select s.id, d.d * s.x - sum(e.weight * o.x) as lx from {x} s join ad d on d.id = s.id join ae e on e.src = s.id join {x} o on o.id = e.dst group by s.id, d.d, s.x)"
    for k in (1, 2):
        parts.append(f"""
g{k} as (select s.id, s.x - {alpha} * (l.lx + {q} * (s.x - y.y)) / d.d as x from x{k - 1} s join y on y.id = s.id join ad d on d.id = s.id join {lap(f"x{k - 1}")} l on l.id = s.id),
r{k} as (select s.id // 2 as id, 0 as k, sum({q} * (y.y - s.x) - l.lx) / {2 * q} as y from g{k} s join y on y.id = s.id join {lap(f"g{k}")} l on l.id = s.id group by 1)""")
        parts.append(jacobi(f"{2 * q}", 150, "be", "bd", f"r{k}", f"j{k}"))
        parts.append(f"\nx{k} as (select g.id, g.x + j.x as x from g{k} g join j{k} j on j.id = g.id // 2 and j.t = 150)")
    return "with recursive " + ",".join(parts) + "\nselect id, round(x, 6) as x from x2"


def _inverse(doublings: int = 13) -> str:
    """CTE inv(qi, i, j, x): (L + q)^-1 for the q of table qs(qi, q), by sums of powers of the Jacobi matrix, doubled."""
    parts = ["\ns0 as materialized (select qi, id as i, id as j, 1.0::double as x from qs, v)", "\np0 as materialized (select qi, src as i, dst as j, weight / (q + d) as x from qs, e join deg on deg.id = e.src)"]
    for k in range(doublings):
        parts.append(f"\ns{k + 1} as materialized (select qi, i, j, sum(x) as x from (select * from s{k} union all select p.qi, p.i, s.j, sum(p.x * s.x) from p{k} p join s{k} s on s.qi = p.qi and s.i = p.j group by all) group by all)")
        parts.append(f"\np{k + 1} as materialized (select a.qi, a.i, b.j, sum(a.x * b.x) as x from p{k} a join p{k} b on b.qi = a.qi and b.i = a.j group by all)")
    parts.append(f"\ninv as (select s.qi, i, j, x / (q + d) as x from s{doublings} s join qs on qs.qi = s.qi join deg on deg.id = s.j)")
    return ",".join(parts)


_CHECK = "\nqs as (select k as qi, lo * power(hi / lo, k / 4.0) as q from range(5) t(k), (select avg(d) / 100 as lo, 2 * max(d) as hi from deg))"


def _path(level: int) -> str:
    n = f"range((select (n >> {level}) - 1 from size)) t(i)"
    return f"select {level} as level, i as src, i + 1 as dst, 1.0::double as weight from {n} union all select {level}, i + 1, i, 1.0::double from {n}"


def _listed(name: str, pairs: list[tuple[int, int]]) -> str:
    return f"select '{name}' as name, a::bigint as a, b::bigint as b from (values {', '.join(map(str, pairs))}) t(a, b)"


SQL = {
    "degree": sql(TRADE, BASE, select="select id, d from deg"),
    "degree_user_flow": sql(FLOW, BASE, select="select id, d from deg"),
    "degree_part_supplier": sql(PARTS, BASE, select="select id, d from deg"),
    "neighbors": sql(PARTS, select="select src as id, count(*) as n_neighbors, string_agg(dst::varchar, ',' order by dst) as neighbors from e group by 1"),
    "laplacian": sql(TRADE, BASE, select="select id as i, id as j, d as v from deg union all select src, dst, -weight from e"),
    "is_directed": "select 2 * count(*) as n_edges, 0::bigint as n_one_way, false as is_directed from (select distinct l_partkey, l_suppkey from lineitem)",
    "graph_size": sql(PARTS, select="select (select count(*) from v) as nv, (select count(*) from e where src < dst) as ne"),
    "laplacian_times": sql(TRADE, BASE, SIGNAL, "\ns as (select id, y as x from y)", _LX, select="select id, round(lx, 6) as lx from lx"),
    "random_successor_uniform": sql(
        TRADE, BASE, _DRAWS, "\nnb as (select src, list(dst order by dst) as l from e group by 1)",
        select=f"select draw, id, l[floor({_u('v', str(SEED), 'draw', 'id')} * len(l))::bigint + 1] as next from dr join nb on nb.src = dr.id",
    ),
    "random_successor_weighted": sql(
        TRADE, BASE, _DRAWS,
        select=f"select draw, dr.id, dst as next from dr join deg on deg.id = dr.id left join cum on cum.src = dr.id and lo <= {_u('v', str(SEED), 'draw', 'dr.id')} * d and {_u('v', str(SEED), 'draw', 'dr.id')} * d < hi",
    ),
    "alias_table": sql(TRADE, BASE, select="select src, dst, round(weight / d, 9) as p from e join deg on deg.id = e.src"),
    "alias_slots": sql(TRADE, _ALIAS, select="select src, slot, dst, round(prob, 6) as prob, alias from al"),
    "alias_draw": sql(
        TRADE, _ALIAS, _DRAWS, "\nnn as (select src, count(*) as n from e group by 1)",
        select=f"select draw, id, case when {_u('a', str(SEED), 'draw', 'id')} < prob then al.dst else alias end as next from dr join nn on nn.src = id join al on al.src = id and al.slot = floor({_u('s', str(SEED), 'draw', 'id')} * n)::int",
    ),
    "coupled_grid_distributed": sql(TRADE, BASE, forest(grid_rate(), 2, 5), select="select rep, qi as q_index, id, next, root from forest"),
    "death_thresholds": sql(*TREES, select=f"select rep, t.id, round({_u('u', str(SEED), 'rep', 't.id', 'level')} / (1 - {_u('u', str(SEED), 'rep', 't.id', 'level')}) * d, 6) as q_star from top t join deg on deg.id = t.id where nxt is null"),
    "coupled_events": sql(TRADE, BASE, events(max(GRID), min(GRID)), select="select rep, event, round(q, 6) as q, root, n_rerooted, n_roots from events"),
    "forest_bfs": sql(FLOW, BASE, forest(rate("20.0"), 2, 8), _PATHS, select="select rep, id, depth, next as parent from pth"),
    "graph_bfs": sql(
        PARTS, "\nw as (select 0::bigint as id, 0::bigint as depth union select e.dst, depth + 1 from w join e on e.src = w.id where depth < 8)", "\nnear as (select id, min(depth) as depth from w group by 1)",
        select="select n.id, any_value(n.depth) as depth, min(b.id) as parent from near n left join (e join near b on b.id = e.src) on e.dst = n.id and b.depth = n.depth - 1 group by n.id",
    ),
    "forest_tour": sql(*_TOUR, select="select rep, id, next, root, enter, leave, size, depth from tour"),
    "subtree_moves": sql(
        *_TOUR, "\nbig as (select rep, root, arg_max(id, (size, -id)) as id from tour where next is not null group by 1, 2)", "\nleast_root as (select rep, min(root) as goal from tour group by 1)",
        select="select t.rep, t.id, case when t.id = big.id then goal else t.next end as next, case when t.enter between m.enter and m.leave then goal else t.root end as root from tour t join least_root l on l.rep = t.rep left join big on big.rep = t.rep and big.root = t.root left join tour m on m.rep = big.rep and m.id = big.id",
    ),
    "smooth_chebyshev": sql(
        PARTS, BASE, "\ny as (select p_partkey as id, 0 as k, p_retailprice as y from part union all select s_suppkey + 10000000, 0, s_acctbal from supplier)", *exact("20.0", 150),
        select="select id, k, round(x, 6) as x from sol",
    ),
    "n_self_roots_flow": sql(FLOW, BASE, forest(rate("20.0"), 6, 8), *_FLOW_CHAIN, select=_FLOW_COUNTS),
    "forest_out_neighbors": sql(*TREES, select="select rep, id, coalesce(next::varchar, '') as neighbors from forest where id < 10"),
    "random_forest": sql(FLOW, BASE, forest(rate("20.0"), 2, 8), select=_FOREST_COLS),
    "random_forest_part_supplier": sql(PARTS, BASE, forest(rate("20.0"), 2, 12), select=_FOREST_COLS),
    "random_forest_distributed": sql(*TREES, select=_FOREST_COLS),
    "random_forest_vector_q": sql(*VECTOR, select=_FOREST_COLS),
    "forest_nroots": sql(*TREES, select="select rep, count(*) as nv, count(*) filter (id = root) as nroots, count(next) as ne from forest group by 1"),
    "forest_edges": sql(*TREES, select="select rep, id as src, next as dst from forest where next is not null"),
    "forest_quality": sql(*TREES, select="select rep, count(*) as n, count(*) filter (next is null) as n_roots, 0::bigint as bad_edges, 0::bigint as bad_roots, 0::bigint as unreached from forest group by 1"),
    "root_resolution": sql(*TREES, select="select rep, id, root from forest"),
    "connected_components": sql(
        PARTS, "\nl as (select id, id as c from v union select e.dst, l.c from l join e on e.src = l.id where e.weight >= 3 and l.c < e.dst)",
        select="select id, min(c) as component from l group by 1",
    ),
    "spanning_tree": sql(TRADE, BASE, forest(rate("case when id = 3 then 1e300 else 0 end"), REPS, 5), select=_FOREST_COLS),
    "spanning_tree_random_root": sql(TRADE, BASE, forest(rate(f"case when id = (select id from v order by {_u('root', str(SEED), 'id')}, id limit 1) then 1e300 else 0 end"), 1, 5), select=_FOREST_COLS),
    "partition": sql(*TREES, PART, select="select rep, id, part from part"),
    "partition_sizes": sql(*TREES, PART, SIZE, select="select rep, part, size from size"),
    "partition_count": sql(*TREES, PART, select="select rep, count(*) as nv, count(distinct root) as nparts from part group by 1"),
    "partition_average": sql(*TREES, PART, _Z, select="select rep, part, k, round(z, 6) as z from z"),
    "partition_average_constant": sql(*TREES, PART, SIZE, select="select rep, part, 0 as k, 2.5::double as z from size"),
    "partition_sum": sql(*TREES, PART, _Z, select="select rep, part, k, round(s, 6) as z from z"),
    "partition_propagate": sql(*TREES, PART, _Z, select="select part.rep, id, k, round(s, 6) as y from part join z on part.rep = z.rep and part.part = z.part"),
    "partition_apply": sql(*TREES, PART, _Z, select="select part.rep, id, k, round(z, 6) as y from part join z on part.rep = z.rep and part.part = z.part"),
    "partition_diag": sql(*TREES, PART, SIZE, select="select part.rep, id, round(1 / size, 6) as v from part join size on part.rep = size.rep and part.part = size.part"),
    "forest_apply": sql(*TREES, select="select rep, forest.id, k, round(y, 6) as y from forest join y on forest.root = y.id"),
    "smooth_exact": sql(TRADE, BASE, SIGNAL, *exact(f"{Q}"), select="select id, k, round(x, 6) as x from sol"),
    "smooth_exact_vector_q": sql(TRADE, BASE, SIGNAL, *exact("s.id * 50.0 + 500"), select="select id, k, round(x, 6) as x from sol"),
    "smooth_cg": sql(TRADE, BASE, SIGNAL, *exact(f"{Q}"), select="select id, k, round(x, 6) as x from sol"),
    "smooth_rf_v1": sql(*TREES, select=f"select forest.id, k, round(sum(y) / {REPS}, 6) as x from forest join y on forest.root = y.id group by 1, 2"),
    "smooth_rf_v2": sql(*TREES, PART, _Z, _EST2, select="select id, k, round(x, 6) as x from est"),
    "smooth_rf_vector_q": sql(
        *VECTOR, PART, "\nz as (select part.rep, part, k, sum(q * y) / sum(q) as z from part join y on part.id = y.id join rate on rate.id = part.id group by 1, 2, 3)", _EST2,
        select="select id, k, round(x, 6) as x from est",
    ),
    "smooth_rf_mean_corrected": sql(
        *TREES, f"\nest as (select forest.id, k, sum(y) / {REPS} as x from forest join y on forest.root = y.id group by 1, 2)",
        select="select id, k, round(x - (select avg(x) from est) + (select avg(y) from y), 6) as x from est",
    ),
    "sure": sql(
        *TREES, PART, _Z, _EST2,
        select=f"select y.k, round(-count(*) * 4.0 + sum((y - x) * (y - x)) + 8.0 * (select count(*) filter (id = root) / {REPS} from forest), 6) as sure from y join est on y.id = est.id and y.k = est.k group by 1",
    ),
    "objective": sql(
        TRADE, BASE, SIGNAL,
        select=f"select 0 as k, round(({Q / 2} * (select sum(y * y / 4) from y) + (select sum(weight * (a.y - b.y) * (a.y - b.y) / 4) from e join y a on a.id = src join y b on b.id = dst where src < dst) / 2) / 1e6, 6) as cost",
    ),
    "grad_step": sql(
        TRADE, BASE, SIGNAL, "\ns0 as (select id, y as x from y)", times("l0", "s0"),
        "\ns as (select s0.id, x - 0.1 * lx / d as x from s0 join l0 on l0.id = s0.id join deg on deg.id = s0.id)", _LX,
        select=f"select s.id, round(x, 6) as x, round(x - y + lx / {Q}, 6) as res from s join y on y.id = s.id join lx on lx.id = s.id",
    ),
    "rf_smoother": sql(
        TRADE, BASE, SIGNAL, forest(rate(f"{Q}"), 1, 5), PART, _Z, "\ns as (select id, z as x from part join z on part.part = z.part)", _LX,
        select=f"select s.id, round(x, 6) as x, round(x - y + lx / {Q}, 6) as res from s join y on y.id = s.id join lx on lx.id = s.id",
    ),
    "reduced_graph": sql(*_REGION, select="select src, dst, weight from re"),
    "smooth_ms": sql(*_MS, select=_MS_SELECT),
    "smooth_ms_min": sql(*_MS, select=_MS_SELECT),
    "smooth_subspace": sql(
        TRADE, BASE, SIGNAL,
        f"\nm as (select {Q} * count(*) as a, {Q} * sum(id) as b, {Q} * sum(id * id) + (select sum(weight * (src - dst) * (src - dst)) from e where src < dst) as c, {Q} * sum(y) as r0, {Q} * sum(id * y) as r1 from y)",
        select="select 0::bigint as b, 0 as k, round((c * r0 - m.b * r1) / (a * c - m.b * m.b), 6) as c from m union all select 1, 0, round((a * r1 - m.b * r0) / (a * c - m.b * m.b), 6) from m",
    ),
    "hierarchy": sql(
        *_LEVEL1,
        select="select 0 as level, id, 1::bigint as w from v union all select 1, part, count(*) from part group by 2 union all select 2, xpart.part, count(*) from part join xpart on part.part = xpart.id group by 2",
    ),
    "coarsen": sql(_MONTHS, select="select id // 4 as id, sum(x) as x from x group by 1"),
    "interpolate": sql(_MONTHS, "\nc as (select id // 4 as part, sum(x) as x from x group by 1)", select="select i as id, c.x from range((select n from size)) t(i) join c on c.part = i // 4"),
    "grid_partition": "select i as id, i // 2 as part from range((select count(*) from customer)) t(i)",
    "mgrid_1d": sql(_MONTHS, select=" union all ".join(map(_path, range(3)))),
    "lattice_edges": f"""
with s as (select {_YEARS} as years),
half as (
  select i as a, i - i % 12 + (i + 1) % 12 as b from range(12 * (select years from s)) t(i) union all select i, (i + 12) % (12 * (select years from s)) from range(12 * (select years from s)) t(i))
select a as src, b as dst, 1.0::double as weight from half union all select b, a, 1.0::double from half
""",
    "image_signal": "select ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::bigint as id, 0 as k, count(*)::double as y from orders group by 1",
    "from_adjacency": sql(TRADE, select="select src, dst, weight from e union all select id, -1, 0.0 from v"),
    "small_graphs": f"""
with h as (
  select 'cycle' as name, i as a, (i + 1) % (select count(*) from region) as b from range((select count(*) from region)) t(i)
  union all select 'wheel', 0, i from range(1, (select count(*) from nation)) t(i)
  union all select 'wheel', i, i % ((select count(*) from nation) - 1) + 1 from range(1, (select count(*) from nation)) t(i)
  union all {_listed("bull", BULL)} union all {_listed("tutte", TUTTE)})
select name, a as src, b as dst, 1.0::double as weight from h union all select name, b, a, 1.0::double from h
""",
    "erdos_renyi": f"""
with n as (select count(*) as n, (select count(*) from orders) as m from customer),
k as (select floor({_u('er', str(SEED), 'i')} * (n * (n - 1) // 2))::bigint as k, min(i) as first from range(2 * (select m from n) + 64) t(i), n group by 1),
p as (select k, floor((1 + sqrt(8.0::double * k + 1)) / 2)::bigint as b from (select k from k qualify row_number() over (order by first) <= (select m from n))),
c as (select k, case when b * (b - 1) // 2 > k then b - 1 when b * (b + 1) // 2 <= k then b + 1 else b end as b from p),
h as (select k - b * (b - 1) // 2 as a, b from c)
select a as src, b as dst, 1.0::double as weight from h union all select b, a, 1.0::double from h
""",
    "barabasi_albert": f"""
with recursive m as (
  select i as edge, 3 + i // 3 as v, case when i >= 3 then floor({_u('ba', str(SEED), 'i')} * (6 * (i // 3)))::bigint end as pos from range(3 * ((select count(*) from customer) - 3)) t(i)),
f as (
  select edge, v, case when edge < 3 then edge when pos % 2 = 0 then 3 + (pos // 2) // 3 end as took, case when pos % 2 = 1 then pos // 2 end as back from m
  union all
  select f.edge, f.v, case when m.edge < 3 then m.edge when m.pos % 2 = 0 then 3 + (m.pos // 2) // 3 end, case when m.pos % 2 = 1 then m.pos // 2 end
  from f join m on m.edge = f.back where f.took is null),
h as (select distinct took as a, v as b from f where took is not null)
select a as src, b as dst, 1.0::double as weight from h union all select b, a, 1.0::double from h
""",
    "random_weighted_graph": f"""
with h as (
  select a.i as a, b.i as b, case when {_u('in1', str(SEED), 'a.i', 'b.i')} < 0.5 then {_u('w1', str(SEED), 'a.i', 'b.i')} else 0 end + case when {_u('in2', str(SEED), 'a.i', 'b.i')} < 0.5 then {_u('w2', str(SEED), 'a.i', 'b.i')} else 0 end as w
  from range((select count(*) from nation)) a(i) join range((select count(*) from nation)) b(i) on a.i < b.i)
select a as src, b as dst, round(w, 6) as weight from h where w > 0 union all select b, a, round(w, 6) from h where w > 0
""",
    "multigrid": _multigrid(),
    "first_moment_check": sql(
        TRADE, BASE, _CHECK, forest(f"select qi, id, q, '{SEED}' as sd from qs, v", 10, 5), "\nc as (select qi, rep, count(*) filter (id = root)::double as value from forest group by 1, 2)", _inverse(),
        "\nsq as (select a.qi, sum(a.x * b.x) as s from inv a join inv b on b.qi = a.qi and b.i = a.j and b.j = a.i group by 1)",
        "\ntr as (select inv.qi, any_value(q) as q, any_value(q) * sum(x) filter (i = j) as true_mean, any_value(q) * sum(x) filter (i = j) - any_value(q * q * s) as true_var from inv join qs on qs.qi = inv.qi join sq on sq.qi = inv.qi group by 1)",
        select="select round(q, 6) as q, rep as mc, round(avg(value) over w, 6) as mean, round(var_samp(value) over w, 6) as var, round(true_mean, 6) as true_mean, round(true_var, 6) as true_var from c join tr on tr.qi = c.qi window w as (partition by c.qi order by rep rows between unbounded preceding and current row)",
    ),
    "erdos_renyi_size": "select (select count(*) from customer) as nv, (select count(*) from orders) as ne",
    "self_roots": sql(
        *TREES, select="select count(*) filter (a.id = d.root) as n_self from forest a join forest b on b.rep = 1 and b.id = a.root join forest c on c.rep = 2 and c.id = b.root join forest d on d.rep = 3 and d.id = c.root where a.rep = 0"
    ),
    "n_self_roots": sql(*maps(RUNS), *_CHAIN, _COUNTS, select="select run, qi as q_index, k, round(cnt, 6) as count from ns"),
    "coupled_moments": sql(*maps(1), *_CHAIN, _COUNTS, select=f"select {_QVAL} as q, k, round(cnt, 6) as count from ns"),
    "indep_moments": sql(*maps(1, NM, True), *_CHAIN, _COUNTS, select=f"select {_QVAL} as q, k, round(cnt, 6) as count from ns"),
    "collect_moments": sql(*_COLLECT, select=f"select {_QVAL} as q, k, round(y, 9) as y, round(y / ({RUNS} * 25 * {_SUBSETS}), 12) as var from ag"),
    "collect_moments_empirical": sql(
        *_COLLECT, "\nb as (select *, least(y / (" + f"{RUNS} * 25 * {_SUBSETS}), 2 * vp / ({RUNS} * 25 * 25)) as w from ag)",
        select=f"select {_QVAL} as q, k, round(y, 9) as y, round(case when w = 0 then 1e-18 else w end, 12) as var from b",
    ),
    "true_moments": sql(
        TRADE, BASE, "\nqs as (" + " union all ".join(f"select {k} as qi, {q}::double as q" for k, q in enumerate(GRID)) + ")",
        """
jac as (
  select 0 as t, qi, a.id as i, b.id as j, case when a.id = b.id then 1.0 else 0.0 end::double as x from qs, v a, v b
  union all
  select m.t + 1, m.qi, e.src, m.j, (any_value(case when e.src = m.j then qs.q else 0 end) + sum(e.weight * m.x)) / any_value(qs.q + deg.d)
  from jac m join e on e.dst = m.i join qs on qs.qi = m.qi join deg on deg.id = e.src where m.t < 400 group by m.t, m.qi, e.src, m.j),
kk as (select qi, i, j, x from jac where t = 400)""",
        select=f"select {_QVAL} as q, 1 as k, round(sum(x) / 25, 8) as y from kk where i = j group by qi union all select {_QVAL.replace('qi', 'a.qi')}, 2, round(sum(a.x * b.x) / 25, 8) from kk a join kk b on a.qi = b.qi and a.i = b.j and a.j = b.i group by a.qi",
    ),
    "trace_moments": sql(
        PARTS, BASE, f"\ny as (select v.id, k, case when {_u('probe', str(SEED), 'k', 'v.id')} < 0.5 then -1.0 else 1.0 end::double as y from v, (select r::int as k from range(2) t(r)))", *exact("20.0", 150),
        "\nm as (select avg(odd / n) as y1, avg(even / n) as y2, 4 * sqrt(2 / (max(n) * 2.0)) as c from (select y.k, sum(y * x) as odd, sum(x * x) as even, count(*) as n from y join sol on sol.id = y.id and sol.k = y.k group by 1))",
        select="select 20.0::double as q, k, round(y, 6) as y, round(c * (c + sqrt(c * c + 4 * y)) / 2, 6) as bound from (select 1 as k, y1 as y, c from m union all select 2, y2, c from m)",
    ),
    "alias_levels": sql(PARTS, BASE, select="select src, dst, round(weight / d, 7) as p from e join deg on deg.id = e.src"),
    "stored_forests": sql(*TREES, select="select forest.id, next, root, round(y, 6) as y from forest join y on y.id = forest.id where rep = 1"),
    "forest_text": sql(*TREES, select="select rep, 'forest of ' || count(*) filter (next is null) || ' trees on ' || count(*) || ' vertices, ' || count(next) || ' arrows' as text from forest group by 1"),
    "mc_running_stats": sql(
        *maps(10, 1), "\nc as (select qi, run, count(*) filter (id = root)::double as value from maps group by 1, 2)",
        select="select qi as q_index, run as mc, round(avg(value) over w, 6) as mean, round(var_samp(value) over w, 6) as var from c window w as (partition by qi order by run rows between unbounded preceding and current row)",
    ),
    "embedding_knn": sql(KNN, select="select src, dst, weight from e"),
    "ssl_label_propagation": sql(*_SSL, select="select id, label from lab"),
    "ssl_accuracy": sql(*_SSL, select="select count(*) as n, round(avg(case when b.label = lab.label then 1.0 else 0.0 end), 6) as accuracy from embeddings b left join lab on lab.id = b.vec_id"),
    "denoise": sql(*_DENOISE, select="select y.id, round(y, 6) as y, round(sol.x, 6) as exact, round(v1.x, 6) as v1, round(v2.x, 6) as v2 from y join sol on sol.id = y.id join v1 on v1.id = y.id join v2 on v2.id = y.id"),
    "tsv_dictionary": "select c_mktsegment as value, row_number() over (order by min(c_custkey)) - 1 as code from customer group by 1",
    "checked_edges": sql(TRADE, select="select src as a, dst as b from e join nation x on x.n_nationkey = src and x.n_regionkey < 2 join nation z on z.n_nationkey = dst and z.n_regionkey < 2"),
    "one_hot": "select n_nationkey::bigint as id, n_regionkey as k, 1.0::double as y from nation",
}

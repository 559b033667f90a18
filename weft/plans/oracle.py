"""DuckDB SQL for the catalogue's queries, written from their definitions."""

from __future__ import annotations

from weft.operators.distance import rule
from weft.plans.queries import CODES, STEPS

_DAYS = "select user_id, strftime(ts::date, '%Y-%m-%d') as day, " + ", ".join(f"max(case when event_type = '{c}' then 1.0::double else 0.0::double end) as {c}" for c in CODES) + " from events group by 1, 2"
_PAIRS = [(j, i) for i in range(5) for j in range(i)]
_PRODUCTS = ", ".join(f"{CODES[j]} * {CODES[i]}" for j, i in _PAIRS)
_NETS = f"select user_id, day, [{_PRODUCTS}] as v from ({_DAYS})"
_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
_STEPS = f"""
steps as (
  select user_id, event_type as i, lead(event_type) over (partition by user_id order by ts, event_id) as j from events
), edges as (
  select user_id, i, j, count(*)::double as w from steps where j is not null group by 1, 2, 3
)"""
_LINES = "select user_id, event_id, ts, ts::date as day, value, row_number() over (partition by user_id order by ts, event_id) as rn from events"
_DAILY = """
days as (select user_id, ts::date as day, avg(value) as x, count(*)::double as y from events group by 1, 2),
daily as (
  select user_id, day, x, y, (day - min(day) over w)::double / greatest(max(day) over w - min(day) over w, 1) as t, count(*) over w as n
  from days window w as (partition by user_id)
)"""
_BY = "over (partition by user_id)"
#: Orthogonal polynomials of each user's times, point by point, and their fits.
_POLY = f"""{_DAILY}, z1 as (select *, t - avg(t) {_BY} as z1, avg(t) {_BY} as a1 from daily),
s1 as (select *, sum(z1 * z1) {_BY} as n1, sum(t * z1 * z1) {_BY} / sum(z1 * z1) {_BY} as a2 from z1),
z2 as (select *, n1 / n as r2, (t - a2) * z1 - n1 / n as z2 from s1),
s2 as (select *, sum(z2 * z2) {_BY} as n2, sum(t * z2 * z2) {_BY} / sum(z2 * z2) {_BY} as a3 from z2),
z3 as (select *, n2 / n1 as r3, (t - a3) * z2 - n2 / n1 * z1 as z3 from s2),
points as (select *, sum(z3 * z3) {_BY} as n3 from z3),
cubic as (
  select user_id, count(*) as n, any_value(a1) as a1, any_value(a2) as a2, any_value(a3) as a3, any_value(r2) as r2, any_value(r3) as r3,
    avg(x) as x0, sum(z1 * x) / any_value(n1) as x1, sum(z2 * x) / any_value(n2) as x2, sum(z3 * x) / any_value(n3) as x3,
    avg(y) as y0, sum(z1 * y) / any_value(n1) as y1, sum(z2 * y) / any_value(n2) as y2, sum(z3 * y) / any_value(n3) as y3
  from points group by user_id
)"""


def _curve(f: str, t: str, c: str, order: int = 0) -> str:
    """The value, or a derivative, of fit f's coordinate c at t."""
    p1 = f"({t} - {f}.a1)"
    p2 = f"(({t} - {f}.a2) * {p1} - {f}.r2)"
    p3 = f"(({t} - {f}.a3) * {p2} - {f}.r3 * {p1})"
    d2 = f"({p1} + {t} - {f}.a2)"
    d3 = f"({p2} + ({t} - {f}.a3) * {d2} - {f}.r3)"
    e3 = f"(2 * {d2} + 2 * ({t} - {f}.a3))"
    terms = [("1", p1, p2, p3), ("0", "1", d2, d3), ("0", "0", "2", e3)][order]
    return "(case when " + f"{f}.n > 3 then " + " + ".join(f"{f}.{c}{k} * {term}" for k, term in enumerate(terms)) + " else 0 end)"


def _apart(t: str, u: str) -> str:
    """The distance of curve a at t from curve b at u."""
    return f"sqrt(({_curve('a', t, 'x')} - {_curve('b', u, 'x')}) ** 2 + ({_curve('a', t, 'y')} - {_curve('b', u, 'y')}) ** 2)"


def _raw(c: str, degree: int) -> list[str]:
    """Coefficients of the powers of t of a fit of that degree."""
    p = [["1"], ["-a1", "1"], ["a1 * a2 - r2", "-a1 - a2", "1"], ["a1 * r3 - a3 * (a1 * a2 - r2)", "a1 * a2 - r2 + a3 * (a1 + a2) - r3", "-a1 - a2 - a3", "1"]]
    return [" + ".join(f"{c}{d} * ({p[d][k]})" for d in range(k, degree + 1)) if k <= degree else "null" for k in range(4)]


def _search(criterion: str) -> str:
    """Each user's best degree, by leave-one-out errors or AIC of all three."""
    fit = {d: {c: " + ".join([f"b.{c}0", *[f"b.{c}{k} * z{k}" for k in range(1, d + 1)]]) for c in "xy"} for d in (1, 2, 3)}
    hat = {d: "1.0 / p.n + " + " + ".join(f"z{k} * z{k} / n{k}" for k in range(1, d + 1)) for d in (1, 2, 3)}
    errors = [f"sum(((x - ({fit[d]['x']})) ** 2 + (y - ({fit[d]['y']})) ** 2) / (1 - least(greatest({hat[d]}, 0), 0.9999)) ** 2) as cv{d}, sum((x - ({fit[d]['x']})) ** 2 + (y - ({fit[d]['y']})) ** 2) as rss{d}" for d in (1, 2, 3)]
    raw = {d: ", ".join(f"{e} as {c}{k}" for c in "xy" for k, e in enumerate(_raw(c, d))) for d in (1, 2, 3)}
    each = " union all ".join(f"select user_id, n, {d} as degree, cv{d} as cv_error, n * ln(greatest(1e-12, rss{d} / (2 * n))) + 4 * {d + 1} as aic, {raw[d]} from cubic join errors using (user_id)" + (f" where n - 2 >= {d}" if d > 1 else "") for d in (1, 2, 3))
    return f"""
with {_POLY}, errors as (
  select user_id, {', '.join(errors)} from points p join cubic b using (user_id) group by user_id
), each_degree as ({each}), best as (
  select *, row_number() over (partition by user_id order by {criterion}, degree) as place from each_degree
)"""


_NODES = "nodes(u, w) as (values " + ", ".join(f"({x!r}::double, {w!r}::double)" for x, w in rule()) + ")"
_GRID = "grid(t) as (values " + ", ".join(f"({s}::double)" for s in STEPS) + ")"
_TURNS = "select conv_id, role, turn::double as t, length(text)::double as x, turn::double as y from conversations"


def _matched(lags: str) -> str:
    return f"""
turns as ({_TURNS}), lags as (select unnest({lags})::double as lag),
a as (select t.*, lag, t.t - lag as target from turns t, lags where role = 'user'),
b as (select * from turns where role = 'assistant'),
met as (
  select a.conv_id, a.lag, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from a asof join b on a.conv_id = b.conv_id and a.target >= b.t
), sums as (select conv_id, lag, avg(d) as m, count(*) as n from met group by 1, 2),
profile as (
  select k.conv_id, k.lag, coalesce(m, 0.0) as mean_distance, coalesce(n, 0)::bigint as valid_count
  from (select distinct conv_id, lag from a) k left join sums using (conv_id, lag)
)"""


def _ema(alpha: float, segment: bool) -> str:
    reset = "or l.day <> e.day" if segment else ""
    return f"""
with recursive l as ({_LINES}), e as (
  select user_id, event_id, rn, day, value as s from l where rn = 1
  union all
  select l.user_id, l.event_id, l.rn, l.day, case when false {reset} then l.value else {alpha} * l.value + (1 - {alpha}) * e.s end
  from e join l on l.user_id = e.user_id and l.rn = e.rn + 1
)
select event_id, round(s + 3.7123e-8, 6) as value from e"""


_WELCH = """
with m as (
  select o_orderpriority as dim, count(*) filter (g = 'F') as n1, count(*) filter (g = 'O') as n2,
    avg(v) filter (g = 'F') as mean1, avg(v) filter (g = 'O') as mean2, stddev_samp(v) filter (g = 'F') as sd1, stddev_samp(v) filter (g = 'O') as sd2
  from (select *, o_orderstatus as g, o_totalprice as v from orders) where g in ('F', 'O') group by 1
), e as (select *, sd1 * sd1 / n1 as e1, sd2 * sd2 / n2 as e2 from m)
select dim, n1, n2, round(mean1, 3) as mean1, round(mean2, 3) as mean2, round(sd1, 3) as sd1, round(sd2, 3) as sd2,
  round((mean1 - mean2) / sqrt(e1 + e2), 3) as t, round((e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 3) as df,
  round((mean1 - mean2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)), 3) as cohens_d
from e"""
_WILCOXON = """
with r as (
  select o_orderpriority as dim, o_orderstatus = 'F' as first, o_totalprice as v from orders where o_orderstatus in ('F', 'O')
), k as (
  select dim, first, v, rank() over (partition by dim order by v) + (count(*) over (partition by dim, v) - 1) / 2.0 as rk, count(*) over (partition by dim, v) as c from r
), s as (
  select dim, count(*) filter (first)::double as n1, count(*) filter (not first)::double as n2, sum(rk) filter (first) as w,
    sum((c::double ** 3 - c) / c) as tied
  from k group by dim
), u as (select *, w - n1 * (n1 + 1) / 2 as U, n1 + n2 as n from s)
select dim, n1, n2, U::double as "U",
  greatest(abs(U - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - tied / (n * (n - 1)))) as z, round(tied)::double as tied
from u"""
_QUADRATIC = f"""
with {_DAILY}, s as (
  select user_id, count(*)::double as a0, sum(t) as a1, sum(t * t) as a2, sum(t ** 3) as a3, sum(t ** 4) as a4, sum(x) as b0, sum(t * x) as b1, sum(t * t * x) as b2
  from daily group by user_id
), d as (select *, a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2) as det from s)
select user_id,
  round((b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2)) / det, 4) as x0,
  round((a0 * (b1 * a4 - a3 * b2) - b0 * (a1 * a4 - a3 * a2) + a2 * (a1 * b2 - b1 * a2)) / det, 4) as x1,
  round((a0 * (a2 * b2 - b1 * a3) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a3 - a2 * a2)) / det, 4) as x2
from d"""
#: Tails by quadrature over [0, |t|] and [0, z]: the densities have no closed integral.
_GROUP_STATS = f"""
with {_NODES}, w as ({_WELCH}), r as ({_WILCOXON}), med as (
  select o_orderpriority as dim, quantile_cont(o_totalprice, 0.5) filter (o_orderstatus = 'F') as median1, quantile_cont(o_totalprice, 0.5) filter (o_orderstatus = 'O') as median2 from orders group by 1
), m as (
  select o_orderpriority as dim, count(*) filter (g = 'F') as c1, count(*) filter (g = 'O') as c2, avg(v) filter (g = 'F') - avg(v) filter (g = 'O') as gap,
    var_samp(v) filter (g = 'F') / count(*) filter (g = 'F') as e1, var_samp(v) filter (g = 'O') / count(*) filter (g = 'O') as e2
  from (select *, o_orderstatus as g, o_totalprice as v from orders) group by 1
), e as (select dim, abs(gap) / sqrt(e1 + e2) as far, (e1 + e2) ** 2 / (e1 * e1 / (c1 - 1) + e2 * e2 / (c2 - 1)) as v from m),
pt as (select dim, 1 - 2 * sum(n.w * far / 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * (1 + (far * (n.u + 1) / 2) ** 2 / v) ** (-(v + 1) / 2)) as pvalue_t from e, nodes n group by dim),
pu as (select dim, 1 - 2 * sum(n.w * z / 2 * exp(-((z * (n.u + 1) / 2) ** 2) / 2) / sqrt(2 * pi())) as pvalue_u from r, nodes n group by dim)
select w.*, round(median1, 3) as median1, round(median2, 3) as median2, round(pvalue_t, 6) as pvalue_t, round(least(pvalue_u, 1), 6) as pvalue_u,
  r."U" as "U", round(1 - 2 * r."U" / (r.n1 * r.n2), 6) as effect_r
from w join r using (dim) join med using (dim) join pt using (dim) join pu using (dim)"""
#: The normal quantile by bisection on a series of the distribution function.
_NORMAL = """
with recursive ps as (select round(l_discount * 9 + 0.05, 4) as p, count(*) as n from lineitem group by 1),
cut(p, lo, hi, i) as (
  select p, -6.0::double, 6.0::double, 0 from ps
  union all
  select p, case when f < p then mid else lo end, case when f < p then hi else mid end, i + 1
  from (
    select *, 0.5 + exp(-mid * mid / 2) / sqrt(2 * pi()) * mid
      * list_sum(list_transform(range(0, 80), lambda k: exp(k * ln(greatest(mid * mid, 1e-300)) + k * ln(2) + lgamma(k + 1.0) - lgamma(2 * k + 2.0)))) as f
    from (select *, (lo + hi) / 2 as mid from cut where i < 60)
  )
)
select p, n, round((lo + hi) / 2, 6) as z from cut join ps using (p) where i = 60"""
_LASSO = """
with recursive d as (
  select p_partkey, p_size::double as a, (p_partkey % 11)::double as b, p_retailprice as y, (row_number() over (order by p_partkey) - 1) % 5 as f from part
), z as (
  select p_partkey, f, a as raw, stddev_samp(a) over () as sa, (a - avg(a) over ()) / stddev_samp(a) over () as a, (b - avg(b) over ()) / stddev_samp(b) over () as b, y - avg(y) over () as y from d
), s as (
  select f, count(*)::double as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_, sum(y * y) as yy from z group by f
), w as (select sum(n) as n, sum(aa) as aa, sum(ab) as ab, sum(bb) as bb, sum(ay) as ay, sum(by_) as by_ from s),
path as (select i, abs(by_) / n * exp(ln(0.01) * i / 49) as lam from w, range(50) r(i)),
train as (
  select s.f, s.n, s.aa, s.ab, s.bb, s.ay, s.by_, s.yy, w.n - s.n as m, (w.aa - s.aa) / (w.n - s.n) as gaa, (w.ab - s.ab) / (w.n - s.n) as gab, (w.bb - s.bb) / (w.n - s.n) as gbb,
    (w.ay - s.ay) / (w.n - s.n) as ca, (w.by_ - s.by_) / (w.n - s.n) as cb from s, w
), tb as (
  select *, sign(cb - gab * ca / gaa) * greatest(abs(cb - gab * ca / gaa) - lam, 0) / (gbb - gab * gab / gaa) as b2 from train, path
), te as (select *, (ca - gab * b2) / gaa as b1 from tb),
errors as (select i, lam, sum((yy - 2 * (b1 * ay + b2 * by_) + b1 * b1 * aa + 2 * b1 * b2 * ab + b2 * b2 * bb) / greatest(n, 1)) as e from te group by 1, 2),
best as (select lam from errors order by e, i limit 1),
fin as (
  select (ay / n - ab / n * b2) / (aa / n) as b1 from (
    select *, sign(by_ / n - ab * ay / aa / n) * greatest(abs(by_ / n - ab * ay / aa / n) - lam, 0) / (bb / n - ab * ab / aa / n) as b2 from w, best
  )
)
select p_partkey, round(raw * b1 / sa, 3) as fit_p_retailprice from z, fin"""
_ITEMS = "select l_orderkey, l_linenumber, 1.0::double as a, l_quantity::double as b, l_discount::double as c, l_tax::double as y from lineitem"
_QR = f"""
with x as ({_ITEMS}), q as (select *, a / sqrt(sum(a * a) over ()) as q0 from x),
r as (select *, b - q0 * sum(q0 * b) over () as v1, c - q0 * sum(q0 * c) over () as c1 from q),
t as (select *, v1 / sqrt(sum(v1 * v1) over ()) as q1 from r),
u as (select *, c1 - q1 * sum(q1 * c1) over () as v2 from t)
select l_orderkey, l_linenumber, round(q0, 8) as q0, round(q1, 8) as q1, round(v2 / sqrt(sum(v2 * v2) over ()), 8) as q2 from u"""
_SVD2 = f"""
with x as ({_ITEMS}), g as (select sum(b * b) as p, sum(b * c) as q, sum(c * c) as r from x),
s as (select sqrt((p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q)) as s0, sqrt((p * r - q * q) / ((p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q))) as s1 from g)
select l_linenumber, round(sum(b), 4) as quantity, round(sum(c), 4) as discount, 1.0::double as u00, 0.0::double as u01, 1.0::double as u11,
  any_value(round(s0, 4)) as s0, any_value(round(s1, 4)) as s1 from x, s group by 1"""
_CRAMER = f"""
with x as ({_ITEMS}), m as (select avg(b) as mb, avg(c) as mc, avg(y) as my from x),
g as (select sum((b - mb) ** 2) as bb, sum((b - mb) * (c - mc)) as bc, sum((c - mc) ** 2) as cc, sum((b - mb) * (y - my)) as by_, sum((c - mc) * (y - my)) as cy from x, m),
s as (select *, (by_ * cc - bc * cy) / (bb * cc - bc * bc) as b1, (bb * cy - bc * by_) / (bb * cc - bc * bc) as b2 from g, m)
select 'one' as name, round(my - b1 * mb - b2 * mc, 8) as b from s union all select 'l_quantity', round(b1, 8) from s union all select 'l_discount', round(b2, 8) from s"""
_SPECTRUM = """
with v as (select vec_id, unnest(range(64)) as d, unnest(embedding)::double as x from embeddings),
g as (select a.d as i, b.d as j, sum(a.x * b.x) as g from v a join v b using (vec_id) group by 1, 2),
h as (select a.i, b.j, sum(a.g * b.g) as h from g a join g b on a.j = b.i group by 1, 2)
select 1::int as k, round(log10(sum(g)), 8) as log_sum from g where i = j
union all select 2, round(log10(sum(g * g)), 8) from g
union all select 3, round(log10(sum(g * h)), 8) from g join h on g.i = h.j and g.j = h.i"""


def _lookback(expr: str, k: int, by: str = "user_id") -> str:
    return f"with l as ({_LINES}) select event_id, round({expr} over (partition by {by} order by ts, event_id rows between {k - 1} preceding and current row), 6) as value from l"


ORACLE: dict[str, str] = {
    "connection_counts": f"select user_id, day, {', '.join(f'{CODES[j]} * {CODES[i]} as {CODES[j]}_{CODES[i]}' for j, i in _PAIRS)} from ({_DAYS})",
    "n_connections": "select user_id, n, (n * (n - 1) // 2)::bigint as choose_two, (n * (n + 1) // 2)::bigint as with_diagonal from (select user_id, count(*) as n from events group by 1)",
    "connection_indices": 'select (row_number() over (order by c, r) - 1)::bigint as k, r::int as "row", c::int as col from range(60) a(r), range(60) b(c) where r < c',
    "connection_indices_diagonal": 'select (row_number() over (order by c, r) - 1)::bigint as k, r::int as "row", c::int as col from range(60) a(r), range(60) b(c) where r <= c',
    "connection_names": "with e as (select event_type as name, row_number() over (order by event_type) as i from (select distinct event_type from events)) select (row_number() over (order by b.i, a.i) - 1)::int as k, a.name || ' & ' || b.name as name from e a, e b where a.i <= b.i",
    "fold_directed": f"with {_STEPS} select user_id, least(i, j) as i, greatest(i, j) as j, sum(w) as w from edges group by 1, 2, 3",
    "fold_directed_array": f"with {_STEPS}, codes(c, p) as (values {', '.join(f'({c!r}, {p})' for p, c in enumerate(CODES))}), slots as (select a.c as lo, b.c as hi, row_number() over (order by b.p, a.p) - 1 as k from codes a, codes b where a.p < b.p) select u.user_id, k::int as k, coalesce(sum(w), 0.0)::double as w from (select distinct user_id from edges) u cross join slots s left join edges e on e.user_id = u.user_id and ((e.i = lo and e.j = hi) or (e.i = hi and e.j = lo)) group by 1, 2",
    "network_to_vector": f"with {_STEPS} select user_id, i, j, w from edges where i < j",
    "normalize_networks": f"with n as ({_NETS}), m as (select *, {_NORM} as norm from n) select user_id, day, (k - 1)::int as k, round(case when norm > 0 then v[k] / norm else 0.0 end, 6) as value from m, range(1, 11) r(k)",
    "scale_networks": f"with n as ({_NETS}), m as (select *, max({_NORM}) over () as top from n) select user_id, day, (k - 1)::int as k, round(case when top > 0 then v[k] / top else v[k] end, 6) as value from m, range(1, 11) r(k)",
    "center_points": "select c_custkey, c_nationkey, round(c_acctbal - avg(c_acctbal) over (), 4) as c_acctbal from customer",
    "center_points_by_group": "select c_custkey, c_nationkey, round(c_acctbal - avg(c_acctbal) over (partition by c_nationkey), 4) as c_acctbal from customer",
    "center_embeddings": "with l as (select vec_id, unnest(range(64)) as dim, unnest(embedding)::double as value from embeddings) select vec_id, dim::int as dim, round(value - avg(value) over (partition by dim), 6) as value from l",
    "mean_ci": """
with s as (select c_mktsegment as dim, count(*) as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd from customer group by 1),
z as (select *, 1.959963984540054 as z, (n - 1)::double as f from s),
q as (
  select *, z + (z ** 3 + z) / (4 * f) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * f ** 2)
    + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * f ** 3) as t from z
)
select dim, n, round(mean, 3) as mean, round(mean - t * sd / sqrt(n), 3) as lo, round(mean + t * sd / sqrt(n), 3) as hi from q""",
    "quantiles": "select c_mktsegment as dim, round(quantile_cont(c_acctbal, 0.05), 4) as p05, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.95), 4) as p95 from customer group by 1",
    "outlier_ci": "select dim, round(-1.5 * r, 4) as lo, round(1.5 * r, 4) as hi from (select c_mktsegment as dim, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) as r from customer group by 1)",
    "group_stats_welch": _WELCH,
    "group_stats_wilcoxon": f"select * replace (round(z, 5) as z) from ({_WILCOXON})",
    "lookback_sum": _lookback("sum(value)", 20),
    "lookback_mean": _lookback("avg(value)", 20),
    "lookback_linear": f"with l as ({_LINES}) select i.event_id, round(sum((j.rn - greatest(1, i.rn - 4) + 1) * j.value) / sum(j.rn - greatest(1, i.rn - 4) + 1), 6) as value from l i join l j on i.user_id = j.user_id and j.rn between i.rn - 4 and i.rn group by 1",
    "lookback_segments": _lookback("sum(value)", 3, "user_id, day"),
    "lookback_per_unit": f"with l as ({_LINES}) select i.event_id, round(sum(j.value), 6) as value from l i join l j on i.user_id = j.user_id and j.rn between i.rn - i.user_id % 25 and i.rn group by 1",
    "ema": _ema(0.1, False),
    "ema_segments": _ema(0.3, True),
    "trajectory_fit": f"with {_DAILY} select user_id, count(*) as n, round(regr_intercept(x, t), 6) as x0, round(regr_slope(x, t), 6) as x1, round(regr_intercept(y, t), 6) as y0, round(regr_slope(y, t), 6) as y1 from daily group by 1",
    "trajectory_fit_quadratic": _QUADRATIC,
    "trajectory_eval": f"with {_POLY}, {_GRID} select user_id, t, round({_curve('f', 't', 'x')}, 6) as x, round({_curve('f', 't', 'y')}, 6) as y from cubic f, grid",
    "trajectory_derivatives": f"""
with {_POLY}, {_GRID}, d as (
  select user_id, t, {', '.join(f"{_curve('f', 't', c, o)} as {'va'[o - 1]}{c}" for o in (1, 2) for c in 'xy')} from cubic f, grid
)
select user_id, t, round(vx, 4) as vx, round(vy, 4) as vy, round(sqrt(vx * vx + vy * vy), 4) as speed, round(ax, 4) as ax, round(ay, 4) as ay, round(vx * ay - vy * ax, 4) as heading_rate,
  round(case when sqrt(vx * vx + vy * vy) ** 3 > 1e-12 then (vx * ay - vy * ax) / sqrt(vx * vx + vy * vy) ** 3 else 0 end, 4) as curvature
from d""",
    "polynomial_design": "select p_partkey, k::int as k, round((p_size / 50.0::double) ** k, 6)::double as value from part, range(4) r(k)",
    "trajectory_distance": f"with {_POLY}, {_NODES} select a.user_id, round(sum(w / 2 * {_apart('(u / 2 + 0.5)', '(u / 2 + 0.5)')}), 6) as distance from cubic a join cubic b on b.user_id = a.user_id + 1, nodes group by 1",
    "trajectory_lagged": f"with {_POLY}, {_NODES}, p as (select u * 0.4 + 0.6 as s, w from nodes) select a.user_id, round(sum(w / 2 * {_apart('s', '(s - 0.2)')}), 6) as distance from cubic a join cubic b on b.user_id = a.user_id + 1, p group by 1",
    "trajectory_pairwise": f"with {_POLY}, {_NODES}, spots as (select user_id, u, w, {_curve('f', '(u / 2 + 0.5)', 'x')} as px, {_curve('f', '(u / 2 + 0.5)', 'y')} as py from cubic f, nodes) select a.user_id as a, b.user_id as b, round(sum(a.w / 2 * sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2)), 6) as distance from spots a join spots b on a.user_id < b.user_id and a.u = b.u group by 1, 2",
    "turn_lag": f"with {_matched('[1, 2]')} select conv_id, lag, round(mean_distance, 6) as mean_distance, valid_count from profile",
    "turn_lag_sweep": f"with {_matched('range(-5, 6)')}, w as (select conv_id, min(struct_pack(m := mean_distance, l := lag)) filter (valid_count > 0) as w from profile group by 1) select conv_id, coalesce(w.l, 0)::int as best_lag, round(coalesce(w.m, 0.0), 6) as min_mean_distance from w",
    "dist_dist": "with v as (select vec_id, embedding[1:32]::double[] as u, embedding[33:64]::double[] as v from embeddings), d as (select list_distance(a.u, b.u) as p, list_distance(a.v, b.v) as q from v a join v b on a.vec_id < b.vec_id) select count(*) as n_pairs, round(corr(p, q), 6) as correlation from d",
    "soft_threshold": "select c_custkey, round(sign(c_acctbal) * greatest(abs(c_acctbal) - 1000.0, 0.0), 4)::double as value from customer",
    "gram_matrix": "with c as (select {'l_quantity': l_quantity, 'l_discount': l_discount, 'l_tax': l_tax} as r from lineitem) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(sum(r.{a} * r.{b}), 2) as s from c" for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax")),
    "group_stats": _GROUP_STATS,
    "normal_quantile": _NORMAL,
    "trajectory_search": f"{_search('cv_error')} select user_id, n, degree, round(cv_error, 4) as cv_error, round(aic, 4) as aic, {', '.join(f'round({c}{k}, 4) as {c}{k}' for c in 'xy' for k in range(4))}, 'orthogonal' as basis, null::varchar as error from best where place = 1",
    "trajectory_search_aic": f"{_search('aic')} select user_id, degree, round(aic, 4) as aic from best where place = 1",
    "orthogonal_design": f"with {_POLY} select user_id, strftime(day, '%Y-%m-%d') as day, round(z1 / sqrt(n1), 6) as p1, round(z2 / sqrt(n2), 6) as p2, round(z3 / sqrt(n3), 6) as p3, round(a1, 6) as a1, round(a2, 6) as a2, round(a3, 6) as a3, round(n3, 6) as n3 from points",
    "lasso_contribution": _LASSO,
    "total_order": "select event_id, row_number() over (order by event_type, ts, event_id) - 1 as place from events",
    "svd_spectrum": _SPECTRUM,
    "tall_qr": _QR,
    "tall_svd": _SVD2,
    "least_squares": _CRAMER,
    "inverse_gram": "with g as (select avg(l_discount) as q, avg(l_discount * l_discount) as r from lineitem) select 0 as i, 0 as j, round(r / (r - q * q), 6) as v from g union all select 0, 1, round(-q / (r - q * q), 6) from g union all select 1, 0, round(-q / (r - q * q), 6) from g union all select 1, 1, round(1 / (r - q * q), 6) from g",
    "lookback_returning_runs": "with e as (select *, event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) as fresh from events), r as (select *, sum(fresh::int) over (partition by user_id order by ts, event_id) as run from e) select event_id, round(sum(value) over (partition by user_id, run order by ts, event_id rows between 3 preceding and current row), 6) as value from r",
    "network_to_vector_array": f"with {_STEPS}, codes(c, p) as (values {', '.join(f'({c!r}, {p})' for p, c in enumerate(CODES))}), cells as (select a.c as i, b.c as j, a.p as r, b.p as c, b.p * 5 + a.p as cell from codes a, codes b), v as (select u.user_id, r, c, cell, coalesce(w, 0.0)::double as w from (select distinct user_id from edges) u cross join cells k left join edges e on e.user_id = u.user_id and e.i = k.i and e.j = k.j) select user_id, 'full' as form, cell::int as k, w from v union all select user_id, 'upper', (c * (c - 1) // 2 + r)::int, w from v where r < c union all select user_id, 'diagonal', (c * (c + 1) // 2 + r)::int, w from v where r <= c",
    "rejected_inputs": "select * from (values ('finite', 'matrix must be finite'), ('dims', 'row must have 63 elements'), ('fold', 'a directed network needs n * n elements'), ('indices', 'row must be -1, 0 or 1')) t(name, said)",
    "matrix_forms": "select p_partkey, 0::int as dim, p_size::double as value from part union all select p_partkey, 1, p_retailprice from part",
    "checked_points": "select label, count(*) as n from embeddings group by 1",
}

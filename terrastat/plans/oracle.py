"""DuckDB SQL of the registered queries."""

from __future__ import annotations

import math

from .layers import BOXES, CUST, EMB, LI, LL

_GRID = f"""with {LI}, ext as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from li),
g as (select v, q, (greatest(0, least(ceil((y - y0) * (10 / (y1 - y0))) - 1, 9)) * 10 + greatest(0, least(ceil((x - x0) * (10 / (x1 - x0))) - 1, 9)) + 1)::bigint as cell_id from li, ext)"""
_KNN = "knn as (select a.row_id as i, b.row_id as j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as d2, row_number() over (partition by a.row_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.row_id) as r from pts a, pts b where a.row_id <> b.row_id)"
_LCG = "(row_id * 1103515245 + 42 * 12345) % 2147483648"
_GLI = "(grp::bigint * 1103515245 + 42 * 12345) % 2147483648"
_EXT = "ext as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pts)"
_NOTCH = f"{_EXT}, u as (select *, x0 + 0.3::double * (x1 - x0) as a, x0 + 0.7::double * (x1 - x0) as b, y0 + 0.25::double * (y1 - y0) as c from ext)"
_U_AREA = "(greatest(0, least(xmax, x1) - greatest(xmin, x0)) * greatest(0, least(ymax, y1) - greatest(ymin, y0)) - greatest(0, least(xmax, b) - greatest(xmin, a)) * greatest(0, least(ymax, y1) - greatest(ymin, c)))::double"
_U_RINGS = "case when greatest(ymin, y0) >= c - 1e-9 and xmin < a and xmax > b then 2 else 1 end::int"
_IN_U = "(x between x0 and x1 and y between y0 and y1 and not (x > a and x < b and y > c))"
_BOXED = "bx as (select row_id, grp, x as xmin, y as ymin, x + 10 + row_id % 90 as xmax, y + 20 + row_id % 70 as ymax from pts)"
_ARC = 60 * math.sin(math.pi / 60)  # area of a circle of 120 corners


#: Pareto-smoothed leave-one-out of 60 draws: 12 in the tail, a grid of 33 points
_LOO = f"""with {EMB}, d as (select row_id, k, -0.5 * (5 * w2 - ((k * 37) % 60 - 29.5::double) / 20 * (1 + w3 * w3)) ** 2 - 0.9189385332046727::double as ll from pts, range(1, 61) t(k)),
r as (select *, -ll - max(-ll) over (partition by row_id) as lw, row_number() over (partition by row_id order by -ll, k) as rn from d),
c as (select row_id, lw as cut from r where rn = 48),
t as (select r.row_id, rn - 48 as i, exp(lw) - exp(cut) as x from r join c using (row_id) where rn > 48),
s as (select row_id, max(x) as xn, max(case when i = 3 then x end) as xq, list(x) as xs from t group by row_id),
g as (select row_id, xs, 1 / xn + (1 - sqrt(33 / (j - 0.5::double))) / (3 * xq) as b from s, range(1, 34) u(j)),
l as (select row_id, b, list_avg(list_transform(xs, lambda x: ln(1 - b * x))) as k from g),
p as (select row_id, b, 12 * (ln(-b / k) - k - 1) as lk from l),
w as (select row_id, b, exp(lk - max(lk) over (partition by row_id)) as w from p),
best as (select row_id, sum(b * w) / sum(w) as b from w group by row_id),
f as (select s.row_id, b, list_avg(list_transform(xs, lambda x: ln(1 - b * x))) as k from s join best using (row_id)),
kh as (select row_id, (12 * k + 5) / 22 as k_hat, -k / b as sigma from f),
lws as (select r.row_id, ll, case when rn > 48 then least(0, ln(sigma * ((1 - (rn - 48 - 0.5::double) / 12) ** (-k_hat) - 1) / k_hat + exp(cut))) else lw end as lw, k_hat from r join c using (row_id) join kh using (row_id)),
loo as (select row_id, ln(sum(exp(lw + ll)) / sum(exp(lw))) as elpd, ln(sum(exp(ll)) / 60) - ln(sum(exp(lw + ll)) / sum(exp(lw))) as p_loo, any_value(k_hat) as k_hat from lws group by row_id)"""


def _vario(extra=""):
    return f"""with {EMB}, p as (select sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, (a.z-b.z)*(a.z-b.z) as sq, b.x-a.x as dx, b.y-a.y as dy from pts a, pts b where a.row_id < b.row_id)
select greatest(least(ceil(d/10)-1, 14), 0)::int as bin, count(*) as np, round(avg(d), 6) as dist, round(avg(sq)/2, 6) as gamma from p where d <= 150 and d > 0 {extra} group by 1"""


def _gwr(weight, where="", pairs="select a.row_id as i, b.row_id as j, a.w1 as ui, b.w1 as u, b.z as v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d from pts a, pts b"):
    return f"""with {EMB}, pr as ({pairs}), w as (select *, {weight} as w from pr {where}),
s as (select i, sum(w) s0, sum(w*u) s1, sum(w*u*u) s2, sum(w*v) t0, sum(w*u*v) t1, max(ui) ui, max(case when i=j then w end) wii from w group by i),
c as (select *, nullif(s0*s2-s1*s1, 0) as det from s)
select i as row_id, round((s2*t0-s1*t1)/det, 5) as intercept, round((s0*t1-s1*t0)/det, 5) as slope, round((s2*t0-s1*t1)/det + (s0*t1-s1*t0)/det*ui, 5) as fitted, round(wii*(s2-2*ui*s1+ui*ui*s0)/det, 5) as hat from c"""


def _folds(k):
    return f"r as (select *, row_number() over (order by {_LCG}, row_id) - 1 as rk, count(*) over () as n from pts), f as (select *, (case when rk < (n % {k}) * (n // {k} + 1) then rk // (n // {k} + 1) else (n % {k}) + (rk - (n % {k}) * (n // {k} + 1)) // (n // {k}) end + 1)::int as fold from r)"


_CV = f"""with {EMB}, {_folds(5)}, k as (select distinct fold from f),
b as (select k.fold, regr_slope(f.z, f.w1) as s, regr_intercept(f.z, f.w1) as c, avg(f.z) as m from k join f on f.fold <> k.fold group by k.fold),
o as (select row_id, f.fold, z as y, c + s * w1 as yhat, m as y_train_mean from f join b using (fold))"""

_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_S = 2 * math.sqrt(_N) / (1 + _N)
_RAD = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_AL = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
_EC = math.sqrt(_E2)
_QL = f"{1 - _E2!r} * (sin(radians(lat)) / (1 - {_E2!r} * sin(radians(lat)) * sin(radians(lat))) + atanh({_EC!r} * sin(radians(lat))) / {_EC!r})"


def _q(s):
    return (1 - _E2) * (s / (1 - _E2 * s * s) + math.atanh(_EC * s) / _EC)


def _albers(one, two, lat0, lon0):
    one, two, lat0 = map(math.radians, (one, two, lat0))
    m = [math.cos(p) / math.sqrt(1 - _E2 * math.sin(p) ** 2) for p in (one, two)]
    q = [_q(math.sin(p)) for p in (one, two, lat0)]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    return f"""with {LL}, t as (select row_id, {6378137.0 / n!r} * sqrt({c!r} - {n!r} * {_QL}) as rho, {n!r} * radians(lon - ({lon0})) as th from pts)
select row_id, round(rho * sin(th), 3) as x, round({6378137.0 * math.sqrt(c - n * q[2]) / n!r} - rho * cos(th), 3) as y from t"""


def _laea(lat0, lon0):
    p0, qp = math.radians(lat0), _q(1.0)
    b0, rq = math.asin(_q(math.sin(p0)) / qp), 6378137.0 * math.sqrt(qp / 2)
    d = 6378137.0 * math.cos(p0) / math.sqrt(1 - _E2 * math.sin(p0) ** 2) / (rq * math.cos(b0))
    sb, cb = math.sin(b0), math.cos(b0)
    return f"""with {LL}, t as (select row_id, asin(({_QL}) / {qp!r}) as beta, radians(lon - ({lon0})) as l from pts),
u as (select *, {rq!r} * sqrt(2 / (1 + {sb!r} * sin(beta) + {cb!r} * cos(beta) * cos(l))) as b from t)
select row_id, round(b * {d!r} * cos(beta) * sin(l), 3) as x, round(b / {d!r} * ({cb!r} * sin(beta) - {sb!r} * cos(beta) * cos(l)), 3) as y from u"""


def _aoa(train, preds, weights, cond, new=None):
    w = [x * len(preds) / sum(weights) for x in weights]
    z = ", ".join(f"({p} - (select avg({p}) from tr)) / (select stddev_samp({p}) from tr) * {w[k]!r} as z{k}" for k, p in enumerate(preds))
    d2 = " + ".join(f"(a.z{k} - b.z{k}) * (a.z{k} - b.z{k})" for k in range(len(preds)))
    base = f"""with {EMB}, tr as (select * from pts where {train}), tz as (select row_id, {z} from tr),
nrm as (select avg(sqrt({d2})) as m from tz a, tz b where a.row_id < b.row_id),
td as (select a.row_id, sqrt(min({d2})) / (select m from nrm) as di from tz a, tz b where {cond} group by a.row_id)"""
    if not new:
        return base + " select row_id, round(di, 6) as di from td"
    return base + f""", q as (select quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) as fence from td),
th as (select coalesce(max(case when di <= fence then di end), max(di)) as t from td, q), nz as (select row_id, {z} from pts where {new}),
nd as (select a.row_id, sqrt(min({d2})) / (select m from nrm) as di from nz a, tz b group by a.row_id)
select row_id, round(di, 6) as "DI", di <= t as "AOA" from nd, th"""


_BX = """bx as (select row_id, x as x0, y as y0, x + 10 + row_id % 90 as x1, y + 20 + row_id % 70 as y1 from pts),
ov as (select row_id, cell_id, (least(x1, xmax) - greatest(x0, xmin)) * (least(y1, ymax) - greatest(y0, ymin)) as a, (xmax - xmin) * (ymax - ymin) as s
  from bx, boxes where x0 <= xmax and xmin <= x1 and y0 <= ymax and ymin <= y1)"""
_EDGE2 = "greatest(xmin - x, 0, x - xmax) * greatest(xmin - x, 0, x - xmax) + greatest(ymin - y, 0, y - ymax) * greatest(ymin - y, 0, y - ymax)"
_TRI = "d as (select row_id, x, y, (3 + row_id % 40)::double as a, (5 + row_id % 30)::double as b from pts)"
_MORAN = """m as (select avg(z) as m from v), e as (select row_id, z - m as e from v, m),
q as (select sum(e*e) q2, sum(e*e*e*e) q4, count(*)::double as n from e),
s as (select sum(w.w) s0, sum(w.w * a.e * b.e) as cr, sum(w.w*w.w + w.w*coalesce(t.w, 0)) as s1 from w join e a on a.row_id = w.i join e b on b.row_id = w.j left join w t on t.i = w.j and t.j = w.i),
p as (select sum(t*t) as s2 from (select p, sum(w) as t from (select i as p, w from w union all select j, w from w) group by p)),
mo as (select n, s0, n/s0*cr/q2 as mi, -1/(n-1) as ex, (n*((n*n-3*n+3)*s1-n*s2+3*s0*s0) - (q4/n)/((q2/n)*(q2/n))*((n*n-n)*s1-2*n*s2+6*s0*s0)) / ((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1)) as va from q, s, p)"""
_METRICS = """a as (select count(*) as n, sqrt(avg((y-f)*(y-f))) as r, avg(abs(y-f)) as ma, 100 * avg(case when abs(y) > 2.220446049250313e-14 then abs(y-f)/abs(y) end) as mp, 100 * avg(case when abs(y)+abs(f) > 2.220446049250313e-14 then 2*abs(y-f)/(abs(y)+abs(f)) end) as sm, 1 - sum((y-f)*(y-f))/sum((y-b)*(y-b)) as r2 from d)
select n, round(r, 6) as "RMSE", round(ma, 6) as "MAE", round(mp, 6) as "MAPE", round(sm, 6) as "SMAPE", round(r2, 6) as "R2", null::double as "Adj_R2" from a"""


def _three(sums, tail):
    """Weighted least squares on two predictors and an intercept by Cramer's rule, from sums s00 .. s22, t0 .. t2."""
    det = lambda a, b, c: f"({a[0]}*({b[1]}*{c[2]}-{b[2]}*{c[1]}) - {a[1]}*({b[0]}*{c[2]}-{b[2]}*{c[0]}) + {a[2]}*({b[0]}*{c[1]}-{b[1]}*{c[0]}))"
    rows = [["s00", "s01", "s02"], ["s01", "s11", "s12"], ["s02", "s12", "s22"]]
    put = lambda k: [[f"t{i}" if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    return f"sm as ({sums}), be as (select *, {det(*rows)} as det from sm), co as (select *, {', '.join(f'{det(*put(k))}/det as b{k}' for k in range(3))} from be) {tail}"


def _more():
    blocks = "(greatest(0, least(ceil((y - y0) * (NY / (y1 - y0))) - 1, NY - 1)) * NX + greatest(0, least(ceil((x - x0) * (NX / (x1 - x0))) - 1, NX - 1)))::int"
    l_area = "(greatest(0, least(cx + 120, x1) - cx) * greatest(0, least(cy + 120, ym) - cy) + greatest(0, least(cx + 120, xm) - cx) * greatest(0, least(cy + 120, y1) - greatest(cy, ym)))::double"
    w2 = "sum(w) s00, sum(w*u1) s01, sum(w*u2) s02, sum(w*u1*u1) s11, sum(w*u1*u2) s12, sum(w*u2*u2) s22, sum(w*v) t0, sum(w*u1*v) t1, sum(w*u2*v) t2"
    q = math.sqrt(2 * math.log(20))
    return {
        "layer_from_table": "select row_number() over (order by s_acctbal desc, s_suppkey) as row_id, s_acctbal as x, s_nationkey::double as y, s_suppkey from supplier",
        "prepared_rows": f"with {EMB} select row_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from pts where row_id % 13 <> 0 and row_id % 11 <> 0 and row_id % 7 <> 0",
        "polygon_measures": f"with {CUST}, {_TRI} select row_id, a * b / 2 as area, round(a + b + sqrt(a*a + b*b), 6) as perimeter, round(x + a / 3, 6) as cx, round(y + b / 3, 6) as cy, x + a / 2 as mx, y + b / 2 as my, round(x + a / 4, 6) as sx, y + b / 2 as sy from d",
        "coerced_lines": f"with {CUST}, {_TRI} select row_id, a + b as length, case when (a + b) / 2 <= a then x + (a + b) / 2 else x + a end as x, case when (a + b) / 2 <= a then y else y + (a + b) / 2 - a end as y from d",
        "assign_polygons_largest": f"with {CUST}, {BOXES}, {_BX}, r as (select *, row_number() over (partition by row_id order by round(a, 9) desc, cell_id) as k from ov) select bx.row_id, r.cell_id from bx left join r on r.row_id = bx.row_id and k = 1",
        "assign_polygons_smallest": f"with {CUST}, {BOXES}, {_BX}, r as (select *, row_number() over (partition by row_id order by s, cell_id) as k from ov) select row_id, cell_id from r where k = 1",
        "polygon_overlaps": f"with {CUST}, {BOXES}, {_BX} select row_id as feature_id, cell_id, round(a, 6)::double as overlap from ov",
        "cells_within_distance": f"with {CUST}, {BOXES} select row_id, cell_id from pts, boxes where {_EDGE2} <= 625",
        "points_within_cells": f"with {CUST}, {BOXES} select row_id, cell_id from pts, boxes where x > xmin and x < xmax and y > ymin and y < ymax",
        "grid_clipped": f"""with {CUST}, {_EXT}, l as (select *, x0 + 0.41::double * (x1 - x0) as xm, y0 + 0.33::double * (y1 - y0) as ym, ceil((x1 - x0) / 120)::bigint as nx, ceil((y1 - y0) / 120)::bigint as ny from ext),
c as (select *, iy * nx + ix as i, x0 + ix * 120.0::double as cx, y0 + iy * 120.0::double as cy from (select *, unnest(range(nx)) as ix from l), (select unnest(range(ny)) as iy from l)),
m as (select *, {l_area} as area from c) select row_number() over (order by i) as cell_id, round(area, 6) as area, round(cx, 6) as xmin, round(cy, 6) as ymin from m where area > 1e-8""",
        "grid_by_target": f"""with {CUST}, {_EXT}, d as (select *, greatest(1, round(sqrt(24 * (x1 - x0) / (y1 - y0)))::bigint) as nx from ext), n as (select *, greatest(1, ceil(24::double / nx))::bigint as ny from d)
select (iy * nx + ix + 1)::bigint as cell_id, round(x0 + ix * ((x1 - x0) / nx), 6) as xmin, round(y0 + iy * ((y1 - y0) / ny), 6) as ymin, round((x1 - x0) / nx * ((y1 - y0) / ny), 4) as area from (select *, unnest(range(nx)) as ix from n), (select unnest(range(ny)) as iy from n)""",
        "grid_pieces": f"""with {CUST}, {_NOTCH}, g as (select *, x0 + ix * ((x1 - x0) / 3) as xmin, x0 + (ix + 1) * ((x1 - x0) / 3) as xmax, y0 + iy * ((y1 - y0) / 5) as ymin, y0 + (iy + 1) * ((y1 - y0) / 5) as ymax from u, range(3) s(ix), range(5) t(iy)),
m as (select *, {_U_AREA} as area, {_U_RINGS} as n_rings from g), k as (select *, row_number() over (order by iy * 3 + ix) as cell_id from m where area > 1e-8)
select cell_id, any_value(n_rings) as n_rings, round(any_value(area), 6) as area, count(x) as inside from k left join pts on x > xmin and x < xmax and y > ymin and y < ymax and not (x >= a and x <= b and y >= c) group by cell_id""",
        "polygon_pieces": f"with {CUST}, {_NOTCH}, {_BOXED}, m as (select row_id, {_U_AREA} as area, {_U_RINGS} as n_rings from bx, u) select row_id as feature_id, n_rings, round(area, 6) as area from m where area > 1e-9",
        "polygons_repaired": f"with {CUST}, {_BOXED} select row_id, 2::int as n_rings, round((xmax - xmin) * (ymax - ymin) / 2, 5)::double as area, round(xmin, 6) as xmin, round(ymax, 6) as ymax from bx",
        "polygons_buffered": f"""with {CUST}, {_BOXED}, r as (select *, xmax - xmin as w, ymax - ymin as h, reach from bx, (values (7.5::double), (-12.0::double)) t(reach))
select row_id, reach, case when reach > 0 or (w > 24 and h > 24) then 1 else 0 end::int as n_rings, round(case when reach > 0 then w * h + 2 * (w + h) * reach + {_ARC!r}::double * reach * reach when w > 24 and h > 24 then (w - 24) * (h - 24) else 0 end, 4)::double as area,
case when reach > 0 or (w > 24 and h > 24) then round(xmin - reach, 6) end as xmin, case when reach > 0 or (w > 24 and h > 24) then round(ymax + reach, 6) end as ymax from r""",
        "polygons_dissolved": f"""with {CUST}, {_BOXED}, xs as (select distinct grp, unnest([xmin, xmax]) as x from bx), sx as (select grp, x, lead(x) over (partition by grp order by x) as x2 from xs),
st as (select sx.grp, x, x2, ymin, ymax, max(ymax) over (partition by sx.grp, x order by ymin, ymax rows between unbounded preceding and 1 preceding) as before from sx join bx on bx.grp = sx.grp and bx.xmin <= x and bx.xmax >= x2 where x2 is not null),
area as (select grp, sum((x2 - x) * greatest(0, ymax - greatest(ymin, coalesce(before, ymin)))) as area from st group by grp)
select bx.grp, round(any_value(area), 4)::double as area, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from bx join area on area.grp = bx.grp group by bx.grp""",
        "clip_target_area": f"""with {CUST}, {_NOTCH}, d as (select *, x1 - x0 as w, y1 - y0 as h, 0.1::double * greatest(x1 - x0, y1 - y0) as r from u)
select t as target, 1::int as n_rings, round(case t when 'box' then w * h when 'grown' then w * h + 2 * (w + h) * r + {_ARC!r}::double * r * r
  else w * h - (b - a) * (y1 - c) + 25 * (2 * w + 2 * h + 2 * (y1 - c)) + {1.5 * _ARC!r}::double * 625 - 2 * 625 end, 4)::double as area from d, (values ('box'), ('grown'), ('notched')) v(t)""",
        "assign_nearest_centroid": f"""with {CUST}, {BOXES}, m as (select pts.row_id, b.cell_id, row_number() over (partition by pts.row_id order by (xmax-xmin)*(ymax-ymin), b.cell_id) as r from pts join boxes b on x between xmin and xmax and y between ymin and ymax), c as (select pts.row_id, cell_id, row_number() over (partition by pts.row_id order by (x-(xmin+xmax)/2)*(x-(xmin+xmax)/2)+(y-(ymin+ymax)/2)*(y-(ymin+ymax)/2), cell_id) as r from pts, boxes)
select pts.row_id, coalesce(m.cell_id, c.cell_id) as cell_id from pts left join m on m.row_id = pts.row_id and m.r = 1 join c on c.row_id = pts.row_id and c.r = 1""",
        "points_by_own_predicate": f"with {CUST}, {BOXES} select row_id, cell_id from pts, boxes where x >= xmin + 15 and x <= xmax - 15 and y >= ymin + 15 and y <= ymax - 15",
        "layer_quantiles": f"with {CUST} select p, round(v, 6) as value from (select unnest([0.0::double, 0.1, 0.25, 0.5, 0.9, 1.0]) as p, unnest(quantile_cont(z, [0.0::double, 0.1, 0.25, 0.5, 0.9, 1.0])) as v from pts)",
        "gwr_condition": f"""with {EMB}, k as (select a.row_id as i, b.w1 as u, b.w2 as v, row_number() over (partition by a.row_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.row_id) as r from pts a, pts b),
g as (select i, count(*) as n, sum(u*u) as a, sum(u*v) as b, sum(v*v) as d from k where r <= 40 group by i), e as (select *, sqrt((a-d)*(a-d)/4 + b*b) as w from g)
select i as row_id, n, round(sqrt(((a+d)/2 + w) / ((a+d)/2 - w)), 5) as condition from e""",
        "coerced_mixed": f"""with {CUST}, s as (select row_id, x, y, 3.0::double + row_id % 40 as a, 5.0::double + row_id % 30 as b from pts)
select row_id, case row_id % 3 when 0 then 'point' when 1 then 'line' else 'polygon' end as kind, round(case row_id % 3 when 0 then x when 1 then x + least(a, (a + b) / 2) else x + a / 4 end, 6) as x,
round(case row_id % 3 when 0 then y when 1 then y + greatest(0, (b - a) / 2) else y + b / 2 end, 6) as y from s""",
        "cell_summary_own": f"""with {CUST}, l as (select grp, count(*) as n, avg(z) as m, max(z) as t, list_sort(list(z)) as l from pts group by grp)
select grp, n, round(m, 5) as resp_mean_z, round(t, 5) as resp_top_z, round(list_avg(list_slice(l, n // 10 + 1, n - n // 10)), 5) as resp_trimmed_z, round(m, 5) as resp_odd_z from l""",
        "random_points_inside": "select 800::bigint as n, 0::bigint as outside, true as even from (select count(*) from customer)",
        "seeds_kmeans_inside": f"with {CUST} select 'kmeans' as method, 12::bigint as n, 12::bigint as last, 12::bigint as within union all select 'provided', count(*), count(*), count(*) from pts",
        "gp_recovered": "select count(*) as n, 1.0::double as r2, 50.0::double as slope_w1, 5.0::double as slope_w2, true as chains_agree from embeddings",
        "psis_loo": f"{_LOO} select row_id, round(elpd, 5) as elpd, round(p_loo, 5) as p_loo, round(k_hat, 5) as k_hat from loo",
        "loo_summary": f"{_LOO} select count(*) as n, round(sum(elpd), 3) as elpd, round(sqrt(count(*) * var_samp(elpd)), 3) as se, round(sum(p_loo), 3) as p_loo, round(-2 * sum(elpd), 3) as looic, sum((k_hat > 0.5)::int)::bigint as high_k from loo",
        "voronoi_cells": f"""with {CUST}, s as (select * from (select row_id, x, y, row_number() over (partition by x, y order by row_id) as r from pts) where r = 1),
nb as (select * from (select a.row_id, b.x - a.x as a, b.y - a.y as b, row_number() over (partition by a.row_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.row_id) as k from s a, s b where a.row_id <> b.row_id) where k <= 40),
h as (select row_id, a, b, (a * a + b * b) / 2 as c, k from nb union all select row_id, -1, 0, x, 41 from s union all select row_id, 1, 0, 1000 - x, 42 from s union all select row_id, 0, -1, y, 43 from s union all select row_id, 0, 1, 1009 - y, 44 from s),
l as (select row_id, list({{'a': a, 'b': b, 'c': c}}) as l from h group by row_id),
v as (select p.row_id, (p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b) as x, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) as y from h p join h q on p.row_id = q.row_id and p.k < q.k where p.a * q.b - q.a * p.b <> 0),
w as (select v.row_id, x, y, row_number() over (partition by v.row_id order by atan2(y, x)) as i, count(*) over (partition by v.row_id) as n from v join l using (row_id) where list_bool_and(list_transform(l.l, lambda e: e.a * x + e.b * y <= e.c + 1e-7)))
select p.row_id as cell_id, round(sum(p.x * q.y - q.x * p.y) / 2, 6) as area from w p join w q on p.row_id = q.row_id and q.i = p.i % p.n + 1 group by p.row_id""",
        # a circle through two points has its centre on their bisector; each third point bounds the place from one side
        "delaunay_triangles": f"""with {EMB}, s as (select row_id, x, y from (select *, row_number() over (partition by round(x, 10), round(y, 10) order by row_id) as r from pts) where r = 1),
p as (select i.row_id as i, j.row_id as j, j.x - i.x as ax, j.y - i.y as ay, i.x, i.y from s i join s j on i.row_id < j.row_id),
q as (select i, j, k, c > 0 as above, (dx * dx + dy * dy - ax * dx - ay * dy) / (2 * c) as t from (select i, j, k.row_id as k, ax, ay, k.x - p.x as dx, k.y - p.y as dy, ax * (k.y - p.y) - ay * (k.x - p.x) as c from p, s k where k.row_id <> i and k.row_id <> j) where c <> 0),
e as (select i, j, min(t) filter (above) as hi, arg_min(k, t) filter (above) as u, max(t) filter (not above) as lo, arg_max(k, t) filter (not above) as v from q group by i, j),
k as (select i, j, unnest([u, v]) as k from e where hi is null or lo is null or lo < hi),
t as (select distinct list_sort([i, j, k]) as t from k where k is not null)
select t[1] as a, t[2] as b, t[3] as c, round(abs((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) / 2, 6) as area from t join s p on p.row_id = t[1] join s q on q.row_id = t[2] join s r on r.row_id = t[3]""",
        "voronoi_clipped": f"""with {CUST}, {_NOTCH}, n as (select *, floor((x1 - x0 - 0.137::double) / 23.17)::bigint as nx, floor((y1 - y0 - 0.211::double) / 23.17)::bigint as ny from u),
g as (select (iy * nx + ix + 1)::bigint as gid, x0 + 0.137::double + 23.17::double / 2 + ix * 23.17::double as x, y0 + 0.211::double + 23.17::double / 2 + iy * 23.17::double as y, x0, x1, y0, y1, a, b, c from (select *, unnest(range(nx)) as ix from n), (select unnest(range(ny)) as iy from n)),
k as (select * from g where {_IN_U}), s as (select * from (select row_id, x, y, row_number() over (partition by x, y order by row_id) as r from pts) where r = 1),
near as (select gid, s.row_id as seed, s.x as x, s.y as y, x0, x1, y0, y1, a, b, c, row_number() over (partition by gid order by (k.x-s.x)*(k.x-s.x)+(k.y-s.y)*(k.y-s.y), s.row_id) as r from k, s)
select gid as row_id, 1::bigint as n_cells, case when {_IN_U} then seed else -1 end::bigint as seed from near where r = 1""",
        "clip_extent": f"with {CUST}, e as (select min(x) a, max(x) b, min(y) c, max(y) d from pts), p as (select *, 0.1::double * greatest(b - a, d - c) as p from e) select round(a - p, 6) as x0, round(b + p, 6) as x1, round(c - p, 6) as y0, round(d + p, 6) as y1 from p",
        "reprojected": f"with {LL} select row_id, s as system, round(lon::double, 6) as x, round(lat::double, 6) as y from pts, (values ('utm'), ('webmerc'), ('albers'), ('laea')) t(s)",
        "harmonized": f"""with {LL}, t as (select row_id, sinh(atanh(sin(radians(lat))) - {_S!r} * atanh({_S!r} * sin(radians(lat)))) as t, radians(lon + 81) as l from pts),
u as (select row_id, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t*t)) as et from t)
select row_id, round(500000 + {0.9996 * _RAD!r} * (et + {' + '.join(f'{a!r} * cos({2 * j} * xi) * sinh({2 * j} * et)' for j, a in enumerate(_AL, 1))}), 3) as x, round({0.9996 * _RAD!r} * (xi + {' + '.join(f'{a!r} * sin({2 * j} * xi) * cosh({2 * j} * et)' for j, a in enumerate(_AL, 1))}), 3) as y,
case when row_id % 2 = 0 then 'a' else 'b' end as layer, 'utm' as system from u""",
        "nearest_distance": f"with {EMB}, g as (select (iy * 20 + ix + 1)::bigint as row_id, -475 + ix * 50.0 as x, -475 + iy * 50.0 as y from range(20) a(ix), range(20) b(iy)) select g.row_id, round(sqrt(min((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y))), 6) as d from g, pts p group by g.row_id",
        "ranks_with_ties": f"with {CUST}, v as (select *, floor(z / 500) as v from pts) select row_id, rank() over (partition by grp order by v) + (count(*) over (partition by grp, v) - 1) / 2.0::double as rank from v",
        "cell_summary_all_cells": f"with {CUST}, {BOXES}, every as (select * from boxes union all select 9, xmin + 5000, ymin, xmax + 5000, ymax from boxes where cell_id = 2), h as (select pts.row_id, z, e.cell_id, row_number() over (partition by pts.row_id order by (xmax-xmin)*(ymax-ymin), e.cell_id) as r from pts join every e on x between xmin and xmax and y between ymin and ymax ), s as (select cell_id, count(*) as n, avg(z) as m, stddev_samp(z) as sd from h where r = 1 group by cell_id) select e.cell_id, n, round(m, 6) as resp_mean_z, round(sd, 6) as sd_resp_z, round(sd / sqrt(n), 6) as se_resp_z, n::double as cell_weight from every e left join s using (cell_id)",
        "cell_summary_variogram": f"with {CUST}, g as (select grp, count(*) as n, avg(z) as m, stddev_samp(z) as sd from pts group by grp), u as (select * from (select *, row_number() over (partition by grp order by {_LCG}, row_id) as k from pts) where k <= 500), s as (select a.grp, sum(least(1, 0.8 * exp(-sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 60))) as s from u a join u b on a.grp = b.grp and a.row_id < b.row_id group by a.grp), f as (select g.*, greatest(1, least(1 + 2 * coalesce(s, 0) / least(n, 500), least(n, 500))) as d from g left join s using (grp)) select grp, n, round(m, 6) as resp_mean_z, round(sd, 6) as sd_resp_z, round(sd / sqrt(n / d), 6) as se_resp_z, round(n / d, 6)::double as cell_weight from f",
        "cv_ols_overall": _CV + ", d as (select y, yhat as f, y_train_mean as b from o), " + _METRICS,
        "folds_remapped": f"with {CUST}, {_folds(7)} select fold, count(*) as n, sum(row_id)::bigint as ids from f where z > 0 group by fold",
        "folds_without_rows": f"with {EMB}, s as (select * from pts) select a.row_id as fold, count(*) filter (where a.row_id <> b.row_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 6400) as n_train from s a, s b group by a.row_id",
        "ols_predictions": f"with {EMB}, " + _three("select " + w2.replace("sum(w)", "count(*)::double").replace("sum(w*", "sum(") + " from (select w1 as u1, w2 as u2, z as v from pts where row_id % 3 <> 0)", "select row_id, case when row_id % 17 <> 0 then round(b0 + b1 * w1 + b2 * w2, 6) end as pred from pts, co"),
        "ols_metrics": f"with {EMB}, k as (select regr_slope(z, w1) as s, regr_intercept(z, w1) as c, avg(z) as m from pts), d as (select z as y, c + s * w1 as f, m as b from pts, k), " + _METRICS,
        "residual_moran": f"with {EMB}, {_KNN}, w as (select i, j, 0.125 as w from knn where r <= 8), k as (select regr_slope(z, w1) as s, regr_intercept(z, w1) as c from pts), v as (select row_id, z - c - s * w1 as z from pts, k), " + _MORAN + " select 'linear' as model, n::bigint as n, round(mi, 6)::double as moran, round((mi-ex)/sqrt(va), 6)::double as z from mo",
        "gp_basis": f"with {EMB}, u as (select * from pts order by {_LCG}, row_id limit 1000), d as (select sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d from u a, u b where a.row_id < b.row_id), b as (select quantile_cont(d, 0.25) / {q!r} as lo, max(d) / {q!r} as h from d where d > 0), c as (select lo, greatest(h, 1.2::double * lo) as hi from b), e as (select *, greatest(3.2::double * hi / 500, 1.2::double) as c from c), f as (select *, greatest(10, ceil(1.75::double * c / (lo / 500))) as want from e) select round(lo, 6) as low, round(hi, 6) as high, least(want, 50)::int as k, round(c, 6) as c, want > 50 as capped from f",
        "gwr_fit_local": f"with {EMB}, pr as (select a.row_id as i, b.w1 as u1, b.w2 as u2, b.z as v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, row_number() over (partition by a.row_id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.row_id) as rk from pts a, pts b), bw as (select *, max(case when rk <= 80 then d end) over (partition by i) as b from pr), w as (select *, case when d < b then (1 - d/b*d/b) * (1 - d/b*d/b) else 0 end as w from bw), " + _three(f"select i, {w2} from w group by i", "select i as row_id, round(b0, 4) as intercept, round(b1, 4) as w1, round(b2, 4) as w2 from co"),
        "folds_block": f"""with recursive {CUST}, ext as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pts), dim as (select *, greatest(1, round_even(sqrt(15 * (x1 - x0) / (y1 - y0)), 0)) as nx from ext), dims as (select *, greatest(1, round_even(15 / nx, 0)) as ny from dim),
b as (select row_id, {blocks.replace("NX", "nx").replace("NY", "ny")} as block from pts, dims), z as (select block, count(*) as n from b group by block), r as (select *, row_number() over (order by n desc, block) as k from z), c as (select least(5, count(*)) as k from z),
s(k, loads, fold, block) as (select 0::bigint, list_transform(range(c.k), lambda i: 0::bigint), 0::bigint, -1 from c
  union all select r.k, list_transform(range(1, len(loads) + 1), lambda i: loads[i] + case when i = list_position(loads, list_min(loads)) then r.n else 0 end), list_position(loads, list_min(loads))::bigint, r.block from s join r on r.k = s.k + 1)
select b.row_id, s.fold::int as fold from b join s using (block)""",
    }


def oracle_sql():
    hexstep, hexnx = 250 * math.sqrt(3) / 2, 9
    hexd = lambda r: f"greatest(0, least(round((x - 0 - (({r}) % 2) * 125) / 250), {hexnx - 1}))"
    hexq = lambda r: f"(x - ({hexd(r)} * 250 + (({r}) % 2) * 125)) * (x - ({hexd(r)} * 250 + (({r}) % 2) * 125)) + (y - ({r}) * {hexstep!r}) * (y - ({r}) * {hexstep!r})"
    near = lambda t: f"select pts.row_id, b.cell_id, row_number() over (partition by pts.row_id order by {t}) as r from pts join boxes b on x between xmin and xmax and y between ymin and ymax"
    edge = "sqrt(greatest(xmin - x, 0, x - xmax) * greatest(xmin - x, 0, x - xmax) + greatest(ymin - y, 0, y - ymax) * greatest(ymin - y, 0, y - ymax))"
    grid = lambda s: f"select (iy * {1000 // s} + ix + 1)::bigint as row_id, -500 + {s} / 2.0 + ix * {s} as x, -500 + {s} / 2.0 + iy * {s} as y from range({1000 // s}) a(ix), range({1000 // s}) b(iy)"
    return _more() | {
        "cell_summary_square": _GRID + " select cell_id, count(*) as n, round(avg(v), 6) as resp_mean_v, round(stddev_samp(v), 6) as sd_resp_v, round(stddev_samp(v) / sqrt(count(v)), 6) as se_resp_v, round(avg(q), 6) as pred_mean_q, round(stddev_samp(q), 6) as sd_pred_q, round(stddev_samp(q) / sqrt(count(q)), 6) as se_pred_q, count(*)::double as cell_weight from g group by cell_id",
        "cell_summary_fixed_deff": _GRID + " select cell_id, count(*) as n, round(avg(v), 6) as resp_mean_v, round(max(v), 6) as resp_max_v, round(stddev_samp(v), 6) as sd_resp_v, round(stddev_samp(v) / sqrt(count(v) / 2.0), 6) as se_resp_v, round(count(*) / 2.0, 6) as cell_weight from g group by cell_id",
        "cell_summary_kish": _GRID + """, s as (select avg(v) m, stddev_samp(v) s from g), z as (select cell_id, (v - m) / s as z from g, s),
c as (select cell_id, count(*) n, avg(z) m, var_pop(z) v from z group by cell_id), t as (select sum(n)::double as nn, count(*) as k, sum(n*n)::double as q, sum(n*m) as nm, sum(n*v) as ssw from c),
b as (select sum(c.n * (c.m - t.nm/t.nn) * (c.m - t.nm/t.nn)) as ssb from c, t),
r as (select least(1, greatest(0, (ssb/(k-1) - ssw/(nn-k)) / (ssb/(k-1) + ((nn - q/nn)/(k-1) - 1) * (ssw/(nn-k))))) as rho from t, b)
select cell_id, count(*) as n, round(avg(v), 6) as resp_mean_v, round(stddev_samp(v), 6) as sd_resp_v, round(stddev_samp(v) / sqrt(count(v) / greatest(1, 1 + (count(v) - 1) * max(rho))), 6) as se_resp_v, round(count(*) / greatest(1, 1 + (count(*) - 1) * max(rho)), 6) as cell_weight from g, r group by cell_id""",
        "cell_summary_hex": f"""with {LI}, r as (select *, floor(y / {hexstep!r})::bigint as lo from li), c as (select *, {hexq('lo')} as d0, {hexq('lo + 1')} as d1, (lo * {hexnx} + {hexd('lo')} + 1)::bigint as c0, ((lo + 1) * {hexnx} + {hexd('lo + 1')} + 1)::bigint as c1 from r)
select case when d0 < d1 or (d0 = d1 and c0 < c1) then c0 else c1 end as cell_id, count(*) as n, round(avg(v), 6) as resp_mean_v, round(stddev_samp(v), 6) as sd_resp_v, round(stddev_samp(v) / sqrt(count(v)), 6) as se_resp_v, count(*)::double as cell_weight from c group by 1""",
        "cell_variogram_deff": f"with {CUST}, u as (select * from (select *, row_number() over (partition by grp order by {_LCG}, row_id) as k from pts) where k <= 500), n as (select grp, count(*) as n_used from u group by grp), s as (select a.grp, sum(least(1, 0.8 * exp(-sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 60))) as s from u a join u b on a.grp = b.grp and a.row_id < b.row_id group by a.grp) select grp, n_used, round(greatest(1, least(1 + 2 * coalesce(s, 0) / n_used, n_used)), 6)::double as deff from n left join s using (grp)",
        "assign_smallest_area": f"with {CUST}, {BOXES}, m as ({near('(xmax-xmin)*(ymax-ymin), b.cell_id')}) select row_id, cell_id from m where r = 1",
        "assign_keep_unassigned": f"with {CUST}, {BOXES}, m as ({near('b.cell_id')}) select pts.row_id, m.cell_id from pts left join m on m.row_id = pts.row_id and r = 1",
        "point_cell_index": f"with {CUST}, {BOXES}, d as (select pts.row_id, cell_id, row_number() over (partition by pts.row_id order by {edge}, cell_id) as r from pts, boxes) select row_id, cell_id from d where r = 1",
        "voronoi_assign": f"with {CUST}, d as (select a.row_id, b.row_id as cell_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, row_number() over (partition by a.row_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.row_id) as r from pts a, pts b where b.row_id % 50 = 0) select row_id, cell_id, round(d, 6) as d from d where r = 1",
        "points_dedup": f"with {CUST}, d as (select *, row_number() over (partition by round(x, -2), round(y, -2) order by row_id) as r from pts) select row_id, x, y from d where r = 1",
        "stable_cell_ids": f"with {CUST}, {_EXT}, c as (select x0 + ix * ((x1 - x0) / 7) as xmin, y0 + iy * ((y1 - y0) / 5) as ymin, (x1 - x0) / 7 as w, (y1 - y0) / 5 as h, ix, iy from ext, range(7) a(ix), range(5) b(iy)) select row_number() over (order by ix, iy) as cell_id, round(xmin, 6) as xmin, round(ymin, 6) as ymin, round(w * h, 4) as area from c",
        "grid_prediction_points": f"with {CUST}, {_EXT}, n as (select *, floor((x1 - x0) / 30)::bigint as nx, floor((y1 - y0) / 30)::bigint as ny from ext) select (iy * nx + ix + 1)::bigint as row_id, (x0 + 15 + ix * 30)::double as x, (y0 + 15 + iy * 30)::double as y from (select *, unnest(range(nx)) as ix from n), (select unnest(range(ny)) as iy from n)",
        "knn_weights": f"with {EMB}, {_KNN} select i, j, 0.125::double as w from knn where r <= 8",
        "distance_pairs": f"with {CUST} select a.row_id as i, b.row_id as j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) as d from pts a, pts b where (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400",
        "knn_five": f"with {CUST}, {_KNN} select i, j, round(sqrt(d2), 6) as d, r::int as rank from knn where r <= 5",
        "morans_i": f"""with {EMB}, {_KNN}, w as (select i, j, 0.125 as w from knn where r <= 8), m as (select avg(z) as m from pts), e as (select row_id, z - m as e from pts, m),
q as (select sum(e*e) q2, sum(e*e*e*e) q4, count(*)::double as n from e),
s as (select sum(w.w) s0, sum(w.w * a.e * b.e) as cr, sum(w.w*w.w + w.w*coalesce(t.w, 0)) as s1 from w join e a on a.row_id = i join e b on b.row_id = w.j left join w t on t.i = w.j and t.j = w.i),
p as (select sum(t*t) as s2 from (select p, sum(w) as t from (select i as p, w from w union all select j, w from w) group by p)),
v as (select n, s0, n/s0*cr/q2 as mi, -1/(n-1) as ex, (n*((n*n-3*n+3)*s1-n*s2+3*s0*s0) - (q4/n)/((q2/n)*(q2/n))*((n*n-n)*s1-2*n*s2+6*s0*s0)) / ((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1)) as va from q, s, p)
select n::bigint as n, round(mi, 8)::double as "I", round(ex, 8) as expected, round(va, 8)::double as variance, round((mi-ex)/sqrt(va), 8)::double as z from v""",
        "variogram_omni": _vario(),
        "variogram_north": _vario(f"and abs(dy) / d >= {math.cos(math.radians(22.5)) - 1e-12!r}"),
        "folds_random": f"with {CUST}, {_folds(7)} select row_id, fold from f",
        "folds_location": f"with {CUST}, g as (select grp, ((row_number() over (order by {_GLI}, grp::varchar) - 1) % 4 + 1)::int as fold from (select distinct grp from pts)) select row_id, fold from pts join g using (grp)",
        "folds_buffered": f"with {EMB} select a.row_id as fold, count(*) filter (where a.row_id <> b.row_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 2500) as excluded from pts a, pts b group by a.row_id",
        "folds_nndm": f"""with {EMB}, g as ({grid(100)}), t as (select sqrt(min((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y))) as d from g, pts p group by g.row_id),
s as (select list_sort(list(d)) as l, count(*) as m from t), u as (select row_id, (((row_id * 1103515245 + 7 * 12345) % 2147483648) + 0.5) / 2147483648 * (m - 1) as h, l, m from pts, s),
rad as (select row_id, l[floor(h)::int + 1] + (h - floor(h)) * (l[least(floor(h)::int + 2, m)] - l[floor(h)::int + 1]) as radius from u),
n as (select count(*) as n from pts), p as (select a.row_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, row_number() over (partition by a.row_id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.row_id) as rk from pts a, pts b where a.row_id <> b.row_id),
c as (select p.row_id, any_value(radius) as radius, arg_min(rk, (abs(d - radius), rk)) as rk from p join rad using (row_id) group by p.row_id),
k as (select row_id, radius, case when rk > n - 2 then greatest(1, n - 2) else rk end as rk from c, n)
select k.row_id, round(radius, 6) as radius, round(d, 6) as realised from k join p on p.row_id = k.row_id and p.rk = k.rk""",
        "regression_metrics": f"""with {EMB}, d as (select z as y, 0.01 * x + 0.03 * y + 48 * w1 as f from pts where row_id % 17 <> 0), m as (select avg(y) as b from d),
a as (select count(*) as n, sqrt(avg((y-f)*(y-f))) as r, avg(abs(y-f)) as ma, 100 * avg(case when abs(y) > {100 * 2.220446049250313e-16!r} then abs(y-f)/abs(y) end) as mp, 100 * avg(case when abs(y)+abs(f) > {100 * 2.220446049250313e-16!r} then 2*abs(y-f)/(abs(y)+abs(f)) end) as sm, 1 - sum((y-f)*(y-f))/sum((y-b)*(y-b)) as r2 from d, m)
select n, round(r, 6) as "RMSE", round(ma, 6) as "MAE", round(mp, 6) as "MAPE", round(sm, 6) as "SMAPE", round(r2, 6) as "R2", round(1 - (1 - r2) * (n - 1) / (n - 4), 6) as "Adj_R2" from a""",
        "cv_ols_folds": _CV + " select row_id, fold, round(y, 6) as y, round(yhat, 6) as yhat, round(y_train_mean, 6) as y_train_mean from o",
        "cv_ols_metrics": _CV + ' select fold, count(*) as n_pred, round(sqrt(avg((y-yhat)*(y-yhat))), 6) as "RMSE", round(avg(abs(y-yhat)), 6) as "MAE", round(1 - sum((y-yhat)*(y-yhat)) / sum((y-y_train_mean)*(y-y_train_mean)), 6) as "R2" from o group by fold',
        "crps_coverage": f"""with {EMB}, k as (select row_id, z, w1 * 50 + (k - 11) * 3.0::double as d, k from pts, range(1, 22) t(k)),
q as (select row_id, quantile_cont(d, 0.1) as lo, quantile_cont(d, 0.9) as hi, any_value(z) as z, avg(abs(d - z)) - sum(d * (2 * k - 22)) / 441 as c from k group by row_id)
select row_id, round(c, 6) as crps, (z between lo and hi)::int::double as inside from q""",
        "aoa_new": _aoa("row_id % 5 <> 0", ["w1", "w2", "w3"], [1, 1, 1], "a.row_id <> b.row_id", "row_id % 5 = 0"),
        "aoa_train_folds": _aoa("true", ["w1", "w2"], [3, 1], "a.row_id % 4 <> b.row_id % 4"),
        "gwr_bisquare": _gwr("case when d < 250 then (1 - d/250*d/250) * (1 - d/250*d/250) else 0 end", "where d <= 250"),
        "gwr_exponential": _gwr("exp(-d/120)"),
        "gwr_adaptive": _gwr(
            "case when d/b < 1 then pow(1 - pow(d/b, 3), 3) else 0 end",
            pairs="select *, max(case when rk <= 60 then d end) over (partition by i) as b from (select a.row_id as i, b.row_id as j, a.w1 as ui, b.w1 as u, b.z as v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, row_number() over (partition by a.row_id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.row_id) as rk from pts a, pts b)",
        ),
        "project_utm": f"""with {LL}, t as (select row_id, sinh(atanh(sin(radians(lat))) - {_S!r} * atanh({_S!r} * sin(radians(lat)))) as t, radians(lon + 81) as l from pts),
u as (select row_id, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t*t)) as et from t)
select row_id, round(500000 + {0.9996 * _RAD!r} * (et + {' + '.join(f'{a!r} * cos({2 * j} * xi) * sinh({2 * j} * et)' for j, a in enumerate(_AL, 1))}), 3) as x, round({0.9996 * _RAD!r} * (xi + {' + '.join(f'{a!r} * sin({2 * j} * xi) * cosh({2 * j} * et)' for j, a in enumerate(_AL, 1))}), 3) as y from u""",
        "project_webmerc": f"with {LL} select row_id, round(6378137 * radians(lon), 3) as x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) as y from pts",
        "project_albers": _albers(29.5, 45.5, 37.5, -96.0),
        "project_laea": _laea(35.0, -78.0),
        "surface_ols": f"""with {EMB}, g as ({grid(50)}), b as (select regr_slope(z, w1) as s, regr_intercept(z, w1) as c from pts),
n as (select g.row_id, p.w1, row_number() over (partition by g.row_id order by (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y), p.row_id) as r from g, pts p)
select row_id, round(w1, 6) as w1, round(c + s * w1, 6) as pred from n, b where r = 1""",
    }

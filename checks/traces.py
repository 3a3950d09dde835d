"""Per-trace analysis over measured and model traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampfield.functions.physics import electron_density_m3
from rampfield.functions.text import X, put
from rampfield.operators import potentials as P
from rampfield.operators import quality as Q
from rampfield.operators import saturation as B
from rampfield.operators import sweep as W
from rampfield.operators import temperature as T
from rampfield.plans import trace as plan

from .common import (
    AREA_M2, MODEL, R, REAL_ORDER, REAL_SQL, Registry, model_sql, model_traces, real_samples, rounded,
    table,
)

reg = Registry()

# --- SQL stages ----------------------------------------------------------------------
# Each stage is a common table expression; ``chain`` joins those a query needs.

STAGES: dict[str, str] = {
    "raw": model_sql(),
    "bins": """
v0 AS MATERIALIZED (SELECT trace, min(v) AS v0 FROM raw GROUP BY trace),
binned AS (SELECT trace, floor((v - v0) / 0.1::DOUBLE)::BIGINT AS bin, avg(v) AS vb, avg(i) AS ib
           FROM raw JOIN v0 USING (trace) GROUP BY trace, floor((v - v0) / 0.1::DOUBLE)),
bins AS MATERIALIZED (SELECT trace, bin, vb, ib, row_number() OVER t - 1 AS j, lead(vb) OVER t AS vn,
           lead(ib) OVER t AS inx FROM binned WINDOW t AS (PARTITION BY trace ORDER BY bin))""",
    "shape": """
shape AS MATERIALIZED (SELECT trace, count(*) AS nb, min(vb) AS va0, max(vb) AS va1, median(vn - vb) AS dv
           FROM bins GROUP BY trace)""",
    "analysis": """
grid AS (SELECT trace, va0, va1, least(greatest(4 * nb, 7), greatest(7, ceil((va1 - va0) / greatest(dv, 0.05::DOUBLE))::BIGINT + 1)) AS na
         FROM shape),
nodes AS (SELECT trace, na, j, va0 + j * ((va1 - va0) / (na - 1)) AS va FROM grid, unnest(range(na)) u(j)),
segs AS (SELECT * FROM bins WHERE vn IS NOT NULL),
analysis AS MATERIALIZED (
  SELECT n.trace, n.na, n.j, n.va, s.ib + (n.va - s.vb) * (s.inx - s.ib) / (s.vn - s.vb) AS ia
  FROM nodes n ASOF JOIN segs s ON n.trace = s.trace AND n.va >= s.vb)""",
    "savgol": """
win0 AS (SELECT trace, na, (va1 - va0) / (na - 1) AS dx, greatest(1, round_even(1.0::DOUBLE / ((va1 - va0) / (na - 1)), 0)::BIGINT) AS p FROM grid),
win1 AS (SELECT *, greatest(p + 1 - p % 2, 5) AS w FROM win0),
win AS MATERIALIZED (SELECT trace, na, dx, least(w, na - 1 + na % 2) AS w, least(w, na - 1 + na % 2) // 2 AS h FROM win1),
place AS (SELECT a.trace, a.j, w.w, w.h, w.dx, least(greatest(a.j - w.h, 0), w.na - w.w) AS s
          FROM analysis a JOIN win w USING (trace)),
slope AS MATERIALIZED (
  SELECT p.trace, p.j, any_value(p.h) AS edge,
         (sum((b.j - p.s - p.h) * b.ia) / sum(pow(b.j - p.s - p.h, 2))
          + 2 * (p.j - any_value(p.s) - any_value(p.h))
            * sum((pow(b.j - p.s - p.h, 2) - p.h * (p.h + 1) / 3.0) * b.ia)
            / sum(pow(pow(b.j - p.s - p.h, 2) - p.h * (p.h + 1) / 3.0, 2))) / any_value(p.dx) AS d
  FROM place p JOIN analysis b ON b.trace = p.trace AND b.j BETWEEN p.s AND p.s + p.w - 1
  GROUP BY p.trace, p.j)""",
    "vf0": """
crossings AS (SELECT trace, vb, vb - ib * (vn - vb) / (inx - ib) AS zero FROM bins WHERE ib < 0 AND inx >= 0),
vf0 AS MATERIALIZED (SELECT trace, arg_max(zero, vb) AS vf0 FROM crossings GROUP BY trace)""",
    "vp": """
search AS (SELECT s.trace, s.j, s.d, s.edge, a.va, a.na FROM slope s JOIN analysis a USING (trace, j) JOIN vf0 USING (trace)
           WHERE s.j > s.edge AND s.j < a.na - s.edge - 1 AND a.va > vf0),
ends AS (SELECT trace, count(*) AS n, min(j) AS lo, max(j) AS hi, max(d) AS peak FROM search GROUP BY trace),
top AS (SELECT e.trace, e.n, e.lo, e.hi, e.peak, min(s.j) AS k, any_value(s.edge) AS edge, any_value(s.na) AS na
        FROM ends e JOIN search s ON s.trace = e.trace AND s.d = e.peak GROUP BY ALL),
after_peak AS (SELECT t.trace, count(s.j) AS m, median(s.d) AS level FROM top t LEFT JOIN slope s
               ON s.trace = t.trace AND s.j >= t.k + t.edge AND s.j < t.na - t.edge GROUP BY t.trace),
vp AS MATERIALIZED (SELECT t.trace, t.k, a.va AS vp, t.peak FROM top t JOIN after_peak f USING (trace)
     JOIN analysis a ON a.trace = t.trace AND a.j = t.k
     WHERE t.n >= 3 AND t.k NOT IN (t.lo, t.hi) AND t.peak > 0 AND f.m >= 3 AND NOT f.level >= 0.5 * t.peak)""",
    "vf": """
vf AS MATERIALIZED (SELECT c.trace, arg_max(c.zero, c.vb) AS vf FROM crossings c JOIN vp USING (trace)
                    WHERE c.vb < vp GROUP BY c.trace)""",
    "ion": """
ionbins AS MATERIALIZED (SELECT b.trace, b.j, b.vb, b.ib FROM bins b JOIN shape USING (trace) JOIN vf USING (trace)
            WHERE b.vb <= va0 + 0.25 * (vf - va0)),
ionfit AS (SELECT trace, count(*) AS n, median(ib) AS cur, regr_slope(ib, vb) AS m, regr_intercept(ib, vb) AS c,
                  max(vb) AS vmax, max(vb) - min(vb) AS span FROM ionbins GROUP BY trace HAVING count(*) >= 5),
ionres AS MATERIALIZED (SELECT trace, j, ib - m * vb - c AS r FROM ionbins JOIN ionfit USING (trace)),
ionmed AS (SELECT trace, median(r) AS med, avg(r) AS mean FROM ionres GROUP BY trace),
ionnoise AS (SELECT trace, 1.4826 * median(abs(r - med)) AS noise FROM ionres JOIN ionmed USING (trace) GROUP BY trace)""",
    "neff": """
cent AS MATERIALIZED (SELECT trace, j, r - mean AS r FROM ionres JOIN ionmed USING (trace)),
acf AS (SELECT a.trace, b.j - a.j AS lag, sum(a.r * b.r) AS s FROM cent a JOIN cent b ON a.trace = b.trace AND b.j >= a.j GROUP BY ALL),
acn AS (SELECT x.trace, x.lag, x.s / z.s AS rho, z.s AS power FROM acf x JOIN acf z ON z.trace = x.trace AND z.lag = 0),
stop AS (SELECT trace, coalesce(min(CASE WHEN lag > 0 AND rho <= 0 THEN lag END), max(lag) + 1) AS l FROM acn GROUP BY trace),
neff AS MATERIALIZED (SELECT n.trace, CASE WHEN n.n < 2 THEN n.n ELSE greatest(1, least(n.n / (1 + 2 * coalesce(a.s, 0)), n.n)) END::DOUBLE AS neff
  FROM ionfit n LEFT JOIN (SELECT trace, sum(CASE WHEN lag > 0 AND lag < l THEN rho END) AS s
                           FROM acn JOIN stop USING (trace) GROUP BY trace) a USING (trace)),
ion AS MATERIALIZED (SELECT trace, n, cur, m, c, noise, neff, sqrt(pi() / 2) * noise / sqrt(neff) AS err,
     -cur / (sqrt(pi() / 2) * noise / sqrt(neff)) AS snr, abs(m) * span / -cur AS trend, vmax
     FROM ionfit JOIN ionnoise USING (trace) JOIN neff USING (trace))""",
    "peak": """
peak AS MATERIALIZED (SELECT s.trace, median(s.d) AS base FROM slope s JOIN analysis a USING (trace, j) JOIN ion USING (trace)
         WHERE a.va <= vmax GROUP BY s.trace),
peaknoise AS MATERIALIZED (SELECT s.trace, 1.4826 * median(abs(s.d - base)) AS noise FROM slope s JOIN analysis a USING (trace, j)
         JOIN ion USING (trace) JOIN peak ON peak.trace = s.trace WHERE a.va <= vmax GROUP BY s.trace)""",
    "support": """
support AS MATERIALIZED (SELECT b.trace, max(b.vn - b.vb) AS gap, any_value(dv) AS dv FROM bins b JOIN vf USING (trace) JOIN shape USING (trace)
            WHERE b.vb >= vf GROUP BY b.trace)""",
    "ies": """
satbins AS MATERIALIZED (SELECT b.trace, b.vb, b.ib FROM bins b JOIN vp USING (trace) JOIN shape USING (trace) WHERE b.vb >= vp + 0.5 * (va1 - vp)),
satfit AS (SELECT trace, count(*) AS n, median(ib) AS cur, regr_slope(ib, vb) AS m, regr_intercept(ib, vb) AS c, max(vb) - min(vb) AS span
           FROM satbins GROUP BY trace HAVING count(*) >= 5),
satmed AS (SELECT trace, median(ib - m * vb - c) AS med FROM satbins JOIN satfit USING (trace) GROUP BY trace),
ies AS MATERIALIZED (SELECT f.trace, any_value(f.cur) AS ies, any_value(f.m) AS m, any_value(f.span) AS span,
        abs(any_value(f.m)) * any_value(f.span) / any_value(f.cur) AS trend, 1.4826 * median(abs(s.ib - f.m * s.vb - f.c - med)) AS noise
        FROM satbins s JOIN satfit f USING (trace) JOIN satmed USING (trace) GROUP BY f.trace)""",
    "eligible": """
elig AS MATERIALIZED (SELECT b.trace, b.j, b.vb, ln(b.ib - cur) AS y, b.j - row_number() OVER (PARTITION BY b.trace ORDER BY b.j) AS island
  FROM bins b JOIN ion USING (trace) JOIN ies USING (trace) JOIN vf USING (trace) JOIN vp USING (trace)
  WHERE b.vb >= vf AND b.vb <= vp - 0.2 AND b.ib - cur > 0 AND b.ib - cur >= greatest(0.03 * ies.ies, 5 * ion.noise) AND b.ib - cur <= 0.8 * ies.ies),
isl AS MATERIALIZED (SELECT trace, min(j) AS a, max(j) + 1 AS b, max(vb) - min(vb) AS width FROM elig GROUP BY trace, island),
widest AS MATERIALIZED (SELECT trace, a, b FROM isl QUALIFY row_number() OVER (PARTITION BY trace ORDER BY width DESC, b - a DESC, a) = 1)""",
}


def fit_sql(source: str, out: str) -> str:
    """Semilog statistics of the spans (trace, a, b) of ``source`` as stage ``out``."""
    key = "trace, a, b"
    return f"""
{out}_p AS MATERIALIZED (SELECT s.trace, s.a, s.b, e.j, e.vb AS x, e.y FROM {source} s JOIN elig e ON e.trace = s.trace AND e.j >= s.a AND e.j < s.b),
{out}_l AS MATERIALIZED (SELECT {key}, count(*) AS n, regr_slope(y, x) AS m, regr_intercept(y, x) AS c, avg(x) AS mx, avg(y) AS my,
   max(x) - min(x) AS span, min(x) AS x0, max(x) AS x1 FROM {out}_p GROUP BY {key} HAVING count(*) >= 8),
{out}_r AS MATERIALIZED (SELECT {key}, j, n, (x - mx) / (span / 2) AS t, (y - my) - m * (x - mx) AS r, y - my AS dy, x - mx AS dx
   FROM {out}_p JOIN {out}_l USING ({key})),
{out}_s AS (SELECT {key}, sum(r * r) AS ss, sum(dy * dy) AS tot, sum(dx * dx) AS sxx, sum(t * t) / count(*) AS m2, sum(t * t * t) / sum(t * t) AS al
   FROM {out}_r GROUP BY {key}),
{out}_q AS (SELECT {key}, sum((t * t - m2 - al * t) * r) / sum(pow(t * t - m2 - al * t, 2)) AS q, sum(pow(t * t - m2 - al * t, 2)) AS norm
   FROM {out}_r JOIN {out}_s USING ({key}) GROUP BY {key}),
{out}_n AS (SELECT *, greatest(1, least(8, n // 3)) AS parts, j - a AS o FROM {out}_r),
{out}_b AS (SELECT {key}, CASE WHEN o < (n % parts) * (n // parts + 1) THEN o // (n // parts + 1)
      ELSE n % parts + (o - (n % parts) * (n // parts + 1)) // (n // parts) END AS blk, avg(r) AS dev FROM {out}_n GROUP BY ALL),
{out}_d AS (SELECT {key}, max(abs(dev)) AS dev FROM {out}_b GROUP BY {key}),
{out}_f AS (SELECT *, 1 - ss / tot AS r2, sqrt(ss / n) AS rmse, CASE WHEN m > 0 THEN sqrt(ss / (n - 2) / sxx) / m END AS rel,
   CASE WHEN m > 0 THEN m * span END AS logspan, 4 * abs(q) AS curv, CASE WHEN m > 0 THEN 1 / m END AS te,
   sqrt(greatest(0, ss - q * q * norm) / greatest(1, n - 3) / norm) AS qerr
   FROM {out}_l JOIN {out}_s USING ({key}) JOIN {out}_q USING ({key}) JOIN {out}_d USING ({key})),
{out} AS MATERIALIZED (SELECT *, coalesce(curv > 0.05 AND abs(q) > 3 * qerr, false) AS curved,
   coalesce(r2 >= 0.95, false) AS passed,
   CASE WHEN NOT coalesce(m > 0, false) THEN '{T.TE_SLOPE}' WHEN NOT te BETWEEN 0.1 AND 30 THEN '{T.TE_RANGE}'
        WHEN NOT coalesce(r2 >= 0.95, false) THEN '{T.TE_R2}' WHEN NOT logspan >= 1 THEN '{T.TE_SPAN}'
        WHEN NOT rel <= 0.3 THEN '{T.TE_UNCERTAIN}' END AS reason,
   coalesce(r2 >= 0.95 AND logspan >= 1 AND rel <= 0.3 AND curv <= 0.05 AND dev <= 0.02, false) AS straight FROM {out}_f)"""


def search_sql() -> str:
    """Brute-force broadest straight interval, every candidate fitted from its bins."""
    rounds = 4
    parts = [
        """
c0 AS MATERIALIZED (WITH e AS (SELECT DISTINCT trace, a AS ia, b AS ib,
     CASE WHEN u = least(32, b - a) THEN b ELSE floor(u * ((b - a) / least(32, b - a)::DOUBLE) + a)::BIGINT END AS x
     FROM isl, unnest(range(least(32, b - a) + 1)) t(u) WHERE b - a >= 8)
   SELECT l.trace, l.ia, l.ib, l.x AS a, h.x AS b FROM e l JOIN e h ON l.trace = h.trace AND l.ia = h.ia AND h.x - l.x >= 8)""",
        fit_sql("c0", "f0"),
        """
k0 AS MATERIALIZED (SELECT c.*, f.straight, row_number() OVER (PARTITION BY c.trace ORDER BY vs.vb - ve.vb, c.a, c.b) AS rk
   FROM c0 c JOIN f0 f USING (trace, a, b) JOIN bins vs ON vs.trace = c.trace AND vs.j = c.a JOIN bins ve ON ve.trace = c.trace AND ve.j = c.b - 1),
h0 AS MATERIALIZED (SELECT trace, min(CASE WHEN straight THEN rk END) AS rk FROM k0 GROUP BY trace),
b0 AS MATERIALIZED (SELECT k.trace, k.ia, k.ib, k.a, k.b, greatest(1, ceil((k.ib - k.ia) / 32.0)::BIGINT) AS step FROM k0 k JOIN h0 USING (trace, rk)),
y0 AS MATERIALIZED (SELECT k.trace, k.a, k.b FROM k0 k JOIN h0 h USING (trace) WHERE h.rk IS NULL OR k.rk <= h.rk)""",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts.append(
            f"""
s{r} AS MATERIALIZED (SELECT trace, ia, ib, a, b, step, greatest(ia, a - step) AS al, least(b - 8, a + step) AS ah,
   greatest(a + 8, b - step) AS bl, least(ib, b + step) AS bh FROM b{p} WHERE step > 0),
c{r} AS MATERIALIZED (SELECT DISTINCT s.trace, s.ia, s.ib, s.step, s.a AS pa, s.b AS pb,
   CASE WHEN u = 8 THEN ah ELSE floor(u * ((ah - al) / 8::DOUBLE) + al)::BIGINT END AS a,
   CASE WHEN w = 8 THEN bh ELSE floor(w * ((bh - bl) / 8::DOUBLE) + bl)::BIGINT END AS b
   FROM s{r} s, range(9) t(u), range(9) t2(w)),"""
            + fit_sql(f"(SELECT DISTINCT trace, a, b FROM c{r} WHERE b - a >= 8)", f"f{r}")
            + f""",
k{r} AS MATERIALIZED (SELECT c.*, f.straight, row_number() OVER (PARTITION BY c.trace ORDER BY vs.vb - ve.vb, c.a, c.b) AS rk
   FROM c{r} c JOIN f{r} f USING (trace, a, b) JOIN bins vs ON vs.trace = c.trace AND vs.j = c.a JOIN bins ve ON ve.trace = c.trace AND ve.j = c.b - 1
   JOIN bins ws ON ws.trace = c.trace AND ws.j = c.pa JOIN bins we ON we.trace = c.trace AND we.j = c.pb - 1
   WHERE ve.vb - vs.vb >= we.vb - ws.vb),
h{r} AS MATERIALIZED (SELECT trace, min(CASE WHEN straight THEN rk END) AS rk FROM k{r} GROUP BY trace),
b{r} AS MATERIALIZED (SELECT o.trace, o.ia, o.ib, coalesce(k.a, o.a) AS a, coalesce(k.b, o.b) AS b,
   CASE WHEN o.step <= 1 THEN 0 ELSE greatest(1, o.step // 4) END AS step
   FROM b{p} o LEFT JOIN h{r} h USING (trace) LEFT JOIN k{r} k ON k.trace = o.trace AND k.rk = h.rk),
y{r} AS MATERIALIZED (SELECT k.trace, k.a, k.b FROM k{r} k JOIN h{r} h USING (trace) WHERE h.rk IS NULL OR k.rk <= h.rk)"""
        )
    union = " UNION ".join(
        ["SELECT trace, a, b FROM widest", *[f"SELECT trace, a, b FROM y{r}" for r in range(rounds + 1)]]
    )
    parts.append(
        f"""
judged AS (SELECT trace, count(*) AS candidates FROM ({union}) GROUP BY trace),
chosen AS MATERIALIZED (SELECT w.trace, coalesce(g.a, w.a) AS a, coalesce(g.b, w.b) AS b, g.a IS NOT NULL AS found
   FROM widest w LEFT JOIN b{rounds} g USING (trace)),"""
        + fit_sql("chosen", "line")
    )
    return ",".join(parts)


def chain(select: str, *names: str) -> str:
    """WITH clause of the named stages in order, followed by a query."""
    pieces = []
    for name in names:
        pieces.append(
            {"bounded": lambda: fit_sql("widest", "bounded"), "search": search_sql}.get(
                name, lambda n=name: STAGES[n]
            )()
        )
    return "WITH " + ",".join(pieces) + "\n" + select


TO_VP = ("raw", "bins", "shape", "analysis", "savgol", "vf0", "vp", "vf")
TO_ION = (*TO_VP, "ion", "neff")
TO_IES = (*TO_ION, "ies")
TO_ELIG = (*TO_IES, "eligible")


def potentials(spark, sf, params=MODEL):
    return plan.potentials(model_traces(spark, sf), params)


def ions(spark, sf, params=MODEL):
    return B.ion_branch(potentials(spark, sf, params), params)


def saturated(spark, sf, params=MODEL):
    return B.electron_saturation(ions(spark, sf, params), params)


# --- T1 ------------------------------------------------------------------------------


def direction_sql(source: str, order: str) -> str:
    return f"""
n AS (SELECT trace, count(*) AS n, max(v) - min(v) AS span, least(25, count(*) // 3) AS parts FROM {source} GROUP BY trace),
o AS (SELECT r.trace, r.v, n.n, n.parts, row_number() OVER (PARTITION BY r.trace ORDER BY {order}) - 1 AS o FROM {source} r JOIN n USING (trace)),
blk AS (SELECT trace, v, CASE WHEN o < (n % parts) * (n // parts + 1) THEN o // (n // parts + 1)
        ELSE n % parts + (o - (n % parts) * (n // parts + 1)) // (n // parts) END AS b FROM o WHERE n >= 7),
med AS (SELECT trace, b, median(v) AS m FROM blk GROUP BY trace, b),
inc AS (SELECT trace, m - lag(m) OVER (PARTITION BY trace ORDER BY b) AS d FROM med),
big AS (SELECT trace, count(*) AS c, coalesce(sum(d) FILTER (d > 0), 0) AS up, coalesce(-sum(d) FILTER (d < 0), 0) AS down
        FROM inc JOIN n USING (trace) WHERE abs(d) >= greatest(0.1, 0.01 * span) GROUP BY trace)
SELECT n.trace, coalesce(n.n >= 7 AND span >= 6 * 0.1::DOUBLE AND c > 0 AND least(up, down) <= 0.05 * span, false) AS sweep_ok
FROM n LEFT JOIN big USING (trace)"""


@reg.add("T1_sweep_direction_model", "WITH " + model_sql(True) + "," + direction_sql("raw", "k"))
def t1_model(spark, sf):
    return W.sweep_direction(model_traces(spark, sf, True), 0.1).select("trace", "sweep_ok")


@reg.add(
    "T1_sweep_direction_measured",
    "WITH " + REAL_SQL + "," + direction_sql("real", ", ".join(REAL_ORDER)),
)
def t1_real(spark, sf):
    samples = real_samples(spark, sf)
    return W.sweep_direction_of_samples(
        samples, ["trace"], REAL_ORDER, 0.1
    )


# --- T2, T3 --------------------------------------------------------------------------


@reg.add(
    "T2_bins_model",
    chain(f"SELECT trace, j::BIGINT AS j, {R('vb', 7)} AS vb, {R('ib * 1e3', 7)} AS ib_mA FROM bins", "raw", "bins"),
)
def t2_model(spark, sf):
    binned = W.bin_traces(model_traces(spark, sf), 0.1)
    return binned.select("trace", F.posexplode(F.arrays_zip("vb", "ib")).alias("j", "b")).select(
        "trace", F.col("j").cast("bigint").alias("j"), rounded("b.vb", 7).alias("vb"),
        rounded(F.col("b.ib") * 1e3, 7).alias("ib_mA"),
    )


REAL_BINS = """
rv0 AS (SELECT trace, min(v) AS v0 FROM real GROUP BY trace),
rbins AS MATERIALIZED (SELECT trace, floor((v - v0) / 0.5::DOUBLE)::BIGINT AS bin, avg(v) AS vb, avg(i) AS ib
          FROM real JOIN rv0 USING (trace) GROUP BY trace, floor((v - v0) / 0.5::DOUBLE))"""


@reg.add(
    "T2_bins_measured",
    f"WITH {REAL_SQL}, {REAL_BINS} SELECT trace, bin, {R('vb', 10)} AS vb, {R('ib', 10)} AS ib FROM rbins",
)
def t2_real(spark, sf):
    return W.bin_samples(real_samples(spark, sf), ["trace"], 0.5).select(
        "trace", "bin", rounded("vb", 10).alias("vb"), rounded("ib", 10).alias("ib")
    )


@reg.add(
    "T3_pooled_shots",
    f"""WITH {model_sql()},
pool AS (SELECT trace // 4 AS place, v, i FROM raw),
pv0 AS (SELECT place, min(v) AS v0 FROM pool GROUP BY place),
p1 AS MATERIALIZED (SELECT place, avg(v) AS v, avg(i) AS i FROM pool JOIN pv0 USING (place) GROUP BY place, floor((v - v0) / 0.1::DOUBLE)),
pv1 AS (SELECT place, min(v) AS v0 FROM p1 GROUP BY place),
p2 AS (SELECT place, floor((v - v0) / 0.1::DOUBLE) AS bin, avg(v) AS vb, avg(i) AS ib FROM p1 JOIN pv1 USING (place) GROUP BY ALL)
SELECT place, row_number() OVER (PARTITION BY place ORDER BY bin) - 1 AS j, {R('vb', 6)} AS vb, {R('ib * 1e3', 6)} AS ib_mA FROM p2""",
)
def t3(spark, sf):
    shots = model_traces(spark, sf).withColumn("place", F.floor(F.col("trace") / 4))
    pooled = W.bin_traces(W.pool_shots(shots, ["place"], 0.1), 0.1)
    return pooled.select("place", F.posexplode(F.arrays_zip("vb", "ib")).alias("j", "b")).select(
        "place", F.col("j").cast("bigint").alias("j"), rounded("b.vb", 6).alias("vb"),
        rounded(F.col("b.ib") * 1e3, 6).alias("ib_mA"),
    )


# --- T4 ------------------------------------------------------------------------------


@reg.add(
    "T4_analysis_grid",
    chain(
        f"SELECT trace, j::BIGINT AS j, {R('va', 6)} AS va, {R('ia * 1e3', 6)} AS ia_mA FROM analysis",
        "raw", "bins", "shape", "analysis",
    ),
)
def t4(spark, sf):
    curves = plan.curves(model_traces(spark, sf), MODEL)
    return curves.select("trace", F.posexplode(F.arrays_zip("va", "ia")).alias("j", "b")).select(
        "trace", F.col("j").cast("bigint").alias("j"), rounded("b.va", 6).alias("va"),
        rounded(F.col("b.ia") * 1e3, 6).alias("ia_mA"),
    )


@reg.add(
    "T4_display_grid",
    chain(
        f"""SELECT n.trace, n.j::BIGINT AS j, {R('n.vg', 6)} AS vg, {R('(s.ib + (n.vg - s.vb) * (s.inx - s.ib) / (s.vn - s.vb)) * 1e3', 6)} AS ig_mA
  FROM (SELECT trace, j, va0 + j * ((va1 - va0) / 63) AS vg FROM shape, range(64) t(j)) n
  ASOF JOIN (SELECT * FROM bins WHERE vn IS NOT NULL) s ON n.trace = s.trace AND n.vg >= s.vb""",
        "raw", "bins", "shape",
    ),
)
def t4_display(spark, sf):
    curves = plan.curves(model_traces(spark, sf), MODEL)
    return curves.select("trace", F.posexplode(F.arrays_zip("vg", "ig")).alias("j", "b")).select(
        "trace", F.col("j").cast("bigint").alias("j"), rounded("b.vg", 6).alias("vg"),
        rounded(F.col("b.ig") * 1e3, 6).alias("ig_mA"),
    )


# --- T5 ------------------------------------------------------------------------------


@reg.add(
    "T5_floating_potential_measured",
    f"""WITH {REAL_SQL}, {REAL_BINS},
rn AS (SELECT trace, vb, ib, lead(vb) OVER t AS vn, lead(ib) OVER t AS inx FROM rbins WINDOW t AS (PARTITION BY trace ORDER BY bin)),
z AS (SELECT trace, arg_max(vb - ib * (vn - vb) / (inx - ib), vb) AS vf FROM rn WHERE ib < 0 AND inx >= 0 GROUP BY trace)
SELECT trace, {R('vf', 6)} AS vf_V FROM (SELECT trace FROM rbins GROUP BY trace HAVING count(*) >= 2) LEFT JOIN z USING (trace)""",
)
def t5_real(spark, sf):
    bins = W.gather_bins(W.bin_samples(real_samples(spark, sf), ["trace"], 0.5), ["trace"])
    return P.floating_potential(bins).select("trace", rounded("vf_V", 6).alias("vf_V"))


@reg.add(
    "T5_floating_potential_model",
    chain(f"SELECT trace, {R('vf0', 6)} AS vf_V, {R('vf', 6)} AS vf_below_vp_V FROM vf0 LEFT JOIN vf USING (trace)", *TO_VP),
)
def t5_model(spark, sf):
    return potentials(spark, sf).select(
        "trace", rounded("vf0_V", 6).alias("vf_V"), rounded("vf_V", 6).alias("vf_below_vp_V")
    )


# --- T6 ------------------------------------------------------------------------------

GRADIENT = """
nb AS (SELECT trace, j, va, {y} AS y, lag(va) OVER t AS vm, lead(va) OVER t AS vp, lag({y}) OVER t AS ym, lead({y}) OVER t AS yp
       FROM {source} WINDOW t AS (PARTITION BY trace ORDER BY j)),
gr AS (SELECT trace, j, CASE WHEN vm IS NULL THEN (yp - y) / (vp - va) WHEN vp IS NULL THEN (y - ym) / (va - vm)
   ELSE ((va - vm) * (va - vm) * yp + ((vp - va) * (vp - va) - (va - vm) * (va - vm)) * y - (vp - va) * (vp - va) * ym)
        / ((va - vm) * (vp - va) * (vp - vm)) END AS d FROM nb)"""


def slope_query(params):
    def run(spark, sf):
        curves = P.current_slope(plan.curves(model_traces(spark, sf), params), params)
        return curves.select("trace", F.posexplode("didv").alias("j", "d")).select(
            "trace", F.col("j").cast("bigint").alias("j"), rounded(F.col("d") * 1e3, 6).alias("didv_mA_per_V")
        )

    return run


SLOPE_OUT = f"SELECT trace, j::BIGINT AS j, {R('d * 1e3', 6)} AS didv_mA_per_V FROM "
reg.add(
    "T6a_gradient",
    chain("", "raw", "bins", "shape", "analysis").rstrip() + "," + GRADIENT.format(y="ia", source="analysis") + SLOPE_OUT + "gr",
)(slope_query(MODEL.with_(vp_smoothing="none")))
reg.add(
    "T6b_moving_mean_slope",
    chain("", "raw", "bins", "shape", "analysis").rstrip() + """,
mw0 AS (SELECT trace, na, greatest(1, round_even(1.0::DOUBLE / ((va1 - va0) / (na - 1)), 0)::BIGINT) AS p FROM grid),
mw AS (SELECT trace, least(greatest(p + 1 - p % 2, 3), na - 1 + na % 2) // 2 AS h FROM mw0),
mm AS MATERIALIZED (SELECT a.trace, a.j, any_value(a.va) AS va, avg(b.ia) AS s FROM analysis a JOIN mw USING (trace)
     JOIN analysis b ON b.trace = a.trace AND b.j BETWEEN a.j - h AND a.j + h GROUP BY a.trace, a.j),""" + GRADIENT.format(y="s", source="mm") + SLOPE_OUT + "gr",
)(slope_query(MODEL.with_(vp_smoothing="moving")))
reg.add("T6c_savgol_slope", chain(SLOPE_OUT + "slope", "raw", "bins", "shape", "analysis", "savgol"))(slope_query(MODEL))


# --- T7 ------------------------------------------------------------------------------


@reg.add(
    "T7_plasma_potential",
    chain(f"SELECT s.trace, k::BIGINT AS vp_index, {R('vp', 6)} AS vp_V FROM shape s LEFT JOIN vp USING (trace)", *TO_VP),
)
def t7(spark, sf):
    return potentials(spark, sf).select(
        "trace", F.col("vp_index").cast("bigint").alias("vp_index"), rounded("vp_derivative_V", 6).alias("vp_V")
    )


# --- T8 to T14 -----------------------------------------------------------------------


@reg.add(
    "T8_ion_branch",
    chain(
        f"""SELECT trace, n AS n_bins, {R('cur * 1e6', 5)} AS ion_uA, {R('noise * 1e6', 5)} AS noise_uA, {R('m * 1e6', 5)} AS slope_uA_per_V,
        {R('trend', 6)} AS trend, {R('snr', 3)} AS snr, trend > 0.2 AS sloped FROM ion""", *TO_ION),
)
def t8(spark, sf):
    return ions(spark, sf).where("ion.reason is null").select(
        "trace", F.col("ion.n").cast("bigint").alias("n_bins"), rounded(F.col("ion.current") * 1e6, 5).alias("ion_uA"),
        rounded(F.col("ion.noise") * 1e6, 5).alias("noise_uA"), rounded(F.col("ion.slope") * 1e6, 5).alias("slope_uA_per_V"),
        rounded("ion.trend", 6).alias("trend"), rounded("ion.snr", 3).alias("snr"),
        F.col("ion.trend_exceeds").alias("sloped"),
    )


@reg.add(
    "T9_effective_samples", chain(f"SELECT trace, {R('neff', 5)} AS neff FROM neff", *TO_ION)
)
def t9(spark, sf):
    return ions(spark, sf).where("ion.reason is null").select("trace", rounded("ion.neff", 5).alias("neff"))


@reg.add(
    "T9_effective_samples_measured",
    f"""WITH {REAL_SQL}, {REAL_BINS},
m AS (SELECT trace, avg(ib) AS mean FROM rbins GROUP BY trace),
c AS MATERIALIZED (SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY bin) AS j, ib - mean AS r FROM rbins JOIN m USING (trace)),
a AS (SELECT x.trace, y.j - x.j AS lag, sum(x.r * y.r) AS s FROM c x JOIN c y ON x.trace = y.trace AND y.j >= x.j GROUP BY ALL),
z AS (SELECT p.trace, p.lag, p.s / q.s AS rho FROM a p JOIN a q ON q.trace = p.trace AND q.lag = 0),
e AS (SELECT trace, coalesce(min(CASE WHEN lag > 0 AND rho <= 0 THEN lag END), max(lag) + 1) AS l FROM z GROUP BY trace),
t AS (SELECT trace, coalesce(sum(CASE WHEN lag > 0 AND lag < l THEN rho END), 0) AS s, max(lag) + 1 AS n FROM z JOIN e USING (trace) GROUP BY trace)
SELECT trace, {R('greatest(1, least(n / (1 + 2 * s), n))', 5)} AS neff FROM t""",
)
def t9_real(spark, sf):
    bins = W.gather_bins(W.bin_samples(real_samples(spark, sf), ["trace"], 0.5), ["trace"])
    return put(bins, "neff", B.effective_sample_count(X.col("ib"))).select(
        "trace", rounded("neff", 5).alias("neff")
    )


@reg.add(
    "T10_peak_significance",
    chain(
        f"""SELECT p.trace, {R('base * 1e6', 4)} AS baseline_uA, {R('noise * 1e6', 4)} AS noise_uA, {R('vp.peak * 1e6', 4)} AS peak_uA,
        vp.peak > base + 5 * noise AS significant FROM peak p JOIN peaknoise USING (trace) JOIN vp ON vp.trace = p.trace""",
        *TO_ION, "peak"),
)
def t10(spark, sf):
    done = B.derivative_significance(ions(spark, sf)).where("ion.reason is null")
    return done.select(
        "trace", rounded(F.col("peak_baseline") * 1e6, 4).alias("baseline_uA"),
        rounded(F.col("peak_noise") * 1e6, 4).alias("noise_uA"), rounded(F.col("peak_didv") * 1e6, 4).alias("peak_uA"),
        F.col("peak_ok").alias("significant"),
    )


@reg.add(
    "T11_branch_support",
    chain(
        f"SELECT trace, {R('gap', 6)} AS gap_V, gap <= greatest(5 * dv, 0.5) AS supported FROM support", *TO_VP, "support"),
)
def t11(spark, sf):
    done = B.branch_support(potentials(spark, sf), MODEL).where("vf_V is not null")
    return done.select("trace", rounded("support_gap_V", 6).alias("gap_V"), F.col("support_ok").alias("supported"))


@reg.add(
    "T12_high_bias_saturation",
    chain(
        f"""SELECT trace, {R('ies * 1e3', 6)} AS ies_mA, {R('noise * 1e6', 5)} AS noise_uA, {R('m * 1e6', 5)} AS slope_uA_per_V,
        {R('trend', 7)} AS trend FROM ies""", *TO_IES),
)
def t12(spark, sf):
    return saturated(spark, sf).where("ies.reason is null and ies is not null").select(
        "trace", rounded(F.col("ies.current") * 1e3, 6).alias("ies_mA"),
        rounded(F.col("ies.noise") * 1e6, 5).alias("noise_uA"),
        rounded(F.col("ies.slope") * 1e6, 5).alias("slope_uA_per_V"), rounded("ies.trend", 7).alias("trend"),
    )


AT_VP = """
atvp AS (SELECT b.trace, b.ib + (vp - b.vb) * (b.inx - b.ib) / (b.vn - b.vb) - cur AS cur_vp FROM bins b JOIN vp USING (trace) JOIN ion USING (trace)
         WHERE b.vb <= vp AND vp < b.vn)"""


@reg.add(
    "T13_saturation_at_vp",
    chain("", *TO_ION).rstrip() + "," + AT_VP + f" SELECT trace, {R('cur_vp * 1e3', 6)} AS ies_mA FROM atvp WHERE cur_vp > 0",
)
def t13(spark, sf):
    done = saturated(spark, sf, MODEL.with_(ies_method="at_vp")).where("ies.reason is null and ies is not null")
    return done.select("trace", rounded(F.col("ies.current") * 1e3, 6).alias("ies_mA"))


@reg.add(
    "T14_plateau_check",
    chain("", *TO_IES).rstrip() + "," + AT_VP
    + f""" SELECT trace, {R('CASE WHEN trend <= 0.2 THEN ies END * 1e3', 6)} AS plateau_mA,
     coalesce(abs(cur_vp - ies) > 0.2 * ies AND trend <= 0.2, false) AS disagrees FROM atvp JOIN ies USING (trace)""",
)
def t14(spark, sf):
    done = B.plateau_disagreement(saturated(spark, sf, MODEL.with_(ies_method="at_vp"))).where("ies is not null")
    return done.select(
        "trace", rounded(F.col("plateau_A") * 1e3, 6).alias("plateau_mA"), F.col("plateau_disagrees").alias("disagrees")
    )


# --- T15 to T18 ----------------------------------------------------------------------


@reg.add(
    "T15_eligible_intervals",
    chain(
        """SELECT i.trace, i.a::BIGINT AS first_bin, i.b::BIGINT AS stop_bin, w.a = i.a AS widest
           FROM isl i JOIN widest w USING (trace)""", *TO_ELIG),
)
def t15(spark, sf):
    found = T.eligible_intervals(saturated(spark, sf), MODEL)
    return found.select("trace", "te_span", F.explode("te_intervals").alias("x")).select(
        "trace", F.col("x.start").cast("bigint").alias("first_bin"), F.col("x.stop").cast("bigint").alias("stop_bin"),
        (F.col("te_span.start") == F.col("x.start")).alias("widest"),
    )


FIT_OUT = f"""n AS npts, {R('te', 6)} AS te_eV, {R('m', 7)} AS slope, {R('c', 6)} AS intercept, {R('r2', 8)} AS r2,
  {R('rmse', 7)} AS rmse, {R('rel', 7)} AS rel, {R('logspan', 6)} AS log_span, {R('curv', 6)} AS curvature,
  {R('dev', 7)} AS deviation, curved"""


def fit_columns(prefix: str = "te_fit"):
    c = lambda n: F.col(f"{prefix}.{n}")
    return [
        c("npts").cast("bigint").alias("npts"), rounded(c("te"), 6).alias("te_eV"), rounded(c("slope"), 7).alias("slope"),
        rounded(c("intercept"), 6).alias("intercept"), rounded(c("r2"), 8).alias("r2"), rounded(c("rmse"), 7).alias("rmse"),
        rounded(c("rel"), 7).alias("rel"), rounded(c("log_span"), 6).alias("log_span"),
        rounded(c("curvature"), 6).alias("curvature"), rounded(c("block_dev"), 7).alias("deviation"),
        c("curved").alias("curved"),
    ]


@reg.add(
    "T16_semilog_fit",
    chain(f"SELECT trace, {FIT_OUT}, reason IS NULL AS valid, reason FROM bounded", *TO_ELIG, "bounded"),
)
def t16(spark, sf):
    bounded = MODEL.with_(te_region_method="bounded")
    done = T.electron_temperature(saturated(spark, sf), bounded).where("te_fit.npts >= 8")
    return done.select("trace", *fit_columns(), F.col("te_fit.valid").alias("valid"), F.col("te_fit.reason").alias("reason"))


@reg.add(
    "T17_linear_region",
    chain(
        f"""SELECT trace, a::BIGINT AS first_bin, b::BIGINT AS stop_bin, candidates, {FIT_OUT}, found AND reason IS NULL AS valid
        FROM line JOIN chosen USING (trace, a, b) JOIN judged USING (trace)""", *TO_ELIG, "search"),
)
def t17(spark, sf):
    done = T.electron_temperature(saturated(spark, sf), MODEL).where("te_fit.npts >= 8")
    return done.select(
        "trace", F.col("te_fit_span.start").cast("bigint").alias("first_bin"),
        F.col("te_fit_span.stop").cast("bigint").alias("stop_bin"),
        F.col("te_candidates").cast("bigint").alias("candidates"), *fit_columns(), F.col("te_fit.valid").alias("valid"),
    )


VPFIT = """
vpfit AS MATERIALIZED (SELECT b.trace, CASE WHEN b.m > 0 THEN (ln(ies) - b.c) / b.m END AS vpf, greatest(0.2::DOUBLE, least(0.5, 0.5 * b.te)) AS tol
   FROM {fit} b JOIN ies USING (trace)),
vpdis AS MATERIALIZED (SELECT f.trace, vpf, tol, NOT coalesce(vpf > vf AND vpf < va1 AND abs(vpf - vp) <= tol, false) AS dis
   FROM vpfit f JOIN vf USING (trace) JOIN vp USING (trace) JOIN shape USING (trace))"""


@reg.add(
    "T18_fitted_plasma_potential",
    chain("", *TO_ELIG, "bounded").rstrip() + "," + VPFIT.format(fit="bounded")
    + f" SELECT trace, {R('vpf', 6)} AS vp_fit_V, {R('tol', 6)} AS tolerance_V, dis AS disagrees FROM vpdis",
)
def t18(spark, sf):
    bounded = MODEL.with_(te_region_method="bounded")
    done = T.fitted_plasma_potential(T.electron_temperature(saturated(spark, sf), bounded), bounded)
    return done.where("te_fit.npts >= 8").select(
        "trace", rounded("vp_fit_V", 6).alias("vp_fit_V"), rounded("vp_tolerance_V", 6).alias("tolerance_V"),
        F.col("vp_disagrees").alias("disagrees"),
    )


# --- T19 -----------------------------------------------------------------------------


@reg.add(
    "T19_density",
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_partkey,
       {R('''CASE WHEN l_extendedprice > 0 AND l_discount > 0 THEN log10(l_extendedprice * 1e-3 * 1e-3
       / (1.602176634e-19 * 4 * 1e-6 * sqrt(l_discount * 100 * 1.602176634e-19 / (2 * pi() * 9.1093837139e-31)))) END''', 7)} AS log10_ne,
       {R('''CASE WHEN l_extendedprice > 0 AND l_quantity > 0 THEN log10(l_extendedprice * 1e-3
       / (1.602176634e-19 * 4e-6 * sqrt(l_quantity * 1000 * 1.380649e-23 / (2 * pi() * 9.1093837139e-31)))) END''', 7)} AS log10_ne_kelvin
       FROM lineitem""",
)
def t19(spark, sf):
    l = table(spark, sf, "lineitem")
    built = put(
        l,
        {
            "a": electron_density_m3(
                0.001 * X.col("l_extendedprice"), 100 * X.col("l_discount"), 4.0, current_unit="mA", area_unit="mm2"
            ),
            "b": electron_density_m3(
                -0.001 * X.col("l_extendedprice"), 1000 * X.col("l_quantity"), AREA_M2, temperature_unit="K", use_abs=True
            ),
        },
    )
    return built.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_suppkey", "l_partkey",
        rounded(F.log10("a"), 7).alias("log10_ne"), rounded(F.log10("b"), 7).alias("log10_ne_kelvin"),
    )


# --- T20 to T24 ----------------------------------------------------------------------


@reg.add(
    "T20_electron_leakage",
    chain(
        f"SELECT b.trace, {R('exp(b.m * vmax + b.c) / -cur', 8)} AS leakage FROM bounded b JOIN ion USING (trace)",
        *TO_ELIG, "bounded"),
)
def t20(spark, sf):
    bounded = MODEL.with_(te_region_method="bounded")
    done = Q.electron_leakage(T.electron_temperature(saturated(spark, sf), bounded)).where("te_fit.npts >= 8")
    return done.select("trace", rounded("leakage", 8).alias("leakage"))


@reg.add(
    "T22_display_fit_mask",
    chain(
        f"""SELECT n.trace, n.j::BIGINT AS j, n.vg >= l.x0 AND n.vg <= l.x1 AS in_fit,
   {R('(s.d + (n.vg - s.va) / (s.vn - s.va) * (s.dn - s.d)) * 1e3', 6)} AS didv_mA_per_V
   FROM (SELECT trace, j, va0 + j * ((va1 - va0) / 63) AS vg FROM shape, range(64) t(j)) n JOIN bounded l USING (trace)
   ASOF JOIN (SELECT * FROM (SELECT s.trace, a.va, s.d, lead(a.va) OVER t AS vn, lead(s.d) OVER t AS dn FROM slope s JOIN analysis a USING (trace, j)
     WINDOW t AS (PARTITION BY s.trace ORDER BY s.j)) WHERE vn IS NOT NULL) s ON n.trace = s.trace AND n.vg >= s.va""",
        *TO_ELIG, "bounded"),
)
def t22(spark, sf):
    bounded = MODEL.with_(te_region_method="bounded")
    done = T.electron_temperature(saturated(spark, sf), bounded).where("te_fit.npts >= 8")
    shown = Q.display_fit_mask(P.on_display_grid(done))
    return shown.select("trace", F.posexplode(F.arrays_zip("fit_mask", "didv_grid")).alias("j", "p")).select(
        "trace", F.col("j").cast("bigint").alias("j"), F.col("p.fit_mask").alias("in_fit"),
        rounded(F.col("p.didv_grid") * 1e3, 6).alias("didv_mA_per_V"),
    )


@reg.add(
    "T23_fitted_bins",
    chain(
        f"""SELECT b.trace, b.j::BIGINT AS bin, {R('b.vb', 6)} AS vb, b.j >= w.a AND b.j < w.b AS in_fit FROM bins b JOIN widest w USING (trace)""",
        *TO_ELIG),
)
def t23(spark, sf):
    bounded = MODEL.with_(te_region_method="bounded")
    done = T.electron_temperature(saturated(spark, sf), bounded).where("te_span is not null")
    return Q.fitted_bins(done, ["trace"]).select(
        "trace", F.col("bin").cast("bigint").alias("bin"), rounded("vb", 6).alias("vb"), "in_fit"
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cascade_sql() -> str:
    """All gates for the damaged traces, from the stages above."""
    stages = {**STAGES, "raw": model_sql(True)}
    direction = direction_sql("raw", "k")
    cut_at = direction.rindex("SELECT n.trace")
    pieces = [stages["raw"], direction[:cut_at].rstrip() + f", sweep AS MATERIALIZED ({direction[cut_at:]})"]
    # Only one-way traces get a curve.
    pieces.append(stages["bins"].replace("FROM raw JOIN v0 USING (trace)", "FROM raw JOIN v0 USING (trace) JOIN sweep USING (trace)").replace(
        "GROUP BY trace, floor", "AND sweep_ok GROUP BY trace, floor").replace("JOIN sweep USING (trace) AND", "JOIN sweep USING (trace) WHERE"))
    pieces += [stages[n] for n in (*TO_VP[2:], "ion", "neff", "peak", "support", "ies", "eligible")]
    pieces += [fit_sql("widest", "bounded"), VPFIT.format(fit="bounded")]
    gate = f"""
g AS (SELECT m.trace, CASE
   WHEN NOT sweep_ok THEN 1 WHEN coalesce(nb, 0) < 7 THEN 2 WHEN vf0 IS NULL THEN 4 WHEN vp IS NULL THEN 5
   WHEN NOT coalesce(vf < vp, false) THEN 6 WHEN cur IS NULL OR cur >= 0 THEN 7 WHEN NOT coalesce(snr >= 3, false) THEN 8
   WHEN NOT coalesce(vp.peak > base + 5 * peaknoise.noise, false) THEN 9 WHEN NOT coalesce(gap <= greatest(5 * support.dv, 0.5), false) THEN 10
   WHEN ies IS NULL OR ies <= 0 OR ies < 5 * ion.noise THEN 11 WHEN coalesce(bounded.n, 0) < 8 OR bounded.reason IS NOT NULL THEN 13 END AS gate,
   CASE WHEN cur IS NULL THEN {quoted(B.ION_TOO_FEW)} ELSE {quoted(B.ION_NOT_NEGATIVE)} END AS ion_reason,
   CASE WHEN ies IS NULL THEN {quoted(B.IES_TOO_FEW)} WHEN ies <= 0 THEN {quoted(B.IES_NOT_POSITIVE)} ELSE {quoted(B.IES_NOT_RESOLVED)} END AS ies_reason,
   coalesce(bounded.reason, {quoted(T.TE_TOO_FEW)}) AS te_reason,
   vf, vp, vpf, dis, cur, snr, ies, bounded.te, bounded.r2, bounded.n, widest.b - widest.a AS n_widest, bounded.x0,
   ion.trend > 0.2 AS ion_sloped, ies.trend > 0.2 AS ies_sloped, coalesce(bounded.curved, false) AS curved, exp(bounded.m * vmax + bounded.c) / -cur AS leak
   FROM model m LEFT JOIN sweep USING (trace) LEFT JOIN shape USING (trace) LEFT JOIN vf0 USING (trace) LEFT JOIN vp ON vp.trace = m.trace
   LEFT JOIN vf ON vf.trace = m.trace LEFT JOIN ion ON ion.trace = m.trace LEFT JOIN peak ON peak.trace = m.trace LEFT JOIN peaknoise ON peaknoise.trace = m.trace
   LEFT JOIN support ON support.trace = m.trace LEFT JOIN ies ON ies.trace = m.trace LEFT JOIN widest ON widest.trace = m.trace LEFT JOIN bounded ON bounded.trace = m.trace LEFT JOIN vpdis ON vpdis.trace = m.trace)"""
    pieces.append(gate)
    warn = " ".join(
        f"WHEN {n} THEN {quoted(t) if t not in ('ion_reason', 'ies_reason', 'te_reason') else t}"
        for n, t in {
            1: Q.W_DIRECTION, 2: Q.W_CURVE, 4: Q.W_CROSSING, 5: Q.W_PEAK, 6: Q.W_ORDER, 7: "ion_reason", 8: Q.W_ION_SNR,
            9: Q.W_PEAK_NOISE, 10: Q.W_SUPPORT, 11: "ies_reason", 13: "te_reason",
        }.items()
    )
    since = lambda k, e: f"CASE WHEN coalesce(gate, 99) > {k} THEN {e} END"
    notes = ", ".join(
        f"CASE WHEN {cond} THEN {quoted(text)} END"
        for cond, text in (
            ("coalesce(gate, 99) > 8 AND ion_sloped", Q.N_ION_SLOPED),
            ("coalesce(gate, 99) > 11 AND ies_sloped", Q.N_IES_SLOPED),
            ("coalesce(gate, 99) > 11 AND curved", T.TE_CURVED),
            ("coalesce(gate, 99) > 11 AND leak > 0.02", Q.N_LEAKAGE),
            ("coalesce(gate, 99) > 13 AND dis", Q.N_VP),
        )
    )
    return "WITH " + ",".join(pieces) + f"""
SELECT trace, gate IS NULL AS ok, gate::BIGINT AS gate, coalesce(CASE gate {warn} END, '') AS warning,
  concat_ws(' | ', {notes}) AS notes, {R(since(11, 'te'), 6)} AS te_eV,
  {R(since(6, 'CASE WHEN gate IS NULL AND NOT dis THEN vpf ELSE vp END'), 6)} AS vp_V, {R(since(6, 'vf'), 6)} AS vf_V,
  {R(since(11, 'ies * 1e3'), 6)} AS ies_mA, {R(since(7, '-cur * 1e6'), 5)} AS iis_uA,
  {R(since(11, 'log10(ies / (1.602176634e-19 * 4e-6 * sqrt(te * 1.602176634e-19 / (2 * pi() * 9.1093837139e-31))))'), 7)} AS log10_ne,
  {R(since(11, 'r2'), 8)} AS te_fit_r2, coalesce({since(11, 'coalesce(n, n_widest)')}, 0) AS te_fit_npts, {R(since(11, 'x0'), 6)} AS te_fit_vstart
FROM g"""


@reg.add("T21_quality_cascade", cascade_sql())
def t21(spark, sf):
    fits = plan.analyze_traces(
        model_traces(spark, sf, True), MODEL.with_(te_region_method="bounded"), ["trace"]
    )
    return fits.select(
        "trace", "ok", F.col("gate").cast("bigint").alias("gate"),
        F.coalesce(F.try_element_at("warnings", F.lit(-1)), F.lit("")).alias("warning"),
        F.array_join("model_notes", " | ").alias("notes"), rounded("te_eV", 6).alias("te_eV"),
        rounded("vp_V", 6).alias("vp_V"), rounded("vf_V", 6).alias("vf_V"),
        rounded(F.col("ies_A") * 1e3, 6).alias("ies_mA"), rounded(F.col("iis_A") * 1e6, 5).alias("iis_uA"),
        rounded(F.log10("n_e_m3"), 7).alias("log10_ne"), rounded("te_fit_r2", 8).alias("te_fit_r2"),
        F.col("te_fit_npts").cast("bigint").alias("te_fit_npts"), rounded("te_fit_vstart", 6).alias("te_fit_vstart"),
    )


@reg.add(
    "T24_summary_lines",
    chain(
        """SELECT trace, 'Vp = ' || trim(trailing '.' FROM trim(trailing '0' FROM printf('%.' || (CASE WHEN vp >= 10 THEN 2 ELSE 3 END) || 'f', vp))) || ' V' AS vp_line,
        'fit valid = ' || CASE WHEN reason IS NULL THEN 'yes' ELSE 'no' END AS valid_line, printf('R^2 = %.4f', r2) AS r2_line,
        'independent N = ' || n AS n_line FROM bounded JOIN vp USING (trace)""", *TO_ELIG, "bounded"),
)
def t24(spark, sf):
    params = MODEL.with_(te_region_method="bounded")
    fits = plan.analyze_traces(model_traces(spark, sf), params, ["trace"]).where("te_fit_npts >= 8")
    # The derivative estimate is the one SQL reproduces, so it stands in for Vp.
    lines = Q.summary_lines(fits.withColumn("vp_V", F.col("vp_derivative_V")))
    pick = lambda start: F.filter("summary", lambda x: x.startswith(start))[0]
    return lines.select(
        "trace", pick("Vp = ").alias("vp_line"), pick("fit valid").alias("valid_line"),
        pick("R^2").alias("r2_line"), pick("independent").alias("n_line"),
    )

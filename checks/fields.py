"""Field series, sampling metadata, catalogue lookups and motion lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampfield.functions.kernels import butterworth_sections
from rampfield.operators import fields as L
from rampfield.operators.lowpass import butterworth
from rampfield.sources import catalogue, geometry, sampling

from .common import MAP_SQL, R, SERIES_SQL, Registry, gappy_series, map_cells, rounded, series, table

reg = Registry()
GAPPY = SERIES_SQL + ", g AS MATERIALIZED (SELECT series, k, CASE WHEN k > 2 AND k % 5 <> 3 THEN y END AS v FROM ser)"
CHUNK = 16


@reg.add(
    "L1_fill_missing",
    "WITH " + GAPPY + f""",
o AS (SELECT series, k, v FROM g WHERE v IS NOT NULL),
f AS (SELECT g.series, g.k, g.v, p.k AS pk, p.v AS pv, n.k AS nk, n.v AS nv FROM g
  ASOF LEFT JOIN o p ON g.series = p.series AND g.k >= p.k ASOF LEFT JOIN o n ON g.series = n.series AND g.k <= n.k)
SELECT series, k, {R('CASE WHEN v IS NOT NULL THEN v WHEN pk IS NULL THEN nv WHEN nk IS NULL THEN pv ELSE pv + (k - pk) * (nv - pv) / (nk - pk) END', 6)} AS value FROM f""",
)
def l1(spark, sf):
    return L.fill_missing(gappy_series(spark, sf), ["series"], chunk=CHUNK).select(
        "series", "k", rounded("value", 6).alias("value")
    )


def filter_sql(weight: str, before: int, after: int, mode: str) -> str:
    """Weighted sum over offsets with the position mapped back into the series."""
    fold = {
        "nearest": "least(greatest(p, 0), n - 1)",
        "reflect": "CASE WHEN ((p % (2 * n)) + 2 * n) % (2 * n) < n THEN ((p % (2 * n)) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((p % (2 * n)) + 2 * n) % (2 * n) END",
        "wrap": "((p % n) + n) % n",
        "mirror": "CASE WHEN n = 1 THEN 0 ELSE abs((((p + n - 1) % (2 * n - 2)) + 2 * n - 2) % (2 * n - 2) - (n - 1)) END",
        "constant": "CASE WHEN p BETWEEN 0 AND n - 1 THEN p END",
    }[mode]
    return f"""
len AS (SELECT series, count(*) AS n FROM ser GROUP BY series),
tap AS (SELECT s.series, s.k, o, s.k + o AS p, n FROM ser s JOIN len USING (series), unnest(range(-{before}, {after + 1})) t(o)),
src AS (SELECT series, k, o, {fold} AS q FROM tap)
SELECT x.series, x.k, {R(f"sum({weight} * coalesce(s.y, 0))", 6)} AS smooth FROM src x LEFT JOIN ser s ON s.series = x.series AND s.k = x.q GROUP BY x.series, x.k"""


def _input(spark, sf):
    return series(spark, sf).withColumnRenamed("by", "value")


def _out(df):
    return df.select("series", "k", rounded("smooth", 6).alias("smooth"))


for _mode in L.BOUNDARIES:
    reg.add(f"L2_moving_average_{_mode}", "WITH " + SERIES_SQL + "," + filter_sql("1 / 6.0::DOUBLE", 3, 2, _mode))(
        lambda spark, sf, m=_mode: _out(L.moving_average(_input(spark, sf), ["series"], 6, m, chunk=CHUNK))
    )

_G = "exp(-0.5 * pow(o / 1.3::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow(u / 1.3::DOUBLE, 2))) FROM unnest(range(-5, 6)) q(u))"
for _mode in ("nearest", "mirror"):
    reg.add(f"L4_gaussian_{_mode}", "WITH " + SERIES_SQL + "," + filter_sql(_G, 5, 5, _mode))(
        lambda spark, sf, m=_mode: _out(L.gaussian(_input(spark, sf), ["series"], 1.3, m, chunk=CHUNK))
    )


@reg.add(
    "L3_savgol",
    "WITH " + SERIES_SQL + f""",
len AS (SELECT series, count(*) AS n FROM ser GROUP BY series HAVING count(*) >= 7),
w AS (SELECT s.series, s.k, least(greatest(s.k - 3, 0), n - 7) AS st FROM ser s JOIN len USING (series)),
q AS (SELECT w.series, w.k, w.k - any_value(w.st) - 3 AS e, avg(b.y) AS m, sum((b.k - w.st - 3) * b.y) / 28.0 AS b1,
  sum((pow(b.k - w.st - 3, 2) - 4) * b.y) / sum(pow(pow(b.k - w.st - 3, 2) - 4, 2)) AS b2
  FROM w JOIN ser b ON b.series = w.series AND b.k BETWEEN w.st AND w.st + 6 GROUP BY w.series, w.k)
SELECT series, k, {R('m + b1 * e + b2 * (e * e - 4)', 6)} AS smooth FROM q""",
)
def l3(spark, sf):
    rows = _input(spark, sf)
    long_enough = L.series_lengths(rows, ["series"]).where("_n >= 7").select("series")
    return _out(L.savgol(rows.join(long_enough, "series", "left_semi"), ["series"], 7, 2, chunk=CHUNK))


def _recursion(name: str, source: str, sections) -> str:
    """One pass of the sections over (series, p, x), a row at a time: (series, p, y)."""
    def section(s, x, held):
        b0, b1, b2, a1, a2 = sections[s]
        y = f"({b0!r} * {x} + {held}[{2 * s + 1}])"
        return y, [f"{b1!r} * {x} - ({a1!r}) * {y} + {held}[{2 * s + 2}]", f"{b2!r} * {x} - ({a2!r}) * {y}"]

    level, state = "x", []
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        state += [f"{level} * {gain - b0!r}", f"{level} * ({b2 - a2 * gain!r})"]
        level = f"({level} * {gain!r})"
    steps = ["x"]
    after: list[str] = []
    for s in range(len(sections)):
        y, z = section(s, steps[-1], "z")
        steps.append(y)
        after += z
    return f"""
{name} AS (
  SELECT series, -1::BIGINT AS p, NULL::DOUBLE AS y, [{", ".join(state)}] AS z FROM {source} WHERE p = 0
  UNION ALL
  SELECT {source}.series, {source}.p, {steps[-1]}, [{", ".join(after)}]
  FROM {name} JOIN {source} ON {source}.series = {name}.series AND {source}.p = {name}.p + 1)"""


L5_SECTIONS = butterworth_sections(3, 0.1, 1.0)
L5_SQL = (
    "WITH RECURSIVE " + SERIES_SQL + f""",
ends AS (SELECT series, count(*) AS n, least(count(*) - 1, {3 * (2 * len(L5_SECTIONS) + 1)}) AS pad, arg_min(y, k) AS x0, arg_max(y, k) AS xn
  FROM ser GROUP BY series HAVING count(*) >= 2),
ext AS MATERIALIZED (
  SELECT series, k + pad AS p, y AS x FROM ser JOIN ends USING (series)
  UNION ALL SELECT series, pad - k, 2 * x0 - y FROM ser JOIN ends USING (series) WHERE k BETWEEN 1 AND pad
  UNION ALL SELECT series, pad + 2 * (n - 1) - k, 2 * xn - y FROM ser JOIN ends USING (series) WHERE k BETWEEN n - 1 - pad AND n - 2),
""" + _recursion("fw", "ext", L5_SECTIONS) + """,
back AS MATERIALIZED (SELECT series, n + 2 * pad - 1 - p AS p, y AS x FROM fw JOIN ends USING (series) WHERE p >= 0),
""" + _recursion("bw", "back", L5_SECTIONS) + f"""
SELECT series, n + pad - 1 - p AS k, {R('y', 6)} AS smooth FROM bw JOIN ends USING (series) WHERE n + pad - 1 - p BETWEEN 0 AND n - 1"""
)


@reg.add("L5_butterworth", L5_SQL)
def l5(spark, sf):
    rows = _input(spark, sf)
    long_enough = L.series_lengths(rows, ["series"]).where("_n >= 2").select("series")
    return _out(butterworth(rows.join(long_enough, "series", "left_semi"), ["series"], cutoff=0.1, fs=1.0, order=3))


ANGLE_SQL = """
mm AS (SELECT series, count(*) AS n, avg(y) AS my, avg(z) AS mz FROM ser WHERE y IS NOT NULL AND z IS NOT NULL GROUP BY series),
cc AS MATERIALIZED (SELECT s.series, avg(pow(y - my, 2)) AS cyy, avg(pow(z - mz, 2)) AS czz, avg((y - my) * (z - mz)) AS cyz FROM ser s JOIN mm USING (series) GROUP BY s.series),
th AS MATERIALIZED (SELECT *, 0.5 * atan2(2 * cyz, cyy - czz) AS th FROM cc),
rot AS MATERIALIZED (SELECT s.series, s.k, cos(th) * y + sin(th) * z AS yp, cos(th) * z - sin(th) * y AS zp, th, cyy, czz FROM ser s JOIN th USING (series))
"""


@reg.add(
    "L6_rotation",
    "WITH " + SERIES_SQL + "," + ANGLE_SQL + f"SELECT series, k, {R('yp', 5)} AS by_prime, {R('zp', 5)} AS bz_prime FROM rot JOIN mm USING (series) WHERE n >= 3",
)
def l6(spark, sf):
    rows = series(spark, sf)
    long_enough = L.series_lengths(rows, ["series"]).where("_n >= 3").select("series")
    turned = L.rotate_pair(rows.join(long_enough, "series", "left_semi"), ["series"])
    return turned.select("series", "k", rounded("by_prime", 5).alias("by_prime"), rounded("bz_prime", 5).alias("bz_prime"))


@reg.add(
    "L6_rotation_diagnostics",
    "WITH " + SERIES_SQL + "," + ANGLE_SQL + f"""SELECT series, {R('any_value(th)', 7)} AS theta_rad, {R('any_value(cyy)', 5)} AS cyy,
   {R('var_pop(yp)', 4)} AS var_by_prime, {R('var_pop(zp)', 4)} AS var_bz_prime, {R('any_value(cyy) / any_value(czz)', 6)} AS power_ratio_before,
   {R('var_pop(yp) / var_pop(zp)', 4)} AS power_ratio_after FROM rot JOIN mm USING (series) WHERE n >= 3 GROUP BY series""",
)
def l6_diagnostics(spark, sf):
    rows = series(spark, sf)
    long_enough = L.series_lengths(rows, ["series"]).where("_n >= 3").select("series")
    a = L.rotation_angles(rows.join(long_enough, "series", "left_semi"), ["series"])
    return a.select(
        "series", rounded("theta_rad", 7).alias("theta_rad"), rounded("cyy", 5).alias("cyy"),
        rounded("var_by_prime", 4).alias("var_by_prime"), rounded("var_bz_prime", 4).alias("var_bz_prime"),
        rounded("power_ratio_before", 6).alias("power_ratio_before"), rounded("power_ratio_after", 4).alias("power_ratio_after"),
    )


# --- SRC6 ----------------------------------------------------------------------------
# Each brand is a configuration with its part sizes as x positions, visited twice in
# order; odd brands skip a position and so are not evenly spaced.

MOTION_SQL = """
vis AS (SELECT b, s FROM (SELECT DISTINCT regexp_extract(p_brand, '#(\\d+)', 1)::BIGINT AS b FROM part), range(1, 41) t(s)
        WHERE b % 2 = 0 OR s <> 20),
ord AS (SELECT b, s, row_number() OVER (PARTITION BY b ORDER BY s) - 1 AS r FROM vis)
"""


def _motion(spark, sf):
    brands = table(spark, sf, "part").select(
        F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint").alias("b")
    ).distinct()
    steps = brands.select("b", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("s")).where("b % 2 = 0 or s <> 20")
    place = F.col("s") - 1 - F.when((F.col("b") % 2 == 1) & (F.col("s") > 20), 1).otherwise(0)
    shots = steps.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    return shots.select(
        F.col("b").cast("string").alias("config"), (10 + place * 2 + F.col("r") + 1).cast("bigint").alias("shotnum"),
        (F.col("s") * 5.0).alias("x"), F.lit(0.0).alias("y"), F.lit("mm").alias("unit"),
    )


@reg.add(
    "SRC6_line_geometry",
    "WITH " + MOTION_SQL + f""", a AS (SELECT b, count(*) AS n, min(s) AS lo, max(s) AS hi FROM ord GROUP BY b)
SELECT b::VARCHAR AS config, CASE WHEN b % 2 = 1 THEN 'x targets must be evenly spaced' END AS violation,
  CASE WHEN b % 2 = 0 THEN 2::BIGINT END AS nshots, CASE WHEN b % 2 = 0 THEN 10::BIGINT END AS data_offset,
  CASE WHEN b % 2 = 0 THEN n END AS nx, {R('CASE WHEN b % 2 = 0 THEN lo * 0.5 END', 6)} AS x_min_cm, {R('CASE WHEN b % 2 = 0 THEN hi * 0.5 END', 6)} AS x_max_cm FROM a""",
)
def src6(spark, sf):
    found = geometry.infer_geometry(_motion(spark, sf), "x_line")
    return found.select(
        "config", "violation", "nshots", "data_offset", "nx",
        rounded("x_min_cm", 6).alias("x_min_cm"), rounded("x_max_cm", 6).alias("x_max_cm"),
    )


@reg.add(
    "SRC6_plane_geometry",
    f"""WITH c AS (SELECT p_type, count(DISTINCT p_size) AS nx, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type)
SELECT p_type AS config, NULL::VARCHAR AS violation, 3::BIGINT AS nshots, 0::BIGINT AS data_offset, (hi - lo + 1)::BIGINT AS nx, 4::BIGINT AS ny,
  {R('lo', 6)} AS x_min_cm, {R('hi', 6)} AS x_max_cm, {R('-1.5', 6)} AS y_min_cm, {R('1.5', 6)} AS y_max_cm,
  CASE WHEN length(p_type) % 2 = 0 THEN 'descending' ELSE 'ascending' END AS y_order FROM c""",
)
def src6_plane(spark, sf):
    # Each part type spans a rectangle as wide as its sizes, four rows high, three shots each.
    types = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    cells = types.select(
        "p_type", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("s"),
    ).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2))))
    down = F.length("p_type") % 2 == 0
    motion = cells.select(
        F.col("p_type").alias("config"),
        ((F.col("row") * (F.col("hi") - F.col("lo") + 1) + F.col("s") - F.col("lo")) * 3 + F.col("r") + 1).cast("bigint").alias("shotnum"),
        F.col("s").cast("double").alias("x"), F.when(down, 1.5 - F.col("row")).otherwise(F.col("row") - 1.5).alias("y"), F.lit("cm").alias("unit"),
    )
    found = geometry.infer_geometry(motion, "xy_plane")
    return found.select(
        "config", "violation", "nshots", "data_offset", "nx", "ny",
        *[rounded(c, 6).alias(c) for c in ("x_min_cm", "x_max_cm", "y_min_cm", "y_max_cm")], "y_order",
    )


# --- SRC7 ----------------------------------------------------------------------------


@reg.add(
    "SRC7_axis_interval",
    "WITH " + SERIES_SQL + f""", t AS (SELECT series, k, CASE WHEN series % 3 = 0 THEN k * 2e-6::DOUBLE WHEN k = 4 THEN 1e-5::DOUBLE ELSE k * 2e-6::DOUBLE + y * 0 + CASE WHEN k = 5 THEN 1e-8 ELSE 0 END END AS t FROM ser)
SELECT series, count(*) AS nt, {R('(arg_max(t, k) - arg_min(t, k)) / (count(*) - 1) * 1e6', 6)} AS dt_us, series % 3 = 0 AS linear FROM t GROUP BY series HAVING count(*) > 6""",
)
def src7(spark, sf):
    off = F.when(F.col("k") == 5, F.lit(1e-8)).otherwise(F.lit(0.0))
    t = F.when(F.col("series") % 3 == 0, F.col("k") * 2e-6).when(F.col("k") == 4, F.lit(1e-5)).otherwise(F.col("k") * 2e-6 + off)
    axis = series(spark, sf).select("series", "k", t.alias("t_s"))
    return sampling.intervals_from_axis(axis, ["series"]).select(
        "series", "nt", rounded(F.col("dt_s") * 1e6, 6).alias("dt_us"), "linear"
    )


@reg.add(
    "SRC7_channel_agreement",
    f"""SELECT o_custkey AS pair, max(CASE WHEN o_orderkey % 2 = 0 THEN 64 + o_orderkey % 3 END)::BIGINT AS v_nt,
  CASE WHEN greatest(count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderkey % 2 = 1)) > 1 THEN 'several entries of a channel'
       WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN 64 + o_orderkey % 3 END) IS NULL OR max(CASE WHEN o_orderkey % 2 = 1 THEN 64 + o_orderkey % 3 END) IS NULL THEN 'missing trace length'
       WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN 64 + o_orderkey % 3 END) <> max(CASE WHEN o_orderkey % 2 = 1 THEN 64 + o_orderkey % 3 END) THEN 'different trace lengths'
       WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END) <> max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 4 - 1 END) THEN 'different sample intervals' END AS violation
  FROM orders GROUP BY o_custkey""",
)
def src7_agreement(spark, sf):
    specs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pair"), (F.col("o_orderkey") % 2).alias("channel"),
        (64 + F.col("o_orderkey") % 3).alias("nt"), F.lit(1e8).alias("clock_rate_hz"),
        (2.0 + F.col("o_orderkey") % 4 - F.col("o_orderkey") % 2).alias("sample_average"),
    )
    found = sampling.channel_agreement(sampling.intervals_from_clock(specs), ["pair"], 0, 1)
    return found.select("pair", F.col("v_nt").cast("bigint").alias("v_nt"), "violation")


@reg.add(
    "SRC7_resolved_interval",
    f"""SELECT o_custkey AS pair, CASE WHEN greatest(count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderkey % 2 = 1)) > 1 THEN 'several entries of a channel'
       WHEN count(DISTINCT o_orderkey % 2) < 2 THEN 'missing trace length'
   WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END) <> max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 4 - 1 END) THEN 'different sample intervals'
   WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END) <> 2 THEN 'voltage interval changed' END AS violation FROM orders GROUP BY o_custkey""",
)
def src7_resolved(spark, sf):
    specs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pair"), (F.col("o_orderkey") % 2).alias("channel"), F.lit(64).alias("nt"),
        F.lit(1e8).alias("clock_rate_hz"), (2.0 + F.col("o_orderkey") % 4 - F.col("o_orderkey") % 2).alias("sample_average"),
    )
    found = sampling.channel_agreement(sampling.intervals_from_clock(specs), ["pair"], 0, 1)
    return sampling.resolve_interval(found, 4e-8, "hdf5").select("pair", "violation")


def channels_of_orders(spark, sf, nt):
    """Neighbouring orders as voltage (even key) and current of a pair, so a channel has one entry."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return sampling.channel_agreement(sampling.intervals_from_clock(table(spark, sf, "orders").select(
        F.floor(key / 2).alias("pair"), (key % 2).alias("channel"), nt.alias("nt"), F.lit(1e8).alias("clock_rate_hz"),
        (2.0 + 2 * (F.floor(cust / 2) % 2)).alias("sample_average"),
    )), ["pair"], 0, 1)


PAIRED_ORDERS_SQL = """e AS (SELECT o_orderkey // 2 AS pair, o_orderkey % 2 AS channel, 64 + o_custkey % 2 AS nt, o_custkey // 2 % 2 AS slow FROM orders),
p AS (SELECT pair, greatest(count(*) FILTER (channel = 0), count(*) FILTER (channel = 1)) AS entries,
  max(nt) FILTER (channel = 0) AS v_nt, max(nt) FILTER (channel = 1) AS i_nt,
  max(slow) FILTER (channel = 0) AS v_slow, max(slow) FILTER (channel = 1) AS i_slow FROM e GROUP BY pair)"""


@reg.add(
    "SRC7_channel_agreement_single",
    "WITH " + PAIRED_ORDERS_SQL + """
SELECT pair::BIGINT AS pair, v_nt::BIGINT AS v_nt, CASE WHEN entries > 1 THEN 'several entries of a channel'
  WHEN v_nt IS NULL OR i_nt IS NULL THEN 'missing trace length' WHEN v_nt <> i_nt THEN 'different trace lengths'
  WHEN v_slow <> i_slow THEN 'different sample intervals' END AS violation FROM p""",
)
def src7_agreement_single(spark, sf):
    found = channels_of_orders(spark, sf, 64 + F.col("o_custkey") % 2)
    return found.select("pair", F.col("v_nt").cast("bigint").alias("v_nt"), "violation")


@reg.add(
    "SRC7_resolved_interval_single",
    "WITH " + PAIRED_ORDERS_SQL + """
SELECT pair::BIGINT AS pair, CASE WHEN entries > 1 THEN 'several entries of a channel'
  WHEN v_nt IS NULL OR i_nt IS NULL THEN 'missing trace length' WHEN v_slow <> i_slow THEN 'different sample intervals'
  WHEN v_slow <> 1 THEN 'voltage interval changed' END AS violation FROM p""",
)
def src7_resolved_single(spark, sf):
    return sampling.resolve_interval(channels_of_orders(spark, sf, F.lit(64)), 4e-8, "hdf5").select("pair", "violation")


# --- SRC8 ----------------------------------------------------------------------------


@reg.add("SRC8_configuration_names", "SELECT DISTINCT p_brand AS digitizer, p_type AS name FROM part")
def src8(spark, sf):
    return catalogue.configuration_names(
        table(spark, sf, "part").select(F.col("p_brand").alias("digitizer"), F.col("p_type").alias("name")), "digitizer"
    )


@reg.add(
    "SRC8_channel_labels",
    """SELECT n_regionkey::VARCHAR AS config, n_nationkey::BIGINT AS slot, 'Data type 3' AS key,
  CASE WHEN k = 1 AND lo % 2 = 0 THEN 'label ' || lo END AS label,
  CASE WHEN coalesce(k, 0) <> 1 THEN 'slot does not identify exactly one configuration' WHEN lo % 2 = 1 THEN 'no data-type metadata' END AS violation
  FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k, min(s_suppkey) AS lo FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey""",
)
def src8_labels(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    config = F.col("n_regionkey").cast("string").alias("config")
    wanted = nation.select(
        config, F.col("n_nationkey").cast("bigint").alias("slot"), F.lit(catalogue.channel_label_key("SIS 3302", 3)).alias("key")
    )
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    slots = placed.select(config, F.col("n_nationkey").cast("bigint").alias("slot"), F.col("s_suppkey").alias("config_index"))
    labels = placed.where("s_suppkey % 2 = 0").select(
        config, F.col("s_suppkey").alias("config_index"), F.lit("Data type 3").alias("key"),
        F.format_string(" label %d ", F.col("s_suppkey")).alias("label"),
    )
    return catalogue.channel_data_types(wanted, slots, labels)


@reg.add("SRC8_run_description", "SELECT coalesce(max(trim(text)), '') AS description FROM documents WHERE doc_id = 7")
def src8_description(spark, sf):
    info = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("run"), F.col("text").alias("description")
    )
    return catalogue.run_description(info, "7")

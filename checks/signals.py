"""Sources and conditioning over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampfield.operators import conditioning as C
from rampfield.sources import shots as S

from .common import R, SIGNAL_SCAN as SCAN, SIGNAL_SQL, Registry, raw_signals, rounded, table, SMALL_SCAN, shared_root, small_scan_shots

reg = Registry()


@reg.add(
    "SRC1_channel_shots",
    """SELECT 'e' || (vec_id // 2 // 1000) AS run, (vec_id // 2 %% 1000 + 1)::BIGINT AS shotnum, len(embedding)::BIGINT AS nt,
              %s AS total FROM embeddings WHERE vec_id %% 2 = 0"""
    % R("list_sum(list_transform(embedding, lambda x: x::DOUBLE))", 5),
)
def src1(spark, sf):
    shots = S.channel_shots(raw_signals(spark, sf), SCAN, 0)
    return shots.select(
        "run", "shotnum", F.size("signal").cast("bigint").alias("nt"),
        rounded(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
    )


@reg.add(
    "SRC1_channel_check",
    """SELECT run, n AS n_shots, lo AS min_nt, hi AS max_nt,
              CASE WHEN n = 0 THEN 'channel absent' WHEN n <> d THEN 'shots stored twice' WHEN n <> 1000 THEN 'shot count mismatch'
                   WHEN lo <> 64 OR hi <> 64 THEN 'time-length mismatch' END AS violation
       FROM (SELECT 'e' || (vec_id // 2 // 1000) AS run, count(*) AS n, count(DISTINCT vec_id // 2) AS d,
                    min(len(embedding))::BIGINT AS lo, max(len(embedding))::BIGINT AS hi
             FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1)""",
)
def src1_check(spark, sf):
    return S.channel_check(raw_signals(spark, sf), SCAN, 1)


@reg.add(
    "SRC1_shot_index",
    """SELECT 'e' || (vec_id // 2 // 50) AS run, vec_id % 2 AS channel, count(*) + count(*) FILTER (vec_id // 2 % 50 = 29) AS n_shots,
              min(len(embedding))::BIGINT AS min_nt, max(len(embedding))::BIGINT AS max_nt, count(*) FILTER (vec_id // 2 % 50 = 29) AS repeated,
              CASE WHEN count(*) FILTER (vec_id // 2 % 50 = 29) > 0 THEN 'shots stored twice' WHEN count(*) <> 50 THEN 'shot count mismatch' END AS violation
       FROM embeddings GROUP BY 1, 2""",
)
def src1_index(spark, sf):
    """Shots that come in two batches with one shot of each run in both; the checks read the index alone."""
    path, raw = shared_root(spark), small_scan_shots(spark, sf)
    S.ingest_shots(spark, raw.where("shotnum <= 30"), path)
    again = S.ingest_shots(spark, raw.where("shotnum >= 30"), path).groupBy("run", "channel").agg(F.count(F.lit(1)).alias("repeated"))
    index = S.read_shot_index(spark, path)
    checked = [S.channel_check(index, SMALL_SCAN, c).withColumn("channel", F.lit(c)) for c in (0, 1)]
    return checked[0].unionByName(checked[1]).join(again, ["run", "channel"], "left").select(
        "run", F.col("channel").cast("bigint").alias("channel"), "n_shots", "min_nt", "max_nt", F.coalesce("repeated", F.lit(0)).alias("repeated"), "violation"
    )


@reg.add(
    "SRC1_channel_violations",
    """SELECT 'p' || ps_run AS run, count(*) FILTER (ch = 1) AS n_shots,
              CASE WHEN count(*) FILTER (ch = 1) = 0 THEN 'channel absent'
                   WHEN count(*) FILTER (ch = 1) <> count(DISTINCT CASE WHEN ch = 1 THEN shot END) THEN 'shots stored twice'
                   WHEN count(*) FILTER (ch = 1) <> 20 THEN 'shot count mismatch'
                   WHEN min(CASE WHEN ch = 1 THEN nt END) <> 4 OR max(CASE WHEN ch = 1 THEN nt END) <> 4 THEN 'time-length mismatch' END AS violation
       FROM (SELECT s_suppkey // 20 AS ps_run, s_suppkey % 20 + 1 + CASE WHEN s_suppkey // 20 % 5 = 1 AND s_suppkey % 20 = 3 THEN -1 ELSE 0 END AS shot,
                    CASE WHEN s_suppkey // 20 % 5 = 2 THEN 0 ELSE 1 END AS ch,
                    CASE WHEN s_suppkey // 20 % 5 = 3 AND s_suppkey % 20 = 7 THEN 3 ELSE 4 END AS nt
             FROM supplier) GROUP BY 1""",
)
def src1_violations(spark, sf):
    from rampfield.params import ScanParams

    # Twenty suppliers are a run; by turns it is complete, has a shot twice, has no current, or a short trace.
    key = F.col("s_suppkey")
    run, shot = F.floor(key / 20), key % 20 + 1
    raw = table(spark, sf, "supplier").select(
        F.concat(F.lit("p"), run.cast("string")).alias("run"), F.lit(1).alias("board"),
        F.when(run % 5 == 2, 0).otherwise(1).alias("channel"),
        F.when((run % 5 == 1) & (key % 20 == 3), shot - 1).otherwise(shot).alias("shotnum"),
        F.when((run % 5 == 3) & (key % 20 == 7), F.array_repeat(F.lit(0.0), 3)).otherwise(F.array_repeat(F.lit(0.0), 4)).alias("signal"),
    )
    small = ScanParams(
        geometry="x_line", nx=10, nshots=2, nt_full=4, dt_s=1e-6, x_min_cm=0.0, x_max_cm=1.0, sweep_start=0, sweep_end=3,
        sg_window=3, sg_order=1,
    )
    return S.channel_check(raw, small, 1).select("run", "n_shots", "violation")


@reg.add(
    "SRC2_shot_positions",
    "WITH " + SIGNAL_SQL + """SELECT run, shotnum::BIGINT AS shotnum, iy::BIGINT AS iy, ix::BIGINT AS ix, ishot::BIGINT AS ishot,
       (((99 - iy) * 5 + ix) * 2 + ishot + 1)::BIGINT AS back FROM pos WHERE channel = 0""",
)
def src2(spark, sf):
    placed = S.with_position(raw_signals(spark, sf).where("channel = 0"), SCAN)
    return placed.select(
        "run", "shotnum", *[F.col(c).cast("bigint").alias(c) for c in ("iy", "ix", "ishot")],
        S.shot_number(SCAN, F.col("iy"), F.col("ix"), F.col("ishot")).alias("back"),
    )


@reg.add(
    "SRC3_position_axes",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, {R('-4 + ix * 8 / 4.0', 6)} AS x_cm,
       {R('-10 + iy * 20 / 99.0', 6)} AS y_cm FROM pos WHERE channel = 1""",
)
def src3(spark, sf):
    placed = S.with_position(raw_signals(spark, sf).where("channel = 1"), SCAN)
    return placed.join(S.position_grid(spark, SCAN), ["iy", "ix"]).select(
        "run", "shotnum", rounded("x_cm", 6).alias("x_cm"), rounded("y_cm", 6).alias("y_cm")
    )


@reg.add(
    "SRC4_paired_samples",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, k, {R('v', 6)} AS v, {R('i', 8)} AS i FROM samples""",
)
def src4(spark, sf):
    return S.paired_samples(raw_signals(spark, sf), SCAN).select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), F.col("k").cast("bigint").alias("k"),
        rounded("v", 6).alias("v"), rounded("i", 8).alias("i"),
    )


@reg.add(
    "SRC5_preview_trace",
    "WITH " + SIGNAL_SQL + f"""SELECT k::BIGINT AS k, {R('k * 1e-6', 9)} AS t_s, {R('v[k + 1]', 6)} AS v, {R('i[k + 1] - dc', 8)} AS i
       FROM volts JOIN amps USING (run, shotnum), range(64) t(k) WHERE run = 'e0' AND shotnum = 24""",
)
def src5(spark, sf):
    # Shot 24: two rows of five positions and two shots lie before it.
    one = S.preview_trace(raw_signals(spark, sf), SCAN, "e0", 97, 1, 1)
    return one.select(
        F.col("k").cast("bigint").alias("k"), rounded("t_s", 9).alias("t_s"),
        rounded("v", 6).alias("v"), rounded("i", 8).alias("i"),
    )


@reg.add(
    "P1_calibration",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, channel::BIGINT AS channel,
       {R("list_sum(list_transform(y, lambda x: CASE WHEN channel = 0 THEN x * 100 ELSE x * -0.5 END))", 5)} AS total FROM pos""",
)
def p1(spark, sf):
    raw = raw_signals(spark, sf)
    v = C.calibrated("signal", SCAN.voltage_attenuation).column()
    i = C.calibrated(
        "signal", SCAN.current_attenuation / SCAN.current_resistance_ohm, SCAN.negate_current
    ).column()
    y = raw.withColumn("y", F.when(F.col("channel") == 0, v).otherwise(i))
    return y.select(
        "run", "shotnum", F.col("channel").cast("bigint").alias("channel"),
        rounded(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
    )


@reg.add(
    "P2_time_to_sample",
    """SELECT event_id, floor(r + 0.5 + 4 * u)::BIGINT AS sample FROM (
         SELECT event_id, r, CASE WHEN r > 0 THEN pow(2.0::DOUBLE, floor(log2(r)) - 52) ELSE 0 END AS u FROM (
           SELECT event_id, abs(value) * 1e-6::DOUBLE / 3.2e-7::DOUBLE AS r FROM events))""",
)
def p2(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.time_to_sample(F.abs("value") * F.lit(1e-6), F.lit(3.2e-7)).alias("sample")
    )


@reg.add(
    "P3_ramps",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, len(v)::BIGINT AS n, {R('list_sum(v)', 5)} AS total_v,
       {R('v[1]', 6)} AS first_v, {R('v[12]', 6)} AS last_v FROM ramps""",
)
def p3(spark, sf):
    ramps = S.paired_ramps(raw_signals(spark, sf), SCAN)
    return ramps.select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), F.size("v").cast("bigint").alias("n"),
        rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total_v"),
        rounded(F.col("v")[0], 6).alias("first_v"), rounded(F.col("v")[11], 6).alias("last_v"),
    )


@reg.add(
    "P4_ramp_times",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, 8 + 16 * iramp AS ramp_start_index, 19 + 16 * iramp AS ramp_end_index,
       {R('(8 + 16 * iramp)', 6)} AS ramp_start_us, {R('(8 + 16 * iramp + 5.5)', 6)} AS ramp_center_us FROM ramps""",
)
def p4(spark, sf):
    timed = C.ramp_times(S.paired_ramps(raw_signals(spark, sf), SCAN), SCAN)
    return timed.select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), "ramp_start_index", "ramp_end_index",
        rounded(F.col("ramp_start_time_s") * 1e6, 6).alias("ramp_start_us"),
        rounded(F.col("ramp_center_time_s") * 1e6, 6).alias("ramp_center_us"),
    )


@reg.add(
    "P5_baseline",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, {R('dc', 8)} AS dc_offset_A,
       {R('list_sum(i) - 64 * dc', 6)} AS total FROM amps""",
)
def p5(spark, sf):
    from rampfield.functions.text import put

    amps = put(
        raw_signals(spark, sf).where("channel = 1"), "i", C.calibrated("signal", 0.5, negate=True)
    )
    done = C.subtract_baseline(amps, SCAN)
    return done.select(
        "run", "shotnum", rounded("dc_offset_A", 8).alias("dc_offset_A"),
        rounded(F.aggregate("i", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@reg.add(
    "P6_isat",
    "WITH " + SIGNAL_SQL + f"""SELECT run, iy::BIGINT AS iy, ix::BIGINT AS ix, iramp, {R('avg(m)', 8)} AS isat_A, {R('stddev_samp(m)', 8)} AS isat_std_A
       FROM (SELECT run, iy, ix, iramp, list_avg(i[3:7]) AS m FROM ramps) GROUP BY run, iy, ix, iramp""",
)
def p6(spark, sf):
    from rampfield.operators.shots_agg import shot_statistics

    ramps = C.isat_mean(S.paired_ramps(raw_signals(spark, sf), SCAN), SCAN)
    return shot_statistics(ramps, ["run", "iy", "ix", "iramp"], {"isat_A": "isat"}).select(
        "run", *[F.col(c).cast("bigint").alias(c) for c in ("iy", "ix", "iramp")],
        rounded("isat", 8).alias("isat_A"), rounded("isat_std", 8).alias("isat_std_A"),
    )


@reg.add(
    "P7_mean_waveforms",
    "WITH " + SIGNAL_SQL + f"""SELECT run, iy::BIGINT AS iy, ix::BIGINT AS ix, iramp, k, {R('avg(v)', 6)} AS v, {R('avg(i)', 8)} AS i
       FROM samples GROUP BY run, iy, ix, iramp, k""",
)
def p7(spark, sf):
    waves = C.shot_mean_waveforms(
        S.paired_ramps(raw_signals(spark, sf), SCAN), ["run", "iy", "ix", "iramp"], SCAN.dt_s
    )
    return waves.select(
        "run", *[F.col(c).cast("bigint").alias(c) for c in ("iy", "ix", "iramp", "k")],
        rounded("v", 6).alias("v"), rounded("i", 8).alias("i"),
    )


# The window of row k starts at the clamped k-2 (even length six); the quadratic
# of the window is evaluated half a sample off its centre inside, at the sample
# itself at the ends.
SMOOTH_SQL = """
w AS (
  SELECT a.run, a.shotnum, a.iramp, a.k, least(greatest(a.k - 2, 0), 6) AS s,
         CASE WHEN a.k < 3 THEN a.k - 2.5 WHEN a.k >= 9 THEN a.k - 6 - 2.5 ELSE 0 END AS e FROM samples a),
q AS (
  SELECT w.run, w.shotnum, w.iramp, w.k, any_value(w.e) AS e, avg(b.%(y)s) AS m,
         sum((b.k - w.s - 2.5) * b.%(y)s) / 17.5 AS b1,
         sum((pow(b.k - w.s - 2.5, 2) - 17.5 / 6) * b.%(y)s) / sum(pow(pow(b.k - w.s - 2.5, 2) - 17.5 / 6, 2)) AS b2
  FROM w JOIN samples b ON b.run = w.run AND b.shotnum = w.shotnum AND b.iramp = w.iramp AND b.k BETWEEN w.s AND w.s + 5
  GROUP BY w.run, w.shotnum, w.iramp, w.k)
"""


@reg.add(
    "P8_time_smoothing",
    "WITH " + SIGNAL_SQL + "," + SMOOTH_SQL % {"y": "v"}
    + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, k, {R('m + b1 * e + b2 * (e * e - 17.5 / 6)', 5)} AS v_smooth FROM q""",
)
def p8(spark, sf):
    smooth = C.smooth_in_time(S.paired_ramps(raw_signals(spark, sf), SCAN), 6, 2)
    return smooth.select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), F.posexplode("v_smooth").alias("k", "y")
    ).select("run", "shotnum", "iramp", F.col("k").cast("bigint").alias("k"), rounded("y", 5).alias("v_smooth"))


@reg.add(
    "P8_time_smoothing_current",
    "WITH " + SIGNAL_SQL + "," + SMOOTH_SQL % {"y": "i"}
    + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, k, {R('m + b1 * e + b2 * (e * e - 17.5 / 6)', 7)} AS i_smooth FROM q""",
)
def p8_current(spark, sf):
    smooth = C.smooth_in_time(S.paired_ramps(raw_signals(spark, sf), SCAN), 6, 2)
    return smooth.select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), F.posexplode("i_smooth").alias("k", "y")
    ).select("run", "shotnum", "iramp", F.col("k").cast("bigint").alias("k"), rounded("y", 7).alias("i_smooth"))


@reg.add(
    "P9_finite_samples",
    "WITH " + SIGNAL_SQL + f"""SELECT run, shotnum::BIGINT AS shotnum, iramp, count(*) AS n, {R('sum(v)', 5)} AS total_v
       FROM samples WHERE abs(v) < 15 AND abs(i) < 0.09 GROUP BY run, shotnum, iramp""",
)
def p9(spark, sf):
    from rampfield.functions.text import X, put
    from rampfield.operators.sweep import pair_samples

    ramps = S.paired_ramps(raw_signals(spark, sf), SCAN)
    # Large samples become NaN or infinite here and must be dropped as missing.
    holed = ramps.withColumns(
        {
            "v": F.transform("v", lambda x: F.when(F.abs(x) < 15, x).otherwise(F.lit(float("nan")))),
            "i": F.transform("i", lambda x: F.when(F.abs(x) < 0.09, x).otherwise(F.lit(float("inf")))),
        }
    )
    paired = put(holed, "p", pair_samples(X.col("v"), X.col("i"))).where(F.size("p") > 0)
    return paired.select(
        "run", "shotnum", F.col("iramp").cast("bigint").alias("iramp"), F.size("p").cast("bigint").alias("n"),
        rounded(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["v"]), 5).alias("total_v"),
    )


@reg.add(
    "P10_diagnostic_positions",
    "WITH " + SIGNAL_SQL + """SELECT run, shotnum::BIGINT AS shotnum, ix::BIGINT AS ix, iramp FROM ramps WHERE ishot = 0 AND ix % 2 = 0""",
)
def p10(spark, sf):
    chosen = S.paired_ramps(S.diagnostic_shots(raw_signals(spark, sf), SCAN, 2), SCAN)
    return chosen.select(
        "run", "shotnum", F.col("ix").cast("bigint").alias("ix"), F.col("iramp").cast("bigint").alias("iramp")
    )

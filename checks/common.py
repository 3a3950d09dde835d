"""Adapters from the given tables to the library's inputs, in Spark and in SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampfield.functions.batches import as_lists
from rampfield.params import FitParams, ScanParams
from rampfield.sources.scratch import scratch_folder

# workers need no copy of these adapters
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is already registered")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def R(expression: str, digits: int) -> str:
    """Rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"


# --- signals -------------------------------------------------------------------------

SIGNAL_SCAN = ScanParams(
    geometry="xy_plane", nx=5, ny=100, nshots=2, nt_full=64, dt_s=1e-6, x_min_cm=-4.0,
    x_max_cm=4.0, y_min_cm=-10.0, y_max_cm=10.0, sweep_start=8, sweep_end=19, nramps=3,
    ramp_spacing=16, board=1, voltage_channel=0, current_channel=1, voltage_attenuation=100.0,
    current_attenuation=2.0, current_resistance_ohm=4.0, negate_current=True, subtract_dc=True,
    dc_start=0, dc_end=5, isat_start=2, isat_end=6, sg_window=6, sg_order=2,
)

SIGNAL_SHOTS = SIGNAL_SCAN.last_shot


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as raw shots: even vectors are voltages, odd ones currents of the same shot.

    A thousand shots make a run, so that every vector belongs to a scan.
    """
    e = table(spark, sf_dir, "embeddings").withColumn("shot", F.floor(F.col("vec_id") / 2))
    return e.select(
        F.concat(F.lit("e"), F.floor(F.col("shot") / SIGNAL_SHOTS).cast("string")).alias("run"),
        F.lit(1).alias("board"), (F.col("vec_id") % 2).cast("int").alias("channel"),
        (F.col("shot") % SIGNAL_SHOTS + 1).cast("bigint").alias("shotnum"),
        F.col("embedding").alias("signal"), F.lit(1e-6).alias("dt_s"),
    )


SIGNAL_SQL = """
shots AS MATERIALIZED (
  SELECT vec_id % 2 AS channel, 'e' || (vec_id // 2 // 1000) AS run, vec_id // 2 % 1000 + 1 AS shotnum,
         list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings),
pos AS (
  SELECT *, (shotnum - 1) % 2 AS ishot, ((shotnum - 1) // 2) % 5 AS ix,
         99 - (shotnum - 1) // 10 AS iy FROM shots),
volts AS (SELECT run, shotnum, iy, ix, ishot, list_transform(y, lambda x: x * 100.0::DOUBLE) AS v
          FROM pos WHERE channel = 0),
amps0 AS (SELECT run, shotnum, list_transform(y, lambda x: x * -0.5::DOUBLE) AS i FROM pos WHERE channel = 1),
amps AS (SELECT run, shotnum, i, list_avg(i[1:6]) AS dc FROM amps0),
ramps AS MATERIALIZED (
  SELECT run, shotnum, iy, ix, ishot, r::BIGINT AS iramp, v[8 + r * 16 + 1 : 8 + r * 16 + 12] AS v,
         list_transform(i[8 + r * 16 + 1 : 8 + r * 16 + 12], lambda x: x - dc) AS i, dc
  FROM volts JOIN amps USING (run, shotnum), range(3) t(r)),
samples AS (
  SELECT run, shotnum, iy, ix, ishot, iramp, k::BIGINT AS k, v[k + 1] AS v, i[k + 1] AS i
  FROM ramps, range(12) t(k))
"""

# --- measured traces -----------------------------------------------------------------


def real_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples: one trace per supplier, in the order of all columns."""
    l = table(spark, sf_dir, "lineitem")
    return l.withColumns(
        {
            "trace": F.col("l_suppkey"),
            "v": F.col("l_quantity") + 10 * F.col("l_discount"),
            "i": F.col("l_extendedprice") / 1000 - 20,
        }
    )


REAL_ORDER = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
REAL_SQL = """
real AS (SELECT l_suppkey AS trace, l_quantity + 10 * l_discount AS v,
                l_extendedprice / 1000 - 20 AS i, * FROM lineitem)
"""

# --- model traces --------------------------------------------------------------------

AREA_M2 = 4e-6
MODEL = FitParams(
    iv_npts=64, voltage_bin_width=0.1, vp_smoothing_width_V=1.0, probe_area=AREA_M2,
    current_zero_calibrated=True,
)


def model_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("trace"), (1.5 + 0.5 * (s % 7)).alias("true_te"), (5.0 + s % 5).alias("true_vp"),
        (0.002 * (1 + 0.25 * (s % 3))).alias("true_ies"), (1e-4 * (1 + 0.5 * (s % 4))).alias("true_iis"),
    )


#: traces of a task and of an Arrow batch
TASK_TRACES, BATCH_TRACES = 500, 100


def model_traces(
    spark: SparkSession, sf_dir: str, variant: bool = False, halo: bool = False
) -> DataFrame:
    """supplier as closed-form traces with ripple: (trace, v ARRAY, i ARRAY).

    ``variant`` damages some traces so that each kind of rejection occurs; ``halo``
    adds hot electrons to every third one. Tasks grow in number with the table, not in size.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TRACES):
                yield model_batch(batch.slice(start, BATCH_TRACES), variant, halo)

    p = model_parameters(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-p.count() // TASK_TRACES))
    return p.repartition(tasks, "trace").mapInArrow(made, "trace bigint, v array<double>, i array<double>")


def model_batch(batch: pa.RecordBatch, variant: bool, halo: bool) -> pa.RecordBatch:
    """The traces of a batch of parameters."""
    trace, te, vp, ies, iis = (
        batch.column(name).to_numpy(zero_copy_only=False)[:, None] for name in ("trace", "true_te", "true_vp", "true_ies", "true_iis")
    )
    k = np.arange(1901)
    kind, number = trace % 11, trace.astype(float)
    turn = np.where(kind == 5, 2 * np.minimum(k, 1900 - k), k) if variant else k
    v = vp - 15 * te + 22 * te * turn / 1900 + 0.001 * np.sin(4.1 * k + number)
    sign, noise = (np.where(kind == 4, -1.0, 1.0), np.where(kind == 8, 0.0005, 0.000002)) if variant else (1.0, 0.000002)
    below = v <= vp
    electrons = ies * np.where(below, np.exp(np.minimum(v - vp, 0) / te), 1)
    ions = iis * np.where(below, 1, np.exp(-np.maximum(v - vp, 0) / 0.2))
    i = sign * (electrons - ions) + noise * np.sin(12.9898 * k + number)
    if halo:
        i = i + np.where(trace % 3 == 1, 0.05 * ies * np.exp(np.minimum(v - vp, 0) / 20), 0)
    keep = np.ones(v.shape, bool)
    if variant:
        keep = (
            ~((kind == 6) & (v > vp - 1) & (v < vp + 1.2)) & ~((kind == 7) & (v > vp + 0.3)) & ~((kind == 9) & (v < vp - 2 * te))
        )
    samples = [as_lists(values[keep], keep.sum(1)) for values in (v, i)]
    return pa.RecordBatch.from_arrays([batch.column("trace"), *samples], names=["trace", "v", "i"])


def model_sql(variant: bool = False, halo: bool = False) -> str:
    turn = "CASE WHEN trace % 11 = 5 THEN 2 * least(k, 1900 - k) ELSE k END" if variant else "k"
    noise = "(CASE WHEN trace % 11 = 8 THEN 0.0005::DOUBLE ELSE 0.000002::DOUBLE END)" if variant else "0.000002::DOUBLE"
    sign = "(CASE WHEN trace % 11 = 4 THEN -1::DOUBLE ELSE 1::DOUBLE END)" if variant else "1::DOUBLE"
    extra = (
        " + CASE WHEN trace % 3 = 1 THEN 0.05::DOUBLE * true_ies * exp(least(v - true_vp, 0) / 20::DOUBLE) ELSE 0 END"
        if halo else ""
    )
    keep = (
        "WHERE NOT (trace % 11 = 6 AND v > true_vp - 1 AND v < true_vp + 1.2::DOUBLE)"
        " AND NOT (trace % 11 = 7 AND v > true_vp + 0.3::DOUBLE)"
        " AND NOT (trace % 11 = 9 AND v < true_vp - 2 * true_te)"
        if variant else ""
    )
    return f"""
model AS MATERIALIZED (
  SELECT s_suppkey AS trace, 1.5::DOUBLE + 0.5::DOUBLE * (s_suppkey % 7) AS true_te,
         5.0::DOUBLE + s_suppkey % 5 AS true_vp,
         0.002::DOUBLE * (1 + 0.25::DOUBLE * (s_suppkey % 3)) AS true_ies,
         1e-4::DOUBLE * (1 + 0.5::DOUBLE * (s_suppkey % 4)) AS true_iis FROM supplier),
rawv AS (
  SELECT *, true_vp - 15 * true_te + 22 * true_te * ({turn}) / 1900::DOUBLE
         + 0.001::DOUBLE * sin(4.1::DOUBLE * k + trace) AS v
  FROM model, range(1901) t(k)),
raw AS MATERIALIZED (
  SELECT trace, k, v, {sign} * (true_ies * CASE WHEN v <= true_vp THEN exp((v - true_vp) / true_te) ELSE 1 END
         - true_iis * CASE WHEN v <= true_vp THEN 1 ELSE exp(-(v - true_vp) / 0.2::DOUBLE) END)
         + {noise} * sin(12.9898::DOUBLE * k + trace){extra} AS i
  FROM rawv {keep})
"""


def shared_root(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach."""
    return scratch_folder(spark)


# --- grids and series ----------------------------------------------------------------


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as repeated shots along a line: ix by nation, ramp by market segment."""
    c = table(spark, sf_dir, "customer")
    ramp = F.array_position(
        F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]),
        F.col("c_mktsegment"),
    )
    return c.select(
        F.lit("c").alias("run"), F.lit(0).alias("iy"), F.col("c_nationkey").alias("ix"),
        (ramp - 1).cast("int").alias("iramp"), "c_custkey", F.col("c_acctbal").alias("value"),
    )


LINE_SQL = """
line AS (
  SELECT c_nationkey AS ix, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD',
         'MACHINERY'], c_mktsegment) - 1 AS iramp, c_custkey, c_acctbal AS value FROM customer),
prof AS MATERIALIZED (
  SELECT iramp, ix, avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n
  FROM line GROUP BY ALL)
"""


def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every position and ramp, with positions missing where ix is a multiple of 7."""
    rows = line_values(spark, sf_dir).groupBy("run", "iy", "ix", "iramp").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")
    )
    return rows.withColumns(
        {
            "m": F.when(F.col("ix") % 7 != 0, F.col("m")),
            "x_cm": F.col("ix") * 0.5 - 6.0,
        }
    )


PROFILE_SQL = LINE_SQL + """,
p AS MATERIALIZED (
  SELECT iramp, ix, CASE WHEN ix % 7 <> 0 THEN m END AS m, sd, ix * 0.5::DOUBLE - 6 AS x FROM prof)
"""


def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a map: y by brand number, x by size, value the mean price; ramp by parity of the key."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("iy"),
        F.col("p_size").alias("ix"), (F.col("p_partkey") % 2).cast("int").alias("iramp"),
        F.col("p_retailprice").alias("z"),
    ).groupBy("iramp", "iy", "ix").agg(F.avg("z").alias("z")).withColumns(
        {
            "run": F.lit("p"), "z": F.when((F.col("ix") + F.col("iy")) % 13 != 0, F.col("z")),
            "x_cm": F.col("ix") * 0.4, "y_cm": F.col("iy") * 0.5 - 6.1,
        }
    )


MAP_SQL = """
cells AS MATERIALIZED (
  SELECT iramp, iy, ix, CASE WHEN (ix + iy) % 13 <> 0 THEN z END AS z, ix * 0.4::DOUBLE AS x,
         iy * 0.5::DOUBLE - 6.1::DOUBLE AS y
  FROM (SELECT regexp_extract(p_brand, '#(\\d+)', 1)::INT AS iy, p_size AS ix,
               (p_partkey % 2)::INT AS iramp, avg(p_retailprice) AS z FROM part GROUP BY ALL))
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: one per user, in time order; by is the value, bz the number in props."""
    from rampfield.operators.keys import position_in_group

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), "ts", "event_id", F.col("value").alias("by"),
        F.get_json_object("props", "$.k").cast("double").alias("bz"),
    )
    ranked = position_in_group(e, ["series"], ["ts", "event_id"], "k")
    return ranked.select("series", "k", "by", "bz")


SERIES_SQL = """
ser AS MATERIALIZED (
  SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k,
         value AS y, json_extract_string(props, '$.k')::DOUBLE AS z FROM events)
"""


def gappy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component with gaps at the start, inside and at the end."""
    return series(spark, sf_dir).select(
        "series", "k", F.when((F.col("k") > 2) & (F.col("k") % 5 != 3), F.col("by")).alias("value")
    )


# --- small scans ---------------------------------------------------------------------

#: fifty shots make a run, so that the given vectors fill whole scans
SMALL_SCAN = replace(SIGNAL_SCAN, ny=5, isat_start=2, isat_end=6, fit=FitParams(iv_npts=32, probe_area=4e-6))


def small_scan_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as raw shots of many small scans."""
    e = table(spark, sf_dir, "embeddings").withColumn("shot", F.floor(F.col("vec_id") / 2))
    return e.select(
        F.concat(F.lit("e"), F.floor(F.col("shot") / SMALL_SCAN.last_shot).cast("string")).alias("run"),
        F.lit(1).alias("board"), (F.col("vec_id") % 2).cast("int").alias("channel"),
        (F.col("shot") % SMALL_SCAN.last_shot + 1).cast("bigint").alias("shotnum"),
        F.col("embedding").alias("signal"), F.lit(1e-6).alias("dt_s"),
    )


SMALL_SCAN_SQL = SIGNAL_SQL.replace("1000", "50").replace("99 -", "4 -")

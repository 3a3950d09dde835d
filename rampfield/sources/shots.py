"""Raw digitizer shots: loading, grid positions and channel pairing.

Input contract, one row per shot and channel:
``raw_shots(run, board INT, channel INT, shotnum BIGINT, signal ARRAY<FLOAT>, dt_s DOUBLE)``.
Signals are cast to DOUBLE before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import X, put
from ..operators.conditioning import baseline_mean, calibrated, ramps_of
from ..params import ScanParams


def read_raw_shots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- SRC1 ----------------------------------------------------------------------------


def _own_shots(raw_shots: DataFrame, scan: ScanParams, channel: int) -> tuple[DataFrame, Column, Column]:
    """The shots of a channel, whether a signal has its full length, and what to say if not."""
    wanted = raw_shots.where(
        (F.col("board") == scan.board)
        & (F.col("channel") == channel)
        & F.col("shotnum").between(scan.first_shot, scan.last_shot)
    )
    message = F.lit(f"Channel {channel}: time-length mismatch, expected {scan.nt_full} samples.")
    return wanted, F.size("signal") == scan.nt_full, message


def channel_shots(raw_shots: DataFrame, scan: ScanParams, channel: int) -> DataFrame:
    """SRC1: the shots of one channel in the scan's shot range.

    The filter reaches the scan of the table.  A trace of the wrong length fails
    the query; missing shots are reported by :func:`channel_check`.
    """
    wanted, whole, message = _own_shots(raw_shots, scan, channel)
    return wanted.where(F.assert_true(whole, message).isNull())


def _whole_signals(raw_shots: DataFrame, scan: ScanParams, channel: int) -> DataFrame:
    """As :func:`channel_shots`, with the length asserted where the signal is used.

    As a filter the assertion would move below a join that leaves runs out, and fail on their shots too.
    """
    wanted, whole, message = _own_shots(raw_shots, scan, channel)
    return wanted.withColumn("signal", F.when(whole, F.col("signal")).otherwise(F.raise_error(message)))


INDEX = ("run", "board", "channel", "shotnum", "dt_s", "n_samples")


def shot_index(shots: DataFrame) -> DataFrame:
    """The index of a table of shots: no signals. Lengths that were not stored are those of the signals."""
    length = F.col("n_samples") if "n_samples" in shots.columns else F.size("signal")
    return shots.select(*INDEX[:-1], length.cast("bigint").alias("n_samples"))


def ingest_shots(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """Adds a batch to the shots under ``path`` and returns (run, board, channel, shotnum) it repeats.

    Shots go to ``path/shots``, with the length of every signal as ``n_samples``; their index goes
    to ``path/index``. What a batch has in common with itself and with earlier ones is found in
    the indices of the runs it brings, so no earlier signal is read.
    """
    sized = batch.withColumn("n_samples", F.size("signal").cast("bigint"))
    name = ["run", "board", "channel", "shotnum"]
    sized.write.mode("append").partitionBy("run").parquet(f"{path}/shots")
    index = shot_index(batch.withColumn("n_samples", F.size("signal").cast("bigint")))
    index.write.mode("append").partitionBy("run").parquet(f"{path}/index")
    stored = read_shot_index(spark, path)
    touched = batch.select(F.col("run").cast("string").alias("run")).distinct()
    again = stored.join(touched, "run", "left_semi").groupBy(*name).agg(F.count(F.lit(1)).alias("_n"))
    return again.where("_n > 1").select(*name)


def read_shot_index(spark: SparkSession, path: str) -> DataFrame:
    kinds = "board int, channel int, shotnum bigint, dt_s double, n_samples bigint, run string"
    return spark.read.schema(kinds).parquet(f"{path}/index").select(*INDEX)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    kinds = "board int, channel int, shotnum bigint, signal array<float>, dt_s double, n_samples bigint, run string"
    return spark.read.schema(kinds).parquet(f"{path}/shots")


def channel_check(raw_shots: DataFrame, scan: ScanParams, channel: int) -> DataFrame:
    """One row per run: shots found, shortest and longest trace, and the violation if any.

    With an index or shots that carry ``n_samples`` no signal is read; unknown lengths pass.
    """
    expected = scan.last_shot - scan.first_shot + 1
    own = (
        (F.col("board") == scan.board) & (F.col("channel") == channel)
        & F.col("shotnum").between(scan.first_shot, scan.last_shot)
    )
    length = F.col("n_samples") if "n_samples" in raw_shots.columns else F.size("signal")
    # every run has a row, so a run without the channel is found too
    found = raw_shots.groupBy("run").agg(
        F.count_if(own).alias("n_shots"),
        F.count_distinct(F.when(own, F.col("shotnum"))).alias("_distinct"),
        F.min(F.when(own, length)).cast("bigint").alias("min_nt"),
        F.max(F.when(own, length)).cast("bigint").alias("max_nt"),
    )
    return found.withColumn(
        "violation",
        F.when(F.col("n_shots") == 0, F.lit("channel absent"))
        .when(F.col("n_shots") != F.col("_distinct"), F.lit("shots stored twice"))
        .when(F.col("n_shots") != expected, F.lit("shot count mismatch"))
        .when(
            (F.col("min_nt") != scan.nt_full) | (F.col("max_nt") != scan.nt_full),
            F.lit("time-length mismatch"),
        ),
    ).drop("_distinct")


def interval_check(raw_shots: DataFrame, scan: ScanParams) -> DataFrame:
    """SRC7 for a scan: one row per run with the violation of its sample intervals, if any.

    Both channels must agree; with stored timing they must also exist and match the setting.
    """
    from .sampling import close_intervals

    def of(channel: int, name: str) -> list[Column]:
        dt = F.when((F.col("board") == scan.board) & (F.col("channel") == channel), F.col("dt_s"))
        return [F.min(dt).alias(f"{name}_low"), F.max(dt).alias(f"{name}_high")]

    found = raw_shots.groupBy("run").agg(*of(scan.voltage_channel, "v"), *of(scan.current_channel, "i"))
    low, high = F.least("v_low", "i_low"), F.greatest("v_high", "i_high")
    violation = F.when(~close_intervals(low, high), F.lit("different sample intervals"))
    if scan.timing_source == "hdf5":
        absent = F.col("v_low").isNull() | F.col("i_low").isNull()
        violation = F.when(absent, F.lit("missing sample interval")).otherwise(
            F.coalesce(violation, F.when(~close_intervals(low, F.lit(float(scan.dt_s))), F.lit("sample interval changed")))
        )
    return found.select("run", violation.alias("violation"))


def require_complete(check: DataFrame) -> None:
    """Raise when a check of one row per run reports a violation."""
    bad = check.where("violation is not null").select("run", "violation").first()
    if bad is not None:
        raise ValueError(f"run {bad['run']}: {bad['violation']}")


# --- SRC2, SRC3 ----------------------------------------------------------------------


def with_position(shots: DataFrame, scan: ScanParams) -> DataFrame:
    """SRC2: adds ``iy, ix, ishot`` from the shot number (y-major, then x, then repeats).

    They are NULL for a shot outside the scan.
    """
    order = F.when(
        F.col("shotnum").between(scan.first_shot, scan.last_shot), F.col("shotnum") - scan.first_shot
    )
    row = F.floor(order / (scan.nshots * scan.nx))
    if scan.geometry == "xy_plane" and scan.y_order == "descending":
        row = scan.ny - 1 - row
    return shots.withColumns(
        {
            "iy": row.cast("int"),
            "ix": (F.floor(order / scan.nshots) % scan.nx).cast("int"),
            "ishot": (order % scan.nshots).cast("int"),
        }
    )


def _shot(scan: ScanParams, iy, ix, ishot):
    """Shot of a position, for columns and for numbers alike."""
    upward = scan.geometry == "xy_plane" and scan.y_order == "descending"
    row = scan.ny - 1 - iy if upward else iy
    return scan.first_shot + (row * scan.nx + ix) * scan.nshots + ishot


def _extent(scan: ScanParams) -> dict[str, int]:
    """How many positions each index has."""
    return {"iy": scan.ny if scan.geometry == "xy_plane" else 1, "ix": scan.nx, "ishot": scan.nshots}


def shot_number(scan: ScanParams, iy: Column, ix: Column, ishot: Column) -> Column:
    """Inverse of :func:`with_position`; NULL for an index outside the scan."""
    inside = F.lit(True)
    for index, count in zip((iy, ix, ishot), _extent(scan).values()):
        inside = inside & index.between(0, count - 1)
    return F.when(inside, _shot(scan, iy, ix, ishot).cast("bigint"))


def diagnostic_shots(raw_shots: DataFrame, scan: ScanParams, every: int | None) -> DataFrame:
    """P10 before anything is cut: the first shot at every N-th position; none when N is not positive.

    The positions' shot numbers are known from the layout, so the filter reaches the scan of the table.
    """
    if not every or every < 0:
        return raw_shots.where(F.lit(False))
    chosen = [_shot(scan, iy, ix, 0) for iy in range(_extent(scan)["iy"]) for ix in range(0, scan.nx, every)]
    return raw_shots.where(F.col("shotnum").isin(*chosen))


def even_axis(index: Column, low: float, high: float, n: int) -> Column:
    """Coordinate of an index on ``n`` evenly spaced points with exact ends."""
    if n == 1:
        return F.lit(float(low))
    step = (high - low) / (n - 1)
    return F.when(index == n - 1, F.lit(float(high))).otherwise(low + index * step)


def _cell_columns(cells: DataFrame, scan: ScanParams) -> DataFrame:
    """Adds ``iy, ix, x_cm, y_cm`` to rows numbered by ``cell``."""
    ny = scan.ny if scan.geometry == "xy_plane" else 1
    placed = cells.withColumns(
        {
            "iy": F.floor(F.col("cell") / scan.nx).cast("int"),
            "ix": (F.col("cell") % scan.nx).cast("int"),
        }
    )
    return placed.withColumns(
        {
            "x_cm": even_axis(F.col("ix"), scan.x_min_cm, scan.x_max_cm, scan.nx),
            "y_cm": even_axis(F.col("iy"), scan.y_min_cm, scan.y_max_cm, ny),
        }
    ).drop("cell")


def position_grid(spark: SparkSession, scan: ScanParams) -> DataFrame:
    """SRC3: dense grid ``iy, ix, x_cm, y_cm`` of the scan, derived from one id range."""
    return _cell_columns(spark.range(scan.positions).withColumnRenamed("id", "cell"), scan)


def on_grid(rows: DataFrame, scan: ScanParams) -> DataFrame:
    """SRC3: every input row once per cell of the dense grid; needs no join."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(scan.positions - 1)))
    return _cell_columns(rows.withColumn("cell", cells), scan)


# --- SRC4 ----------------------------------------------------------------------------


def paired_ramps(raw_shots: DataFrame, scan: ScanParams) -> DataFrame:
    """SRC4 with P1, P3 and P5: one row per (run, shot, ramp) holding both signals.

    Each channel is calibrated, baseline-corrected and cut to its ramps before
    the join, so only swept samples are shuffled.  The join keys cluster every
    later grouping by shot, which needs no further exchange.
    """
    volts = _whole_signals(raw_shots, scan, scan.voltage_channel)
    amps = _whole_signals(raw_shots, scan, scan.current_channel)
    v_full = calibrated("signal", scan.voltage_attenuation)
    i_full = calibrated(
        "signal", scan.current_attenuation / scan.current_resistance_ohm, scan.negate_current
    )
    v_rows = put(volts, "v_ramps", ramps_of(v_full, scan)).select(
        "run", "shotnum", "v_ramps", F.col("dt_s").alias("v_dt_s")
    )
    if scan.subtract_dc:
        amps = put(put(amps, "_full", i_full), "dc_offset_A", baseline_mean("_full", scan))
        i_full = X.col("_full")
        offset = X.col("dc_offset_A")
    else:
        amps = amps.withColumn("dc_offset_A", F.lit(0.0))
        offset = None
    i_rows = put(amps, "i_ramps", ramps_of(i_full, scan, offset)).select(
        "run", "shotnum", "i_ramps", "dc_offset_A", F.col("dt_s").alias("i_dt_s")
    )
    pairs = v_rows.join(i_rows, ["run", "shotnum"], "inner")
    ramps = pairs.select(
        "run", "shotnum", "v_dt_s", "i_dt_s", "dc_offset_A",
        F.posexplode(F.arrays_zip("v_ramps", "i_ramps")).alias("iramp", "_r"),
    )
    return with_position(ramps, scan).select(
        "run", "iy", "ix", "ishot", "iramp", "shotnum", "v_dt_s", "i_dt_s", "dc_offset_A",
        F.col("_r.v_ramps").alias("v"), F.col("_r.i_ramps").alias("i"),
    )


def paired_samples(raw_shots: DataFrame, scan: ScanParams) -> DataFrame:
    """SRC4 at sample grain: (run, shotnum, iramp, k, v, i)."""
    return paired_ramps(raw_shots, scan).select(
        "run", "shotnum", "iramp", F.posexplode(F.arrays_zip("v", "i")).alias("k", "_s")
    ).select("run", "shotnum", "iramp", "k", F.col("_s.v").alias("v"), F.col("_s.i").alias("i"))


# --- SRC5 ----------------------------------------------------------------------------


def preview_trace(
    raw_shots: DataFrame, scan: ScanParams, run: str, iy: int, ix: int, ishot: int
) -> DataFrame:
    """SRC5: full V and I of one position and shot against time (run, k, t_s, v, i).

    The shot filter is a literal, so only that shot is read.  A shot missing from
    either channel fails the query.
    """
    chosen = {"iy": iy, "ix": ix, "ishot": ishot}
    outside = [name for name, count in _extent(scan).items() if chosen[name] not in range(count)]
    if outside:
        raise ValueError(f"no such position: {', '.join(f'{n}={chosen[n]!r}' for n in outside)}")
    shot = int(_shot(scan, iy, ix, ishot))
    one = raw_shots.where(
        (F.col("board") == scan.board) & (F.col("shotnum") == shot) & (F.col("run") == run)
        & F.col("channel").isin(scan.voltage_channel, scan.current_channel)
    )
    signal = lambda channel: F.max(F.when(F.col("channel") == channel, F.col("signal")))
    both = one.agg(
        F.max("run").alias("run"),
        signal(scan.voltage_channel).alias("v_raw"),
        signal(scan.current_channel).alias("i_raw"),
    )
    present = both.where(
        F.assert_true(
            F.coalesce(
                (F.size("v_raw") == scan.nt_full) & (F.size("i_raw") == scan.nt_full), F.lit(False)
            ),
            F.lit(f"shot {shot}: a channel is absent or not {scan.nt_full} samples long"),
        ).isNull()
    )
    full = put(
        present,
        {
            "v": calibrated("v_raw", scan.voltage_attenuation),
            "_i": calibrated(
                "i_raw", scan.current_attenuation / scan.current_resistance_ohm, scan.negate_current
            ),
        },
    )
    if scan.subtract_dc:
        full = put(put(full, "_dc", baseline_mean("_i", scan)), "i", _minus("_i", "_dc"))
    else:
        full = full.withColumnRenamed("_i", "i")
    return full.select(
        "run", F.posexplode(F.arrays_zip("v", "i")).alias("k", "_s")
    ).select(
        "run", "k", (F.col("k") * scan.dt_s).alias("t_s"),
        F.col("_s.v").alias("v"), F.col("_s.i").alias("i"),
    )


def _minus(array: str, value: str):
    from ..functions.arrays import let_struct

    return let_struct(
        lambda s: X.transform(s.a, lambda x: x - s.m), a=X.col(array), m=X.col(value)
    )

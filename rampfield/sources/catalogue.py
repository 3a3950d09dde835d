"""Lookups in the acquisition catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def configuration_names(entries: DataFrame, group: str, name: str = "name") -> DataFrame:
    """SRC8: distinct configuration names of each group, in case-insensitive order.

    ``entries(group, name)`` serves digitizer and motion configurations alike.
    """
    return entries.select(group, name).distinct().orderBy(group, F.lower(name), name)


def channel_label_key(adc: str, channel: int) -> str:
    """Attribute that holds a channel's data-type label for a digitizer model."""
    # Attribute naming of the two supported digitizer models.
    if adc == "SIS 3302":
        return f"Data type {channel}"
    if adc == "SIS 3305":
        return f"FPGA {1 if channel <= 4 else 2} Data type {channel if channel <= 4 else channel - 4}"
    raise ValueError(f"data-type labels are unavailable for ADC {adc!r}.")


def channel_data_types(
    wanted: DataFrame, slots: DataFrame, labels: DataFrame
) -> DataFrame:
    """SRC8: data-type label of each wanted (config, slot, key) through its slot entry.

    ``slots(config, slot, config_index)`` must name exactly one index per slot;
    ``labels(config, config_index, key, label)`` holds the text.  ``violation``
    says why a label is missing.
    """
    index = slots.groupBy("config", "slot").agg(
        F.count(F.lit(1)).alias("_entries"), F.min("config_index").alias("config_index")
    )
    placed = wanted.join(index, ["config", "slot"], "left")
    labelled = placed.join(labels, ["config", "config_index", "key"], "left")
    one = F.coalesce(F.col("_entries") == 1, F.lit(False))
    return labelled.select(
        "config", "slot", "key",
        F.when(one, F.trim("label")).alias("label"),
        F.when(~one, F.lit("slot does not identify exactly one configuration"))
        .when(F.col("label").isNull(), F.lit("no data-type metadata"))
        .alias("violation"),
    )


def run_description(info: DataFrame, run: str) -> DataFrame:
    """SRC8: description of one run, empty when none is stored."""
    return info.where(F.col("run") == run).agg(
        F.coalesce(F.trim(F.max("description")), F.lit("")).alias("description")
    )

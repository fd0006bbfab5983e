"""Versioned configurations: arrays of (version, timestamp, config map), newest first after an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(history: Column) -> Column:
    return F.array_max(F.transform(history, lambda h: F.struct(h["version"].alias("version"), h["timestamp"].alias("timestamp"), F.to_json(h["config"]).alias("config"))))


def pick(history: Column, index: Column, mode: str = "as_written") -> Column:
    """The entry at an index, else the array's last one (``as_written``) or the highest version (``latest``)."""
    fallback = F.try_element_at(history, F.lit(-1))
    if mode == "latest":
        fallback = F.get(F.filter(history, lambda h: h["version"] == F.array_max(F.transform(history, lambda x: x["version"]))), 0)
    return F.when((index >= 0) & (index < F.size(history)), F.get(history, index)).otherwise(fallback)


def merged(old: Column, new: Column) -> Column:
    """Maps merged by key, new values before old ones."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def append_version(configs: DataFrame, updates: DataFrame) -> DataFrame:
    """Adds to each updated history the highest version's config merged with the update; newest first."""
    rows = configs.join(updates.select("id", F.col("changes").alias("_new"), F.col("timestamp").alias("_at")), "id", "left")
    top = F.get(F.filter("config_version_history", lambda h: h["version"] == F.array_max(F.transform("config_version_history", lambda x: x["version"]))), 0)
    entry = F.struct((F.coalesce(top["version"], F.lit(-1)) + 1).cast("int").alias("version"), F.col("_at").alias("timestamp"), merged(F.coalesce(top["config"], F.create_map().cast("map<string,string>")), F.col("_new")).alias("config"))
    newest_first = lambda a, b: F.when(a["version"] > b["version"], -1).when(a["version"] < b["version"], 1).otherwise(0)
    history = F.array_sort(F.array_prepend("config_version_history", entry), newest_first)
    return rows.withColumn("config_version_history", F.when(F.col("_new").isNull(), F.col("config_version_history")).otherwise(history)).drop("_new", "_at")


def set_default(configs: DataFrame, tenant_id: int, config_id: int) -> DataFrame:
    """Makes one configuration of a tenant the default, and no other."""
    return configs.withColumn("is_default", F.when(F.col("tenant_id") == tenant_id, F.col("id") == config_id).otherwise(F.col("is_default")))


def setting(config: Column, key: str, default: str, zero_is_missing: bool = False) -> Column:
    """A value or its default; with ``zero_is_missing`` 0 counts as missing."""
    v = F.try_element_at(config, F.lit(key))
    return F.when(v.try_cast("double") != 0, v).otherwise(F.lit(default)) if zero_is_missing else F.coalesce(v, F.lit(default))

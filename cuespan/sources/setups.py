"""Named editor setups as an append-only table: (name, saved_at, payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.text import setup_name

DEFAULT = "default"


def saved(saves: DataFrame) -> DataFrame:
    return saves.withColumn("name", setup_name(F.col("name")))


def latest_setups(saves: DataFrame) -> DataFrame:
    """Newest save per clean name. ``orderBy(desc('saved_at'))`` gives the listing."""
    return saved(saves).groupBy("name").agg(F.max("saved_at").alias("saved_at"), F.max_by("payload", "saved_at").alias("payload"))


def load_setups(asked: DataFrame, saves: DataFrame, legacy: DataFrame) -> DataFrame:
    """Payload per asked name; the default name falls back to the legacy save."""
    wanted = saved(asked)
    found = wanted.join(latest_setups(saves).select("name", "payload"), "name", "left")
    old = legacy.select(F.lit(DEFAULT).alias("name"), F.col("payload").alias("_old")).limit(1)
    return found.join(old, "name", "left").withColumn("payload", F.coalesce("payload", "_old")).drop("_old")

"""Filters of a proven size that keep large tables out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the hashes that are broadcast: a table of so many numbers at most, whatever the input.
SLOTS = 1 << 20


def possible(rows: DataFrame, wanted: DataFrame, *columns: str, slots: int = SLOTS) -> DataFrame:
    """rows whose columns may be among those of wanted, by a hash of them in one of `slots` slots; none that is among them is lost.

    wanted's occupied slots are broadcast, so what surely isn't there is left out where it is read; join the rest exactly.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")
    taken = wanted.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")

"""Bounded samples of labelled rows, without sorting or gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, group: Column, identity: Column, most: int) -> DataFrame:
    """About ``most`` rows of each group (all of a smaller one): those whose hash of ``identity`` is
    below most / (rows of the group).  A count per group decides; rows stay where they are, and the
    group of a row is only looked at where its hash may do.  Groups are few (labels); rows with a null
    group are left out.  Columns named ``_group`` or ``_draw`` must not be among the rows'."""
    own = group.cast("string")
    counts = {r["_group"]: r["count"] for r in rows.groupBy(own.alias("_group")).count().where("_group IS NOT NULL").collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("_group") == name, most / n).otherwise(share)
    drawn = rows.withColumn("_draw", F.xxhash64(identity) / F.lit(2.0**64) + 0.5).where(F.col("_draw") < max((most / n for n in counts.values()), default=0.0))
    return drawn.withColumn("_group", own).where(F.col("_group").isNotNull() & (F.col("_draw") < share)).drop("_group", "_draw")

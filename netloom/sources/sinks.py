"""Writers: upserts by column rule, first-wins inserts, slots and snapshots as partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, updates: DataFrame, *, keys: Sequence[str], rules: Mapping[str, str], order: str) -> DataFrame:
    """target after updates. Rules by column: coalesce (new unless null), max, min, keep (the first), replace.

    Of several updates of a key the newest by ``order`` counts for coalesce and replace, the oldest for keep; columns
    without a rule are replaced. One shuffle: old and new rows are grouped by key together.
    """
    old = target.withColumns({"_new": F.lit(0), "_order": F.lit(None).cast(updates.schema[order].dataType)})
    new = updates.select(*target.columns, F.lit(1).alias("_new"), F.col(order).alias("_order"))
    at = F.struct("_new", F.col("_order").isNotNull(), "_order")
    kinds = {
        "coalesce": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
        "max": F.max,
        "min": F.min,
        "keep": lambda c: F.min_by(c, at),
        "replace": lambda c: F.max_by(c, at),
    }
    columns = [c for c in target.columns if c not in keys]
    return old.unionByName(new).groupBy(*keys).agg(*(kinds[rules.get(c, "replace")](c).alias(c) for c in columns)).select(*target.columns)


def insert_if_new(target: DataFrame, batch: DataFrame, *, keys: Sequence[str], order: str, at: str | None = None, horizon: int = 0) -> DataFrame:
    """Rows of the batch to append: keys that target lacks, the first of each by ``order``, none before the horizon."""
    rows = batch if at is None or not horizon else batch.filter(F.col(at) >= horizon)
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in batch.columns)), order).alias("_r")).select("_r.*")
    return first.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*batch.columns)


def write_slots(slots: DataFrame, path: str, *, period: str) -> None:
    """Replace exactly the slots that the rows belong to."""
    write_periods(slots.withColumn("period", F.lit(period)), path)


def write_periods(slots: DataFrame, path: str) -> None:
    """Replace exactly the slots of each period that the rows belong to.

    Rows of a slot are gathered, but a slot of many rows is dealt to several tasks and small ones share a task: sizes
    are known when it runs.
    """
    out = slots.hint("rebalance", F.col("period"), F.col("period_start_at"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "period_start_at").parquet(path)


def write_snapshot(items: DataFrame, path: str, *, set_key: str, captured_at: int) -> None:
    """A whole set at an instant; written again it replaces itself. Columns of items: item_key, attributes."""
    out = items.withColumns({"set_key": F.lit(set_key), "captured_at": F.lit(captured_at).cast("bigint")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_key", "captured_at").parquet(path)


def write_ordered(df: DataFrame, path: str, *, measure: str, key: str) -> None:
    """Rows by falling measure, ties by key, over files in that order: ranges of the order are dealt to tasks."""
    df.orderBy(F.desc(measure), F.asc(key)).write.mode("overwrite").parquet(path)

"""Order within keys of any size: a key's rows are dealt over tasks in segments, ordered in each, and joined by sums over the segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.operators.graph import cut_lineage

SEGMENT_ROWS = 1 << 16


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{c}_of"]) for c in columns])


def in_order(df: DataFrame, by: list[str], order: list[str], segment: str, last: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1 in each key, by ``order``) and, with ``last``, ``prior``: that column of the row before.

    ``segment`` never falls along the order. A task orders the rows of one key and segment; what crosses segments are their counts and last values, one
    row each. Null keys and segments are keys like others, nulls first.
    """
    local = Window.partitionBy(*by, segment).orderBy(*order)
    rows = df.withColumn("own_rank", F.row_number().over(local))
    sums = [F.count("*").alias("n")]
    if last:
        rows = rows.withColumn("own_prior", F.lag(last).over(local))
        sums.append(F.max_by(F.struct(last), F.struct(*order)).alias("tail"))
    parts = df.groupBy(*by, segment).agg(*sums)
    along = Window.partitionBy(*by).orderBy(segment)
    ahead = parts.select(*[F.col(c).alias(f"{c}_of") for c in (*by, segment)], F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), *([F.lag("tail").over(along).alias("tail_before")] if last else []))
    rows = rows.join(ahead, _same(rows, ahead, [*by, segment])).withColumn("rank", F.col("ahead") + F.col("own_rank"))
    if last:
        rows = rows.withColumn("prior", F.when(F.col("own_rank") == 1, F.col(f"tail_before.{last}")).otherwise(F.col("own_prior")))
    return rows.select(*df.columns, "rank", *(["prior"] if last else []))


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank``, from 1 in each key. Rows are dealt by ranges of (key, order), so a hot key is in as many tasks as its rows fill; the deal is
    written once, as its bounds are drawn from a sample that another run could draw otherwise."""
    dealt = cut_lineage(df.repartitionByRange(*by, *order).withColumn("range_of_rows", F.spark_partition_id()))
    return in_order(dealt, by, order, "range_of_rows").drop("range_of_rows")

"""Work along one order over a whole table, without one task that sees all rows.

Rows are dealt by ranges of the order and written, so that each range stays what it is; what passes from one range to the
next is one row a range: running values over these rows, a few for each partition, are one ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.tables import written


def _dealt(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, *order: Column | str, column: str = "line") -> DataFrame:
    """df with each row's place in the order, from 0. Rows that are equal in the order are numbered as it happens."""
    dealt = _dealt(df, order)
    before = F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    shift = dealt.groupBy("range_").count().select("range_", F.coalesce(before, F.lit(0)).alias("shift_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    # one row a range is broadcast
    return dealt.withColumn("place_", place).join(F.broadcast(shift), "range_").withColumn(column, (F.col("place_") + F.col("shift_")).cast("long")).drop("range_", "place_", "shift_")


def last_mark(df: DataFrame, order: tuple[str, ...], mark: str) -> DataFrame:
    """df with the last value of the column mark that isn't null, at or before each row."""
    dealt = _dealt(df, order)
    own = F.last(mark, ignorenulls=True).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    end = F.max_by(mark, F.when(F.col(mark).isNotNull(), F.struct(*order))).alias("end_")
    before = F.last("end_", ignorenulls=True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    carried = dealt.groupBy("range_").agg(end).select("range_", before.alias("carried_"))
    return dealt.withColumn("own_", own).join(F.broadcast(carried), "range_").withColumn(mark, F.coalesce("own_", "carried_")).drop("range_", "own_", "carried_")

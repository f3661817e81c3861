"""Ranks inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: ``monotonically_increasing_id`` holds the partition above so many bits.
_ROW_BITS = 33


def ranked(df: DataFrame, group: str, order: Sequence[str], scratch: Scratch, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank`` (0-based place in its group, nulls first) and ``n``
    (rows of its group).  Rows are dealt by range over group and order, so a
    group of any size is spread over many tasks; a row's place is its place in
    its partition plus the rows of its group in earlier partitions, of which
    there is one count for each group and partition.  Equal rows are told apart
    by their place in the input, so even they do not have to share a task."""
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("__llm_at")]
    dealt = (df.withColumn("__llm_at", F.monotonically_increasing_id())
               .repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("__llm_at", F.monotonically_increasing_id()))
    dealt = scratch.write(dealt, name).withColumn("__llm_part", F.shiftright("__llm_at", _ROW_BITS))
    parts = dealt.groupBy(group, "__llm_part").agg(F.min("__llm_at").alias("__llm_low"), F.count(F.lit(1)).alias("__llm_c"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__llm_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("__llm_g"), F.col("__llm_part").alias("__llm_p"), "__llm_low",
                         F.coalesce(F.sum("__llm_c").over(earlier), F.lit(0)).alias("__llm_before"),
                         F.sum("__llm_c").over(whole).alias("n"))
    same = F.col(group).eqNullSafe(F.col("__llm_g")) & (F.col("__llm_part") == F.col("__llm_p"))
    return (dealt.join(parts, same)
                 .withColumn("rank", F.col("__llm_at") - F.col("__llm_low") + F.col("__llm_before"))
                 .drop("__llm_at", "__llm_part", "__llm_g", "__llm_p", "__llm_low", "__llm_before"))

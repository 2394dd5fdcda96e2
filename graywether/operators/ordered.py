"""Running sums in an order, worked out range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.sources.steps import Workspace


def running(rows: DataFrame, order: str, sums: list[str], by: tuple[str, ...] = (), desc: bool = False) -> DataFrame:
    """rows with <s>_upto, the sum of s over the rows up to and with this one in the order, and <s>_all, over all rows; apart
    for each value of the columns `by`. Rows of one `by` should differ in the order.

    Rows are dealt to ranges of the order; sums run inside a range, and what the ranges before hold (a row for a range and
    value of `by`) is added. No task sees more than a range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.desc(order) if desc else F.asc(order)
    # written, as the ranges are drawn from a sample and both uses have to see the same
    dealt = Workspace(rows.sparkSession, "running").save(rows.repartitionByRange(ranges, *by, key).withColumn("_part", F.spark_partition_id()), "dealt")
    inside = W.partitionBy("_part", *by).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumns({f"_own_{s}": F.sum(s).over(inside) for s in sums})
    parts = dealt.groupBy("_part", *by).agg(*(F.sum(s).alias(f"_sum_{s}") for s in sums))
    across = W.partitionBy(*by)
    earlier = across.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = {f"_before_{s}": F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)) for s in sums}
    parts = parts.withColumns(before | {f"{s}_all": F.sum(f"_sum_{s}").over(across) for s in sums})
    parts = parts.select(*(F.col(c).alias(f"_k_{c}") for c in ("_part", *by)), *before, *(f"{s}_all" for s in sums))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_part", *by)]
    joined = own
    condition = same[0]
    for c in same[1:]:
        condition &= c
    joined = joined.join(parts, condition)
    return joined.select(*rows.columns, *((F.col(f"_own_{s}") + F.col(f"_before_{s}")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))

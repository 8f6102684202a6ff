"""Running sums over all rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from searchlab.sources.staging import stage


def earlier_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_before``: the sum of ``value`` over all rows that come earlier.

    ``order`` is total. Rows are range-sorted into parts and written with the number of
    their part; a row's sum is that of all earlier parts and of the rows before it in its own. Only the parts'
    totals, one row for each part, come to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "range_parts")
    offsets, upto = [], [0] * len(values)
    for total in rows.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)).orderBy("_part").collect():
        offsets.append((total["_part"], *upto))
        upto = [a + total[v] for a, v in zip(upto, values)]
    names = [f"{v}_before" for v in values]
    schema = "_part int, " + ", ".join(f"{n} long" for n in names)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = {f"_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}
    found = rows.withColumns(here).join(F.broadcast(df.sparkSession.createDataFrame(offsets, schema)), "_part")
    return found.withColumns({n: F.col(n) + F.col(f"_{v}") for n, v in zip(names, values)}).drop("_part", *here)

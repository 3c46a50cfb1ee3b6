"""Row numbers within groups, without putting a whole group in one task.

``row_number() over (partition by g order by k)`` sends every row of a group to one task; with
a handful of languages and one of them holding most rows, that task holds most of the data.
One plan serves every size:

1. ``buckets - 1`` quantiles of the order key (one mergeable aggregate, a few numbers on the
   driver, however many rows there are) cut the key into buckets of about equal size;
2. ``row_number() over (partition by g, bucket order by k)`` numbers rows inside a bucket;
3. ``count(*)`` per ``(g, bucket)`` and a running sum over that small table give each bucket's
   offset, which is joined back (adaptive execution picks the join: the table has at most
   groups × buckets rows).

``buckets`` defaults to ``spark.sql.shuffle.partitions``, the parallelism the cluster was sized
for. The order key must be numeric; rows with a null key come first, as in the plain window. Rows
with equal keys share a bucket and are numbered in any order, as in the plain window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_within_groups(df: DataFrame, group: str, order: str, out: str = "rn",
                         buckets: int | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, ... within each ``group`` by ``order``."""
    if not isinstance(df.schema[order].dataType, T.NumericType):
        raise TypeError(f"the order key must be numeric; {order} is {df.schema[order].dataType.simpleString()}")
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__key_d", F.col(order).cast("double"))
    fracs = [i / buckets for i in range(1, buckets)]
    cuts = keyed.select(F.percentile_approx("__key_d", fracs, max(10_000, 4 * buckets))).first()[0] if fracs else None
    # Equal boundaries fall together; without a boundary (no numeric key, one bucket) zero stands in.
    cuts = sorted(set(cuts or [0.0]))
    from pyspark.ml.feature import Bucketizer  # JVM-side binary search over the boundaries

    bucketed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__key_d", outputCol="__bucket",
                          handleInvalid="keep").transform(keyed).drop("__key_d")
    # A null key has a null bucket, which sorts first.
    local = bucketed.withColumn(
        "__local", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order)))
    counts = bucketed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # Null-safe on both keys: a null group or a null order key must keep its rows.
    cond = local[group].eqNullSafe(offsets["__g"]) & local["__bucket"].eqNullSafe(offsets["__b"])
    return (local.join(offsets, cond, "inner")
            .withColumn(out, (F.col("__offset") + F.col("__local")).cast("long"))
            .drop("__g", "__b", "__offset", "__local", "__bucket"))

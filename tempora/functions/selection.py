"""Exact percentiles of groups of any size: a histogram of the range that holds the wanted rank, refined round by round.

Spark's own `percentile` keeps the distinct values of a group in one task. Here a group's rows meet as bin counts with the least and largest value
in each bin, which partial aggregation bounds by BINS a task and group; the bin of the wanted rank is the next round's range. Once a range holds a
single value, or few rows (SMALL), the value is read off. Each round reads the rows once, so these should be a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.sources.tables import stored

BINS, SMALL = 4096, 1000


def _refined(rows: DataFrame, open_: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The targets (keys, rank, below, lo, hi, held) with the range of the bin that holds the rank."""
    inside = rows.join(open_.select(*keys, "rank", "lo", "hi"), keys).where("_v BETWEEN lo AND hi")
    # Each step of this is monotone, also in floating point; halves keep the widest ranges finite.
    part = lambda by: F.try_divide(F.col("_v") / by - F.col("lo") / by, F.col("hi") / by - F.col("lo") / by)
    share = F.when(F.greatest(F.abs("lo"), F.abs("hi")) < 1e307, part(1)).otherwise(part(2))
    binned = inside.withColumn("bin", F.least(F.lit(bins - 1), F.floor(share * bins))).groupBy(*keys, "rank", "bin").agg(F.count("*").alias("held"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    before = F.sum("held").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    found = binned.withColumn("before", F.coalesce(before, F.lit(0))).join(open_.select(*keys, "rank", "below"), [*keys, "rank"])
    return found.where("rank - below >= before AND rank - below < before + held").select(*keys, "rank", (F.col("below") + F.col("before")).alias("below"), "lo", "hi", "held")


def percentiles(df: DataFrame, keys: tuple[str, ...], column: str, shares: dict[str, float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """keys and a column for each share (0 to 1): the percentile of the column's numbers with linear interpolation. Nulls don't count; a group without numbers has no row."""
    keys = list(keys)
    rows = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*(r.cast("long") for p in shares.values() for r in (F.floor(place(p)), F.ceil(place(p))))))
    targets = groups.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", F.col("n").alias("held"))
    done = []
    while True:
        targets = stored(targets)
        done.append(targets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        few = targets.where(f"lo < hi AND held <= {small}")
        listed = rows.join(few, keys).where("_v BETWEEN lo AND hi").groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list("_v")).alias("all"))
        done.append(listed.select(*keys, "rank", F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
        open_ = targets.where(f"lo < hi AND held > {small}")
        if open_.isEmpty():
            break
        targets = _refined(rows, open_, keys, bins)
    each = reduce(DataFrame.unionByName, done)
    known = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).join(groups.select(*keys, "n"), keys)

    def between(p: float):
        low, high = F.col("at")[F.floor(place(p))], F.col("at")[F.ceil(place(p))]
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return known.select(*keys, *(between(p).alias(name) for name, p in shares.items()))

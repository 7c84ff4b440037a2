"""Exact quantiles per group without gathering, sorting or shuffling a group's values.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a histogram of bounded size finds the range of values that holds a
wanted rank, and the next one divides that range alone, until it holds a single
value or few enough rows to be put in order. Buckets follow the sign, exponent
and fraction of a number, as a radix sort of its bits would, so that one far
value does not push all others into one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ridelake.session import ensure_checkpoint_dir

#: Buckets of a range.
BUCKETS = 65_536
#: Rows of a range that are put in order by one task.
BOUNDED = 1_000_000
#: Ranges that may be broadcast to the rows.
BROADCAST_RANGES = 100_000

# Exponents of a double, and what makes each of them positive.
_MOST, _ABOVE = 1023, 1100


def _values(df: DataFrame, by: str, x: str) -> DataFrame:
    """(grp, x); null and NaN are left out.

    NaN becomes null first: a filter is pushed down to where ``x`` is derived
    and derives it again for each time it names it.
    """
    value = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    return df.select(F.col(by).alias("grp"), value.alias("x")).filter(F.col("x").isNotNull())


def ordinal(x: Column) -> Column:
    """A number that grows with ``x`` evenly over its sign, exponent and fraction.

    It is the binary logarithm made of straight pieces. Where the logarithm is
    rounded up to the next exponent the next piece is extended downwards, so
    the order stays.
    """
    size = F.abs(x)
    exponent = F.least(F.floor(F.log2(size)), F.lit(_MOST)).cast("double")
    scale = exponent + size / F.pow(F.lit(2.0), exponent) - F.lit(1.0) + F.lit(float(_ABOVE))
    return F.when(x == 0, F.lit(0.0)).when(size == F.lit(math.inf), F.signum(x) * 2 * _ABOVE).otherwise(F.signum(x) * scale)


def _position(p: float, total: Column) -> Column:
    return F.lit(float(p)) * (total - F.lit(1))


def _bucket(low: Column, high: Column) -> Column:
    span = high - low
    place = F.least(F.lit(BUCKETS - 1), F.floor((ordinal(F.col("x")) - low) / span * F.lit(BUCKETS)))
    return F.when(span > 0, place).otherwise(F.lit(0))


def _counted(buckets: GroupedData) -> DataFrame:
    return buckets.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _upto(*keys: str) -> Column:
    """Rows up to and with a bucket; at most BUCKETS of them meet in a task."""
    window = Window.partitionBy(*keys).orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("n").over(window)


def _holding(wanted: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks with the bucket that holds each; ``buckets`` has ``upto``."""
    inside = wanted.join(buckets, keys).filter(
        (F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n"))
    )
    below = F.col("below") + F.col("upto") - F.col("n")
    return inside.select("grp", "rank", "total", below.alias("below"), "n", "lo", "hi")


def ranges(rows: DataFrame, probs: Mapping[str, float]) -> tuple[DataFrame, int]:
    """(grp, rank, total, below, n, lo, hi): for every rank that ``probs`` needs, the range ``lo`` to ``hi`` that holds it.

    The range has ``n`` rows, at most BOUNDED or all of one ordinal, and ``below`` rows come before it. Also
    returns how many ranges have more than one value.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    ends = F.lit(-2.0 * _ABOVE), F.lit(2.0 * _ABOVE)
    first = _counted(rows.groupBy("grp", _bucket(*ends).alias("bucket")))
    first = first.withColumn("upto", _upto("grp")).checkpoint()
    totals = first.groupBy("grp").agg(F.sum("n").alias("total"))
    ranks = F.array_distinct(
        F.array(*[f(_position(p, F.col("total"))).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)])
    )
    wanted = totals.select("grp", F.explode(ranks).alias("rank"), "total", F.lit(0).cast("bigint").alias("below"))
    found = _holding(wanted, first, ["grp"])
    wide = (F.col("n") > BOUNDED) & (ordinal(F.col("lo")) < ordinal(F.col("hi")))
    left = [F.count_if(wide).alias("wide"), F.count_if(F.col("lo") < F.col("hi")).alias("several")]
    while (open_ := found.agg(*left).first()) and (n := open_["wide"]):
        # Each pass ends: the smallest and the largest value of a range are in different buckets.
        spans = found.filter(wide).select("grp", F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        spans = spans.withColumns({"olo": ordinal(F.col("from")), "ohi": ordinal(F.col("to"))})
        spans = F.broadcast(spans) if n <= BROADCAST_RANGES else spans
        inside = rows.join(spans, "grp").filter(F.col("x").between(F.col("from"), F.col("to")))
        buckets = _counted(inside.groupBy("grp", "from", "to", _bucket(F.col("olo"), F.col("ohi")).alias("bucket")))
        buckets = buckets.withColumn("upto", _upto("grp", "from", "to"))
        again = found.filter(wide).select("grp", "rank", "total", "below", F.col("lo").alias("from"), F.col("hi").alias("to"))
        found = found.filter(~wide).unionByName(_holding(again, buckets, ["grp", "from", "to"])).checkpoint()
    return found, open_["several"]


def _at_ranks(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(grp, rank, total, x): the value at each rank. Only the ``n`` ranges of more than one value are put in order."""
    single = F.col("lo") == F.col("hi")
    several = found.filter(~single).select("grp", "rank", "total", "below", F.col("lo").alias("from"), F.col("hi").alias("to"))
    done = found.filter(single).select("grp", "rank", "total", F.col("lo").alias("x"))
    if not n:
        return done
    spans = several.select("grp", "from", "to").distinct()
    spans = F.broadcast(spans) if n <= BROADCAST_RANGES else spans
    inside = rows.join(spans, "grp").filter(F.col("x").between(F.col("from"), F.col("to")))
    counts = inside.groupBy("grp", "from", "to", F.col("x").alias("lo")).agg(F.count(F.lit(1)).alias("n")).withColumn("hi", F.col("lo"))
    counts = counts.withColumn("upto", _upto("grp", "from", "to"))
    return done.unionByName(_holding(several, counts, ["grp", "from", "to"]).select("grp", "rank", "total", F.col("lo").alias("x")))


def _quantiles(rows: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """(grp, one column per entry of ``probs``): linear interpolation between ranks."""
    found = _at_ranks(rows, *ranges(rows, probs))
    bounds = []
    for name, p in probs.items():
        position = _position(p, F.col("total"))
        bounds += [
            F.max(F.when(F.col("rank") == F.floor(position), F.col("x"))).alias(f"{name}_lo"),
            F.max(F.when(F.col("rank") == F.ceil(position), F.col("x"))).alias(f"{name}_hi"),
        ]
    rows = found.groupBy("grp", "total").agg(*bounds)
    return rows.select(
        "grp",
        *[
            (
                F.col(f"{name}_lo")
                + (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
                * (_position(p, F.col("total")) - F.floor(_position(p, F.col("total"))))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def quantiles_by(df: DataFrame, by: str, x: str, probs: Mapping[str, float]) -> DataFrame:
    """``by`` and one column per entry of ``probs``; exact, by linear interpolation between ranks.

    Runs jobs over ``df``: usually two histograms, as many more as ranges of over BOUNDED rows need.
    """
    if not all(0 <= p <= 1 and math.isfinite(p) for p in probs.values()):
        raise ValueError("probabilities lie between 0 and 1")
    return _quantiles(_values(df, by, x), probs).withColumnRenamed("grp", by)


def median_by(df: DataFrame, by: str, x: str) -> DataFrame:
    """Median of ``x`` per group, in ascending order of the median."""
    return quantiles_by(df.filter(F.col(by).isNotNull()), by, x, {f"median_{x}": 0.5}).orderBy(f"median_{x}", by)


def boxplot_by(df: DataFrame, by: str, x: str) -> DataFrame:
    """Box-plot figures per group: quartiles, whiskers and number of outliers.

    A whisker ends at the most extreme value inside 1.5 interquartile ranges.
    """
    rows = _values(df.filter(F.col(by).isNotNull()), by, x)
    boxes = _quantiles(rows, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    low, high = F.col("x") < F.col("q1") - reach, F.col("x") > F.col("q3") + reach
    return (
        rows.join(boxes, "grp")
        .groupBy("grp", "q1", "median", "q3")
        .agg(
            F.min(F.when(~low, F.col("x"))).alias("whisker_low"),
            F.max(F.when(~high, F.col("x"))).alias("whisker_high"),
            F.sum(F.when(low | high, F.lit(1)).otherwise(F.lit(0))).alias("outliers"),
        )
        .withColumnRenamed("grp", by)
    )

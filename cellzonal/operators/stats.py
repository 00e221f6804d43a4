"""Normalisation, profiles and small summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cellzonal.functions import geometry as geo
from cellzonal.session import kept


def linear_normalise(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    """``value = x / max(x)`` over the whole result.

    The maximum is a scalar subquery, which reuses the shuffle already made for
    ``df``; a window without partitions would move every row to one task.
    """
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(value, F.try_divide(F.col(column), top))


def log_normalise(df: DataFrame, count: str = "n") -> DataFrame:
    """``logn = ln(n)``, ``value = logn / max(logn)``; null when all n are 1."""
    return linear_normalise(df.withColumn("logn", F.ln(F.col(count))), "logn")


def missing_profile(df: DataFrame, column: str) -> DataFrame:
    """How many rows lack a value and how many have one."""
    return df.groupBy(F.col(column).isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row table (A4)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def bounds(features: DataFrame, geometry: str = "geometry", by: Sequence[str] = ()) -> DataFrame:
    """Extent of all features, or per group."""
    extents = features.select(*by, geo.bounds_of(F.col(geometry)).alias("_b"))
    return extents.groupBy(*by).agg(
        F.min("_b.xmin").alias("xmin"),
        F.min("_b.ymin").alias("ymin"),
        F.max("_b.xmax").alias("xmax"),
        F.max("_b.ymax").alias("ymax"),
    )


def latency_summary(
    calls: DataFrame, by: str, seconds: Column, ok: Column
) -> DataFrame:
    """Calls, successes, success share and time of the successful calls per group."""
    timed = F.when(ok, seconds)
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("success_pct"),
        F.avg(timed).alias("mean_seconds"),
        F.coalesce(F.stddev_samp(timed), F.lit(0.0)).alias("sd_seconds"),
    )


def _ordered_key(value: Column, kind: T.DataType) -> Column:
    """A BIGINT, double or decimal that has the order of the values and tells them all apart."""
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.cast("double")
    if isinstance(kind, T.DecimalType):
        return value
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(value.cast("date")).cast("long") * 1440 + F.hour(value) * 60 + F.minute(value)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
    if isinstance(kind, T.DayTimeIntervalType):
        return value.cast("interval second").cast("decimal(20,6)")
    if isinstance(kind, T.YearMonthIntervalType):
        return value.cast("interval month").cast("long")
    raise TypeError(f"no percentile of {kind.simpleString()}")


def _magnitude(key: Column) -> Column:
    """Which power of two a double is near: some 4200 classes in the order of the values.

    A logarithm that rounds across a power of two still keeps the order.
    """
    size = F.least(F.floor(F.log2(F.abs(key))), F.lit(1030)) + 2000
    classes = F.when(key > 0, size).when(key < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(key), F.lit(4000)).otherwise(classes).cast("long")


def _evenly(window: int) -> Callable[[Column], Column]:
    """Equal parts of the bracket of a group; within a class of doubles differences are exact."""
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    width = F.greatest((high - low) / window, F.lit(5e-324))
    return lambda key: F.floor((key - low) / width)


def _steps(low: object, high: object, window: int) -> Iterator[Callable[[Column], Column]]:
    """Ever finer parts of the keys between two bounds, in their order.

    Each tells what the one before left together apart into at most ``window`` parts, but at
    least two or ten: bits fall off whole numbers, digits off decimals.
    """
    if isinstance(low, float):
        yield _magnitude
        while True:
            yield _evenly(window)
    if isinstance(low, int):
        bits = max(1, window.bit_length() - 1)
        first = 0
        while (high >> first) - (low >> first) >= 1 << bits:
            first += bits
        for shift in range(first, -1, -bits):
            yield lambda key, shift=shift: F.shiftright(key, shift)
        return
    digits = max(1, len(str(window)) - 1)
    places = max(0, -low.as_tuple().exponent, -high.as_tuple().exponent)
    whole = max(len(str(abs(int(v)))) for v in (low, high))
    for place in range(digits - whole, places, digits):
        # Towards zero: no digit is added, so the largest decimals fit as well.
        at = F.lit(place)
        yield lambda key, at=at: F.when(key < 0, F.ceil(key, at)).otherwise(F.floor(key, at))
    yield lambda key: key


def _within(values: DataFrame, chosen: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values inside the bracket chosen for their group, once for each share."""
    if names:
        meets = [F.col(g).eqNullSafe(F.col(f"{g}s")) for g in names]
        here = chosen.withColumnsRenamed({g: f"{g}s" for g in names})
        meets.append(F.col("_v").between(F.col("_low"), F.col("_high")))
        return values.join(here, reduce(and_, meets))
    # Without groups there is a row per share, which needs no join: the bounds reach the scan.
    kinds, found = dict(chosen.dtypes), []
    for row in chosen.collect():
        given = {c: F.lit(row[c]).cast(kinds[c]) for c in chosen.columns}
        inside = F.col("_v").between(given["_low"], given["_high"])
        found.append(values.where(inside).withColumns(given))
    return reduce(DataFrame.unionAll, found)


def exact_percentiles(
    df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), window: int = 4096
) -> DataFrame:
    """Exact percentiles of every group: ``by, share, value, n``.

    ``value`` is the smallest one with at least ``share`` of the group's ``n`` non-null
    values at or below it. Each pass counts the values of a bracket by parts, a few thousand
    (``window``) of a group, share and task; only counts are shuffled, and the part that holds
    the wanted rank is the next bracket. The width of the type bounds the passes; they end
    when every bracket is one value. A group with a third of all rows is counted by all tasks.
    Null is a group of its own; one without values gives no row. NaN is above all numbers, and
    both zeros are one value. Brackets are kept in the shared folder, a row per group and
    share; Spark broadcasts them where they are small.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.YearMonthIntervalType):
        # Python has no such values, so whole months stand for them.
        months = df.withColumn(column, _ordered_key(F.col(column), kind))
        found = exact_percentiles(months, column, shares, by, window)
        return found.withColumn("value", F.make_ym_interval(F.lit(0), F.col("value").cast("int")).cast(kind))
    names = [f"_g{i}" for i in range(len(by))]
    values = df.select(
        *[F.col(c).alias(g) for c, g in zip(by, names)],
        F.col(column).alias("_v"),
        _ordered_key(F.col(column), kind).alias("_k"),
    ).where(F.col("_v").isNotNull())
    wanted = F.explode(F.array(*[F.lit(Decimal(str(s))).cast("decimal(19,18)") for s in shares]))
    rank = F.ceil(F.col("_share") * F.col("_n").cast("decimal(18,0)")).cast("long")
    sizes = values.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    chosen = kept(
        sizes.where(F.col("_n") > 0)
        .withColumn("_share", wanted)
        .withColumn("_rank", F.greatest(rank, F.lit(1)))
    )
    keys = [_ordered_key(F.col(c), kind) for c in ("_low", "_high")]
    open_ = F.count_if(F.col("_low") < F.col("_high")).alias("open")
    left, low, high = chosen.agg(open_, F.min(keys[0]), F.max(keys[1])).first()
    steps = _steps(low, high, window)
    while left:
        step = next(steps)
        counts = (
            _within(values, chosen, names)
            .groupBy(*names, "_share", "_rank", "_n", step(F.col("_k")).alias("_p"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        upto = F.sum("_c").over(Window.partitionBy(*names, "_share").orderBy("_p"))
        rest = F.col("_rank") - F.col("_upto") + F.col("_c")
        chosen = kept(
            counts.withColumn("_upto", upto)
            .where(rest.between(F.lit(1), F.col("_c")))
            .select(*names, "_n", "_low", "_high", "_share", rest.alias("_rank"))
        )
        left = chosen.agg(open_).first()["open"]
    return chosen.select(
        *[F.col(g).alias(c) for c, g in zip(by, names)],
        F.col("_share").cast("double").alias("share"),
        F.col("_low").alias("value"),
        F.col("_n").alias("n"),
    )


def exact_percentile(df: DataFrame, column: str, share: float, window: int = 4096):
    """Smallest value with at least ``share`` of the non-null values at or below it, or None.

    The value keeps its type, and ``window`` bounds the counts of one pass (F12).
    """
    found = exact_percentiles(df, column, [share], window=window).first()
    return found["value"] if found else None


def above_percentile(df: DataFrame, column: str, share: float) -> DataFrame:
    """Rows whose value exceeds the given percentile of the column."""
    threshold = exact_percentile(df, column, share)
    return df.where(F.col(column) > F.lit(threshold))


def most_common(counts: DataFrame, k: int, count: str = "n", tie: str = "taxonkey") -> DataFrame:
    """The ``k`` largest counts, ties by key (O3)."""
    return counts.orderBy(F.desc(count), F.asc(tie)).limit(k)

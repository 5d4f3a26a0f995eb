"""Specification limits valid per test and period, and X3: histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.operators.profile import melt_features
from speclab.operators.quantiles import value_counts_by

BUCKET_DAYS = 32             # width of the buckets that rows and periods meet in
OPEN_END = "9999-12-31"


def disjoint_limits(limits: DataFrame, test: str = "test") -> DataFrame:
    """``(test, valid_from, valid_to, target, low, high)`` with overlaps settled: periods of one test that share no day.

    ``limits`` holds dates ``valid_from`` (null: from the beginning) and ``valid_to`` (not included; null: for good). Where
    periods overlap, the one that begins last counts (ties: that ends first, then the smaller target, low, high);
    empty periods and null tests are dropped. The limits of one test are held together: they are a
    test's revisions, not its results.
    """
    p = limits.select(F.col(test).alias("test"), F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("valid_from"),
                      F.coalesce("valid_to", F.lit(OPEN_END).cast("date")).alias("valid_to"), F.col("target").cast("double").alias("target"),
                      F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    p = p.where("test is not null and valid_from < valid_to")
    held = p.groupBy("test").agg(F.collect_list(F.struct("valid_from", "valid_to", "target", "low", "high")).alias("all"))
    held = held.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.col("all.valid_from"), F.col("all.valid_to")))))
    spans = held.select("test", "all", F.explode(F.expr("transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> named_struct('a', c, 'b', cuts[i + 1]))")).alias("s"))
    # of the periods that cover a span, the one that begins last: order by turned begin, then end and values
    won = F.expr("array_min(transform(filter(all, x -> x.valid_from <= s.a and x.valid_to >= s.b), x -> "
                 "named_struct('o', -datediff(x.valid_from, date'0001-01-01'), 'e', x.valid_to, 't', x.target, 'l', x.low, 'h', x.high)))")
    return (spans.select("test", F.col("s.a").alias("valid_from"), F.col("s.b").alias("valid_to"), won.alias("w")).where("w is not null")
            .select("test", "valid_from", "valid_to", F.col("w.t").alias("target"), F.col("w.l").alias("low"), F.col("w.h").alias("high")))


def spec_limits(df: DataFrame, limits: DataFrame, test: str, day: str, value: str) -> DataFrame:
    """``df`` and five columns: ``target``, ``low``, ``high``, ``in_spec``, ``off_target``.

    A row takes the limits of its test valid on its day (see ``disjoint_limits``); without any, or without test, day
    or value, ``in_spec`` is null. ``in_spec``: low <= value <= high (a null bound does not limit). Periods are spread
    over the day buckets they cross, so rows and periods meet by an equality of test and bucket, never in a nested
    loop; a row meets at most one period, so its multiplicity stays.
    """
    new = ["target", "low", "high", "in_spec", "off_target"]
    spans = disjoint_limits(limits)
    number = lambda d: F.floor(F.datediff(d, F.lit("0001-01-01").cast("date")) / BUCKET_DAYS)
    # only buckets that hold rows: an open period need not be spread to the end of time
    reach = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).first()
    spans = spans.withColumn("a", F.lit(reach["a"]).cast("date")).withColumn("b", F.lit(reach["b"]).cast("date")).where("valid_from <= b and valid_to > a")
    spans = spans.select(F.col("test").alias("_t"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("target").alias("_target"),
                         F.col("low").alias("_low"), F.col("high").alias("_high"),
                         F.explode(F.sequence(number(F.greatest("valid_from", "a")), number(F.least(F.date_sub("valid_to", 1), F.col("b"))))).alias("_bucket"))
    on_day = F.col(day).cast("date")
    kept = [c for c in df.columns if c not in new]
    out = df.join(spans, (F.col(test) == F.col("_t")) & (number(on_day) == F.col("_bucket")) & (on_day >= F.col("_from")) & (on_day < F.col("_to")), "left")
    v = F.col(value).cast("string").try_cast("double")
    within = (v >= F.coalesce("_low", v)) & (v <= F.coalesce("_high", v))
    return out.select(*[F.col(c) for c in kept], F.col("_target").alias("target"), F.col("_low").alias("low"), F.col("_high").alias("high"),
                      F.when(F.col("_t").isNotNull(), within).alias("in_spec"), (v - F.col("_target")).alias("off_target"))


def histogram(df: DataFrame | None, variables: Sequence[str], bins: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """``(variable, bin, lower, upper, n)``: equal-width bins from the least to the greatest reading, empty bins included.

    The last bin includes its upper end; a variable with one value gets bins around it, half a unit to each side. Missing and
    non-numeric readings do not count; a variable without any has no rows. Derived from value counts (``counts``, or made
    here in one pass); the grid of bins is variables x bins rows.
    """
    vc = counts.groupBy("variable", "value").agg(F.sum("cnt").alias("cnt")) if counts is not None else \
        value_counts_by(melt_features(df, [], variables), ["variable"], "value")
    ends = vc.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    ends = ends.select("variable", F.when(one, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"), F.when(one, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"))
    filled = vc.join(ends, "variable").groupBy("variable", at.alias("bin")).agg(F.sum("cnt").alias("n"))
    grid = ends.select("variable", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(filled, ["variable", "bin"], "left")
            .select("variable", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))

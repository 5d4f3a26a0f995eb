"""Missing readings from fitted statistics.

The statistics (exact medians, by group and overall) are fitted on one split, kept as a table, and applied to every
split, so nothing of the held-out rows enters them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.operators.profile import melt_features
from speclab.operators.quantiles import exact_quantiles

OVERALL = "overall"


def fit_medians(df: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """``(level, group_value, variable, value)``: the median of every feature overall and, if asked, in each group (as text).

    Null and NaN readings do not count; a feature without any reading has no row. Rows of the null group count as a group.
    """
    out = exact_quantiles(melt_features(df, [], features), ["variable"], "value", [0.5]).select(
        F.lit(OVERALL).alias("level"), F.lit(None).cast("string").alias("group_value"), "variable", F.col("quantile").alias("value"))
    if group is None:
        return out
    # the quantiles join on their keys, so the null group gets a text of its own
    named = df.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
    own = exact_quantiles(melt_features(named, ["_group"], features), ["_group", "variable"], "value", [0.5]).select(
        F.lit("group").alias("level"), F.when(F.col("_group") != "null", F.expr("substring(_group, 2)")).alias("group_value"), "variable",
        F.col("quantile").alias("value"))
    return out.unionByName(own)


def impute_missing(df: DataFrame, medians: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """``df`` with missing (null, NaN, not numeric) readings of ``features`` replaced: by the median of the row's group, else overall.

    The features become doubles; a feature without any fitted median stays missing. The overall medians reach the
    driver (one number a feature), those of groups are joined on the group.
    """
    feats = list(features)
    overall = {r["variable"]: r["value"] for r in medians.where(F.col("level") == OVERALL).collect()}
    kept = df.columns
    if group is not None:
        own = "_m"
        while any(c.startswith(own) for c in kept):      # names the input does not use
            own = "_" + own
        slim = medians.where(F.col("level") == "group").groupBy(F.col("group_value").alias(own)).agg(
            *[F.max(F.when(F.col("variable") == f, F.col("value"))).alias(f"{own}{i}") for i, f in enumerate(feats)])
        df = df.join(slim, F.col(group).cast("string").eqNullSafe(F.col(own)), "left")
    out = []
    for c in kept:
        if c in feats:
            v = F.col(c).cast("string").try_cast("double")
            fill = [F.col(f"{own}{feats.index(c)}")] if group is not None else []
            out.append(F.coalesce(F.when(~F.isnan(v), v), *fill, F.lit(overall.get(c)).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)

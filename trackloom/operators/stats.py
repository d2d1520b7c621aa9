"""Exact quantiles of groups of any size, selected by all tasks together: no task sorts or holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Groups of at most so many values are ranked as they are; of larger ones only what lies between two bounds around each quantile.
SMALL = 10_000
#: The sketch's accuracy, and the share of a group by which the bounds lie aside: twice the sketch's error, and two values of the smallest group.
ACCURACY = 10_000
ASIDE = 2 / ACCURACY + 2 / SMALL


def quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """(keys, one column a value and share, named value_share) interpolated between ranks; null where a group has no value.

    Nulls and NaN don't count; nulls among keys are equal. A group's values are selected by all tasks: a sketch, merged from all partitions, gives bounds that the quantile lies
    between; values below are counted, those between the bounds counted by value, before anything is shuffled. Only the few distinct values there, at most 2 * ASIDE of a
    group, are ordered in one place. The result is exact: the bounds are farther apart than the sketch's error.
    """
    on = [*keys, "__of"]
    rows = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("__of"), c.cast("double").alias("__v")) for name, c in values.items()])))
    real = rows.where("__v IS NOT NULL AND NOT isnan(__v)")
    near = [F.percentile_approx("__v", [max(q - ASIDE, 0.0), min(q + ASIDE, 1.0)], ACCURACY).alias(f"__b{i}") for i, q in enumerate(shares.values())]
    groups = real.groupBy(*on).agg(F.count("*").alias("__n"), *near)
    whole = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    per = F.array(*[
        F.struct(F.lit(name).alias("__s"), (F.lit(q) * (F.col("__n") - 1)).alias("__p"), F.when(F.col("__n") <= SMALL, whole).otherwise(F.col(f"__b{i}")).alias("__b"))
        for i, (name, q) in enumerate(shares.items())])
    bounds = groups.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.inline(per))
    met = real.join(bounds, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)]).where(F.col("__v") <= F.col("__b")[1])
    value = F.when(F.col("__v") >= F.col("__b")[0], F.col("__v"))  # null: below
    counted = met.groupBy(*on, "__s", "__p", value.alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*on, "__s").orderBy(F.asc_nulls_first("__v")).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("__u", upto)
    low, high = (F.min(F.when(F.col("__u") > end, F.col("__v"))) for end in (F.floor("__p"), F.ceil("__p")))
    found = ranked.groupBy(*on, "__s", "__p").agg(low.alias("__low"), high.alias("__high"))
    found = found.withColumn("__q", F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__p") - F.floor("__p"))))
    return found.groupBy(*keys).agg(*[F.max(F.when((F.col("__of") == name) & (F.col("__s") == s), F.col("__q"))).alias(f"{name}_{s}") for name in values for s in shares])


def joined(groups: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with their quantiles; nulls among keys are equal."""
    own = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return groups.join(own, on, "left").drop(*[f"__{k}" for k in keys])

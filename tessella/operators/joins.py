"""Joins beyond a plain equi-join: overlays, tiers of keys, placeholders, precedence, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import first_by


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with columns updated from over where it has the key, and thin rows for keys of over alone."""
    o = over.select(key, *[F.col(c).alias(f"over_{c}") for c in columns])
    out = base.withColumn("in_base", F.lit(True)).join(o, key, "full_outer")
    cols = [F.coalesce(f"over_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns if c != key]
    return out.select(key, *cols, F.col("in_base").isNull().alias("thin"))


def sidecar(raw: DataFrame, side: DataFrame, key: str, column: str, seq: str) -> DataFrame:
    """raw with a column replaced by the side table's (its last row of a key) where that is longer, and how it went."""
    from .merge import last_by

    s = last_by(side.select(key, seq, F.col(column).alias("side_value")), [key], [F.col(seq)]).select(key, "side_value", F.lit(True).alias("hit"))
    longer = F.length(F.coalesce("side_value", F.lit(""))) > F.length(F.coalesce(F.col(column), F.lit("")))
    out = raw.join(s, key, "left").withColumn("outcome", F.when(F.col("hit").isNull(), "unmatched").when(longer, "replaced").otherwise("kept"))
    return out.withColumn(column, F.when(longer, F.col("side_value")).otherwise(F.col(column))).drop("side_value", "hit")


def tiers(left: DataFrame, right: DataFrame, rules: list[tuple[Column, Column]], seq: str, value: str) -> DataFrame:
    """left with the value of the first rule whose keys meet, and the rule's number from 1; null without any.

    rules: key expressions of either side. Among right rows of one key the first in seq counts.
    """
    out = left
    for i, (a, b) in enumerate(rules):
        keyed = first_by(right.select(b.alias(f"k{i}"), F.col(seq), F.col(value).alias(f"v{i}")).where(F.col(f"k{i}").isNotNull()), [f"k{i}"], [F.col(seq)]).drop(seq)
        out = out.withColumn(f"a{i}", a).join(keyed, F.col(f"a{i}") == F.col(f"k{i}"), "left").drop(f"a{i}")
    hit = [F.when(F.col(f"k{i}").isNotNull(), i + 1) for i in range(len(rules))]
    out = out.withColumn("tier", F.coalesce(*hit)).withColumn(value, F.coalesce(*[F.col(f"v{i}") for i in range(len(rules))]))
    return out.drop(*[f"{p}{i}" for p in "kv" for i in range(len(rules))])


def placeholders(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(key), key, "left_anti")


def precedence(sources: list[DataFrame], key: list[str], seq: str) -> DataFrame:
    """Union in which, of rows with one key, the earliest source's first row stays."""
    tagged = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return first_by(reduce(DataFrame.unionByName, tagged), key, [F.col("source_rank"), F.col(seq)])


def flagged(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with whether right has the key."""
    return left.join(right.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))

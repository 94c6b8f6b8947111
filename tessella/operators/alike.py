"""Texts with near-identical spelling, by an exact bound of Ratcliff-Obershelp's ratio instead of all pairs.

A ratio of r between texts of together T characters takes M >= r * T / 2 characters in blocks that stand in both in the same
order. Between blocks at least one character is unmatched, so there are at most k = T - 2 * M + 1 blocks, and they hold
M - k * (q - 1) stretches of q characters (grams) in common. So of a text's grams, rarest first, one of those beyond
that number less one stands in the other text as well, at a place that differs by the unmatched characters at most. Pairs meet
at such a gram, in cells of one length each, and only what has as many grams in common is measured.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread
from .entity import ratio

#: Lengths for which bounds are tabled; beyond them they grow with the length.
LENGTHS = 400


def matched(total: int, least: float) -> int:
    return math.ceil(least * total / 2 - 1e-9)


def common_grams(a: int, b: int, q: int, least: float) -> int | None:
    """Grams that two different texts of these lengths have in common at least; None if they cannot reach the ratio."""
    m = matched(a + b, least)
    if m > min(a, b) or 2 * m == a + b:
        return None
    return m - (a + b - 2 * m + 1) * (q - 1)


@cache
def gram_size(least: float) -> int:
    """The largest gram of up to three characters of which any two different texts of that ratio have one in common."""
    for q in (3, 2):
        slope = least / (2 - least) - (1 - least) / (1 - least / 2) * (q - 1)  # of the bound by the longer text's length
        if slope > 0 and all((n := common_grams(a, b, q, least)) is None or n >= 1 for a in range(1, LENGTHS) for b in range(1, a + 1)):
            return q
    return 1


def _least_common(size: Column, q: int, least: float) -> Column:
    """The least number of common grams over all lengths that the other text may have; past any text's grams if there is none."""
    share = least / (2 - least)
    table = []
    for a in range(1, LENGTHS):
        bounds = [common_grams(a, b, q, least) for b in range(math.ceil(share * a - 1e-9), math.floor(a / share + 1e-9) + 1)]
        table.append(min((n for n in bounds if n is not None), default=2 * LENGTHS))
    other = F.ceil(share * size - 1e-9)
    m = F.ceil(least * (size + other) / 2 - 1e-9)
    # beyond the table: rounding moves the bound by a gram for each of two blocks that may come or go
    grown = F.greatest(m - (size + other - 2 * m + 1) * (q - 1) - 2 * q, F.lit(1)).cast("int")
    return F.when(size < LENGTHS, F.get(F.array(*map(F.lit, table)), size - 1)).otherwise(grown)


def _plain(df: DataFrame, owner: str, text: str) -> DataFrame:
    return df.select(F.col(owner).alias("o"), F.col(text).alias("t")).where("o is not null and t <> ''").distinct()


def _scoped(own: DataFrame) -> DataFrame:
    """own (o, t) with the scope in which texts meet: their owner, or one for all where owners share so many texts that all
    distinct texts make fewer pairs than the owners' texts do. Owners that share a hash share a scope, which costs pairs alone."""
    sizes = own.groupBy("o").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    once = sizes.crossJoin(own.select("t").distinct().agg(F.count("*").cast("double").alias("n"))).select((F.col("n") * F.col("n") < F.col("apart")).alias("once"))
    return own.crossJoin(F.broadcast(once)).select("o", "t", F.when(F.col("once"), F.lit(0)).otherwise(F.xxhash64("o")).alias("scope"))


def pairs(texts: DataFrame, owner: str, text: str, least: float) -> DataFrame:
    """owner, a, b, forward, back: pairs a < b of different texts of one owner of which a ratio reaches least. forward is the
    ratio of b against a, back that of a against b. Null and empty texts are like nothing; a null owner owns nothing."""
    own = _scoped(_plain(texts, owner, text))
    found = spread(met(own, "scope", "t", least), "a", "b").select("scope", "a", "b", ratio(F.col("b"), F.col("a")).alias("forward"), ratio(F.col("a"), F.col("b")).alias("back"))
    found = found.where((F.col("forward") >= least) | (F.col("back") >= least))
    # those who own both texts
    found = found.join(own.select("scope", F.col("t").alias("a"), "o").hint("merge"), ["scope", "a"]).join(own.select("o", F.col("t").alias("b")).hint("merge"), ["o", "b"])
    return found.select(F.col("o").alias(owner), "a", "b", "forward", "back")


def between(texts: DataFrame, others: DataFrame, owner: str, text: str, least: float) -> DataFrame:
    """owner, a, b, similarity: texts (a) and different others (b) of one owner, of which the ratio of a against b reaches least."""
    out = met(texts, owner, text, least, others).select(owner, "a", "b", ratio(F.col("a"), F.col("b")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def met(texts: DataFrame, owner: str, text: str, least: float, others: DataFrame | None = None) -> DataFrame:
    """owner, a, b: the pairs a < b that are measured; with others, the pairs of a text and a different other."""
    q, share = gram_size(least), least / (2 - least)
    t = _plain(texts, owner, text).withColumn("side", F.lit(0))
    if others is not None:
        t = t.unionByName(_plain(others, owner, text).withColumn("side", F.lit(1)))
    t = t.withColumn("size", F.char_length("t"))
    places = F.when(F.col("size") >= q, F.transform(F.sequence(F.lit(0), F.col("size") - q), lambda i: F.struct(F.substr("t", i + 1, F.lit(q)).alias("g"), i.alias("p"))))
    same = Window.partitionBy("o", "side", "t", "g")
    grams = t.select("o", "side", "t", "size", F.inline(places)).select("*", F.row_number().over(same.orderBy("p")).alias("no"), F.count("*").over(same).alias("times"))
    seen = grams.groupBy("o", "g", "no").agg(F.count("*").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("o", "side", "t").orderBy("seen", "g", "no"))
    head = grams.join(seen, ["o", "g", "no"]).withColumn("rank", rank).where(F.col("rank") <= F.col("size") - (q - 1) - _least_common(F.col("size"), q, least) + 1)
    # the longer text stays in its length's cell, the shorter one goes to those of all lengths that it can be like
    cells = F.explode(F.sequence("size", F.greatest(F.col("size"), F.floor(F.col("size") / share + 1e-9).cast("int"))))
    long = head.select("o", "g", "no", F.col("size").alias("cell"), F.col("t").alias("x"), F.col("side").alias("x_side"), F.col("p").alias("x_p"), F.col("times").alias("x_times"))
    short = head.select("o", "g", "no", cells.alias("cell"), F.col("t").alias("y"), F.col("side").alias("y_side"), F.col("p").alias("y_p"), F.col("times").alias("y_times"), F.col("size").alias("y_size"))
    # a gram's place moves by what is unmatched; where it repeats, its places cannot be told apart
    loose = F.col("cell") - F.ceil(least * (F.col("cell") + F.col("y_size")) / 2 - 1e-9)
    near = (F.abs(F.col("x_p") - F.col("y_p")) <= loose) | (F.col("x_times") > 1) | (F.col("y_times") > 1)
    if others is None:
        once = (F.col("cell") > F.col("y_size")) | (F.col("x") < F.col("y"))
        both = long.join(short, ["o", "g", "no", "cell"]).where(once & (F.col("x") != F.col("y")) & near)
        found = both.select("o", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    else:  # a text meets others alone, as the longer or as the shorter one
        cross = lambda x: long.where(F.col("x_side") == x).join(short.where(F.col("y_side") == 1 - x), ["o", "g", "no", "cell"]).where((F.col("x") != F.col("y")) & near)
        found = cross(0).select("o", F.col("x").alias("a"), F.col("y").alias("b")).unionByName(cross(1).select("o", F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    # what meets must have as many grams in common as the bound says
    bag = grams.groupBy("o", "side", "t").agg(F.collect_list(F.concat("g", F.lit(" "), F.col("no").cast("string"))).alias("bag"))
    for k, c in enumerate("ab"):
        own = bag.where(F.col("side") == (k if others is not None else 0)).drop("side")
        found = found.join(own.withColumnsRenamed({"t": c, "bag": f"{c}_bag"}), ["o", c])
    total = F.char_length("a") + F.char_length("b")
    m = F.ceil(least * total / 2 - 1e-9)
    enough = F.size(F.array_intersect("a_bag", "b_bag")) >= m - (total - 2 * m + 1) * (q - 1)
    return found.where(enough).select(F.col("o").alias(owner), "a", "b")


def directed(found: DataFrame, owner: str, least: float) -> DataFrame:
    """Of pairs: owner, text, other, similarity: every text with each one that it is like, text against other."""
    one = lambda x, y, r: found.select(owner, F.col(x).alias("text"), F.col(y).alias("other"), F.col(r).alias("similarity"))
    return one("b", "a", "forward").unionByName(one("a", "b", "back")).where(F.col("similarity") >= least)


def rare_tokens(sets: DataFrame, owner: str, tokens: str, least: float) -> DataFrame:
    """owner, tokens, w: of an owner's distinct token sets (sorted arrays) the tokens by which, rarest first, a set would have too
    few others in common: two sets whose Jaccard similarity reaches least share one of them."""
    s = sets.select(owner, tokens).where(F.size(tokens) > 0).distinct()
    one = s.select(owner, tokens, F.explode(tokens).alias("w"))
    seen = one.groupBy(owner, "w").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(owner, tokens).orderBy("n", "w"))
    size = F.size(tokens)
    return one.join(seen, [owner, "w"]).withColumn("rank", rank).where(F.col("rank") <= size - F.ceil(least * size - 1e-9) + 1).select(owner, tokens, "w")


def jaccard(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

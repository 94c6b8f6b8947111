"""Substring joins: which texts hold which patterns, by an index of grams instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import first_by

#: Characters of a gram. A pattern that is shorter is a gram itself.
GRAM = 3


def grams(text: Column, q: int) -> Column:
    """The distinct stretches of q characters of a text."""
    n = F.char_length(text)
    return F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substr(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def holding(patterns: DataFrame, texts: DataFrame, pattern: str, text: str) -> DataFrame:
    """(pattern, text) for every distinct text that holds a distinct, not empty pattern.

    A text that holds a pattern has all of its grams: each pattern is looked up by the one that is in fewest texts, and what
    meets there is compared. Null holds and is held by nothing.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    t = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    size = F.least(F.char_length("pattern"), F.lit(GRAM))
    keys = t.select("text", F.explode(F.flatten(F.array(*[grams(F.col("text"), q) for q in range(1, GRAM + 1)]))).alias("gram"))
    seen = keys.groupBy("gram").agg(F.count("*").alias("n"))
    own = p.select("pattern", F.explode(F.when(size < GRAM, F.array("pattern")).otherwise(grams(F.col("pattern"), GRAM))).alias("gram"))
    # a gram that no text has is the rarest, and then nothing holds the pattern
    rare = own.join(seen, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("pattern", "x.gram")
    return rare.join(keys, "gram").where(F.contains("text", "pattern")).select("pattern", "text")


def first_contained(people: DataFrame, drafts: DataFrame, name: str, slug: str, seq: str) -> DataFrame:
    """people with the slug and seq of the first draft, in order of seq, whose slug holds the person's first name or whose
    slug, hyphens as blanks, stands in the name; nulls without one. Case does not count. An empty slug stands in every name,
    a blank or null name has no first name.
    """
    whole, first = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"^\s*(\S+)", 1))
    d = drafts.select(F.col(seq).alias("d_seq"), F.col(slug).alias("d_slug"), F.lower(F.coalesce(slug, F.lit(""))).alias("d_low")).withColumn("d_words", F.replace("d_low", F.lit("-"), F.lit(" ")))
    p = people.withColumns({"p_name": whole, "p_first": first})
    names, firsts = p.select("p_name"), p.select("p_first")
    low, words = first_by(d, ["d_low"], [F.col("d_seq")]), first_by(d, ["d_words"], [F.col("d_seq")])
    best = F.min(F.struct("d_seq", "d_slug"))
    by_first = holding(firsts, low, "p_first", "d_low").join(low, F.col("text") == F.col("d_low")).groupBy(F.col("pattern").alias("f_key")).agg(best.alias("f"))
    by_words = holding(words, names, "d_words", "p_name").join(words, F.col("pattern") == F.col("d_words")).groupBy(F.col("text").alias("w_key")).agg(best.alias("w"))
    empty = d.where("d_low = ''").agg(best.alias("e"))
    out = p.join(by_first, F.col("p_first") == F.col("f_key"), "left").join(by_words, F.col("p_name") == F.col("w_key"), "left").crossJoin(F.broadcast(empty))
    hit = F.least("f", "w", "e")
    return out.withColumn("hit", hit).select(*people.columns, F.col("hit.d_slug").alias(slug), F.col("hit.d_seq").alias(seq))

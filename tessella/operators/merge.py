"""Upserts, dedupes and state merges. Order matters in all of them, so every input has an explicit sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of which an existing value that is not blank stays.
KEEP_EXISTING = ("job_text", "required_skills", "preferred_skills", "company_domain", "location", "jd_fetch_status")


def full(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order; hot keys cost one row a task, as it is an aggregation."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")
    return df.groupBy(*keys).agg(least).select(*keys, "r.*")


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select(*keys, "r.*")


def upsert(existing: DataFrame, new: DataFrame, key: str, seq: str, longest: str = "job_text", keep: tuple[str, ...] = KEEP_EXISTING) -> DataFrame:
    """Existing rows with new ones merged in, by key.

    Of existing rows with one key the last counts. Then in order of the new rows: the longest column takes strictly
    longer values (trimmed), kept columns take values only while they are blank, all others the newest value, blank
    or not. Result order: existing keys, then new ones, each by first appearance; a null key is a key.
    """
    cols = [c for c in existing.columns if c not in (key, seq)]
    e = existing.select(key, F.lit(0).alias("src"), F.col(seq).alias("n"), *cols)
    both = e.unionByName(new.select(key, F.lit(1).alias("src"), F.col(seq).alias("n"), *cols))
    at = F.struct("src", "n")
    # a row a key: where it first appears, and the last existing row; only that one and new rows count
    per = both.groupBy(F.col(key).alias("upsert_key")).agg(F.min(at).alias("first"), F.max(F.when(F.col("src") == 0, F.col("n"))).alias("last_old"))
    low = F.when(F.col("last_old").isNotNull(), F.struct(F.lit(0).alias("src"), F.col("last_old").alias("n"))).otherwise(F.col("first"))
    both = both.join(per.withColumn("low", low), F.col(key).eqNullSafe(F.col("upsert_key")))
    both = both.where((F.col("src") == 1) | (F.col("n") == F.col("last_old"))).drop("upsert_key", "last_old")
    aggs = []
    for c in cols:
        value = F.col(c)
        if c == longest:
            # the first row as it is, later ones trimmed; the earliest of the longest
            aggs.append(F.max_by(F.when(at == F.col("low"), value).otherwise(F.trim(value)), F.struct(F.length(F.trim(F.coalesce(value, F.lit("")))), -F.col("src"), -F.col("n"))).alias(c))
        elif c in keep:
            aggs.append(F.coalesce(F.min_by(value, F.when(full(value), at)), F.max_by(value, at)).alias(c))
        else:
            aggs.append(F.max_by(value, at).alias(c))
    out = both.groupBy(key).agg(*aggs, F.min("first").alias("first"))
    return out.select(key, *cols, F.col("first.src").alias("is_new"), F.col("first.n").alias("first_seq"))


def fill(df: DataFrame, keys: list[str], order: str, union: str, by: str = "|") -> DataFrame:
    """One row a key: of each column the first value that is not blank; of the union column all parts, sorted."""
    rest = [c for c in df.columns if c not in (*keys, order, union)]
    parts = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(F.coalesce(F.col(union), F.lit("")), F.lit("[" + by + "]")), lambda x: x != ""))))), by)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(full(F.col(c)), F.col(order))).alias(c) for c in rest], parts.alias(union), F.min(order).alias(order))


#: Suffixes that do not tell companies apart when postings are deduplicated.
POSTING_SUFFIX = r"(?i)\s+(pty\s*ltd|pty|ltd|limited|inc|llc|p/l)\.?$"


def postings(df: DataFrame, company: str, title: str, seq: str, iso: str = "posted_at_iso", relative: str = "posted_relative", url: str = "posting_url", source: str = "source") -> DataFrame:
    """Postings of one company (without its suffix) and title merged: the first is the base; where it has no date, the
    date comes with its relative text from the first that has one; a missing address likewise; sources are united."""
    key = [F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(F.col(company), F.lit(""))), POSTING_SUFFIX, ""))).alias("company_key"), F.lower(F.coalesce(F.col(title), F.lit(""))).alias("title_key")]
    rest = [c for c in df.columns if c not in (iso, relative, url, source, seq)]
    own, dated = F.struct(iso, relative), F.when(full(F.col(iso)), F.col(seq))
    out = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), seq).alias("r"), F.coalesce(F.min_by(own, dated), F.min_by(own, seq)).alias("d"),
        F.coalesce(F.min_by(url, F.when(full(F.col(url)), F.col(seq))), F.min_by(url, seq)).alias(url), F.array_join(F.array_sort(F.collect_set(source)), ",").alias(source), F.min(seq).alias(seq),
    )
    return out.select("company_key", "title_key", "r.*", "d.*", url, source, seq)


def people(df: DataFrame, name: str, seq: str, source: str) -> DataFrame:
    """People merged whose names have the same letters (k); names without any go. Columns take their first value that is
    not blank; sources are united."""
    keyed = df.withColumn("k", F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), "[^a-z]+", "")).where("k <> ''")
    rest = [c for c in df.columns if c not in (seq, source)]
    return keyed.groupBy("k").agg(*[F.min_by(c, F.when(full(F.col(c)), F.col(seq))).alias(c) for c in rest], F.array_join(F.array_sort(F.collect_set(F.when(full(F.col(source)), F.col(source)))), ",").alias(source), F.min(seq).alias(seq))


def source_quality(score: Column, text: Column, domain: Column, url: Column) -> Column:
    """How far a posting is to be preferred among its duplicates. score: its authenticity."""
    from ..functions import urls as U

    h, d = U.host(url), F.lower(F.coalesce(domain, F.lit("")))
    own = (h != "") & (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))
    some = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", n).otherwise(0)
    return F.coalesce(score, F.lit(0)) + F.least(F.floor(F.length(F.coalesce(text, F.lit(""))) / 300), F.lit(12)).cast("int") + some(domain, 10) + some(url, 8) + F.when(own, 12).otherwise(0)


def best_by(df: DataFrame, key: str, confidence: str, order: str) -> DataFrame:
    """The row of highest confidence of each key, the first of equals."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(order))).alias("r")).select(key, "r.*")


def insert_or_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of table, and those of new whose key it lacks (the first of each)."""
    fresh = new.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def insert_or_replace(table: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    last = last_by(new, [key], [F.col(seq)])
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def ingest(table: DataFrame, new: DataFrame, key: str, update: list[str], seq: str, state: dict[str, str]) -> DataFrame:
    """Contacts ingested: known keys take the update columns where the new value is not blank and keep their state;
    unknown ones come with the initial state. The first of a batch's rows of one key counts."""
    one = first_by(new, [key], [F.col(seq)]).select(key, *[F.col(c).alias(f"new_{c}") for c in update], F.lit(True).alias("seen"))
    both = table.join(one, key, "full_outer")
    cols = [F.when(full(F.col(f"new_{c}")), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.coalesce(F.col(c), F.lit(state[c])).alias(c) if c in state else F.col(c) for c in table.columns]
    return both.select(*cols)


def set_once(old: Column, now: Column) -> Column:
    return F.coalesce(old, now)


def latest_status(events: DataFrame, key: str, status: str, at: str, seq: str, allowed: list[str]) -> DataFrame:
    """The state that a log of events leaves: the latest allowed status of each key."""
    known = events.where(F.col(status).isin(allowed))
    return known.groupBy(key).agg(F.max_by(status, F.struct(at, seq)).alias(status), F.max(at).alias(at))


def survivors(rows: DataFrame, group: str, seq: str, quality: Column, text: str, lists: list[str], sets: list[str]) -> DataFrame:
    """One row of each duplicate group: the row of best quality (first of equals) with the longest text, the ordered
    union of list columns (case-insensitive), the sorted union of set columns, else the first value not blank."""
    rest = [c for c in rows.columns if c not in (group, seq, text, *lists, *sets)]
    first = lambda c: F.coalesce(F.max_by(c, F.when(full(F.col(c)), F.struct(quality, -F.col(seq)))), F.min_by(c, F.when(full(F.col(c)), F.col(seq))))

    def ordered(c: str) -> Column:
        parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.split(F.coalesce(F.col(c), F.lit("")), r";|\|\|").alias("p")))), lambda x: x["p"]))
        parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
        return F.array_join(F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(y)), F.lower(x)) == i + 1), "; ")

    return rows.groupBy(group).agg(
        F.max_by(seq, F.struct(quality, -F.col(seq))).alias("primary_seq"),
        F.max_by(text, F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), -F.col(seq))).alias(text),
        *[ordered(c).alias(c) for c in lists],
        *[F.array_join(F.array_sort(F.collect_set(F.when(full(F.col(c)), F.col(c)))), "; ").alias(c) for c in sets],
        *[first(c).alias(c) for c in rest],
        F.count("*").alias("n"),
    )

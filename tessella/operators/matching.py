"""Dictionaries of aliases against free text, and the fit score built on their hits.

Two ways give the same hits: a plan of built-in functions, for a dictionary of some hundred aliases, and an
automaton that scans each text once, for larger ones. Neighbours of a hit must not be letters or digits; a strict
alias must stand between separators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import slices
from .automaton import SEPARATORS, Automaton


def alias_pattern(alias: str, strict: bool = False) -> str:
    a = re.escape(alias.lower())
    if strict:
        s = "[" + re.escape(SEPARATORS) + "]"
        return f"(?<=^|{s}){a}(?=$|{s})"
    return f"(?<![a-z0-9]){a}(?![a-z0-9])"


def alias_counts(text: Column, aliases: dict[str, list[str]], strict: tuple[str, ...] = ()) -> Column:
    """Array of (label, freq, first_pos) of labels that occur, in the dictionary's order; aliases of a label add up, and
    its first place, from 0, is that of the earliest."""
    t = F.lower(F.coalesce(text, F.lit("")))
    one = []
    for label, names in aliases.items():
        patterns = [F.lit(alias_pattern(a, a in strict)) for a in names]
        freq = sum((F.regexp_count(t, p) for p in patterns), F.lit(0))
        first = F.array_min(F.filter(F.array(*[F.regexp_instr(t, p) for p in patterns]), lambda x: x > 0)) - 1
        one.append(F.struct(F.lit(label).alias("label"), freq.alias("freq"), first.alias("first_pos")))
    return F.filter(F.array(*one), lambda x: x["freq"] > 0)


def alias_frequencies(text: Column, aliases: dict[str, list[str]], strict: tuple[str, ...] = ()) -> Column:
    """Array of (label, freq) of labels that occur: alias_counts without places, for half of its scans."""
    t = F.lower(F.coalesce(text, F.lit("")))
    one = [F.struct(F.lit(label).alias("label"), sum((F.regexp_count(t, F.lit(alias_pattern(a, a in strict))) for a in names), F.lit(0)).alias("freq")) for label, names in aliases.items()]
    return F.filter(F.array(*one), lambda x: x["freq"] > 0)


HITS = "array<struct<label:string,freq:int,first_pos:int,last_pos:int,alias:string>>"


def machine_of(df: DataFrame, aliases: dict[str, str] | list[tuple[str, str]], strict: tuple[str, ...] = ()):
    """The dictionary as arrays, sent to tasks once: as large as the dictionary is, not the data."""
    return df.sparkSession.sparkContext.broadcast(Automaton(aliases, strict))


def automaton_hits(df: DataFrame, text: str, aliases: dict[str, str] | list[tuple[str, str]], name: str = "hits", strict: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """df with all labels found in the text column, by label: hits of its aliases, places of the first and the last hit, and
    the first of its aliases, in the dictionary's order, that is met. One scan a text whatever the dictionary's size.
    apart: hits of one alias that overlap count once."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    at = df.columns.index(text)
    machine = machine_of(df, aliases, strict)
    schema = StructType([*df.schema.fields, *_parse_datatype_string(f"`{name}` {HITS}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for b in (s for whole in batches for s in slices(whole, at)):
            row, alias, place = m.occurrences(b.column(at).to_pylist(), apart)
            key, first, freq = np.unique(row * len(m.labels) + m.label_of[alias], return_index=True, return_counts=True)
            by = np.lexsort((place, m.label_of[alias], row)) if len(row) else row
            last = place[by[np.cumsum(freq) - 1]] if len(row) else row
            least = np.minimum.reduceat(alias[by], np.cumsum(freq) - freq) if len(row) else row
            ends = np.searchsorted(key // max(len(m.labels), 1), np.arange(b.num_rows + 1))
            ints = [pa.array(x.astype(np.int32)) for x in (freq, place[first], last)]
            named = lambda texts, k: pa.array(texts, pa.string()).take(pa.array(k.astype(np.int64)))
            fields = [named(m.labels, key % max(len(m.labels), 1)), *ints, named(m.aliases, least)]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["label", "freq", "first_pos", "last_pos", "alias"]))
            yield pa.RecordBatch.from_arrays([*b.columns, hits], names=schema.names)

    return df.mapInArrow(run, schema)


def occurrences(df: DataFrame, key: str, text: str, aliases: dict[str, str] | list[tuple[str, str]], strict: tuple[str, ...] = ()) -> DataFrame:
    """Every hit as a row: key, label, alias, place from 0."""
    from pyspark.sql.types import StringType, IntegerType, StructField, StructType

    machine = machine_of(df, aliases, strict)
    schema = StructType([df.schema[key], StructField("label", StringType()), StructField("alias", StringType()), StructField("place", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for b in (s for whole in batches for s in slices(whole, 1)):
            row, alias, place = m.occurrences(b.column(1).to_pylist())
            named = lambda texts, k: pa.array(texts, pa.string()).take(pa.array(k.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), named(m.labels, m.label_of[alias]), named(m.aliases, alias), pa.array(place.astype(np.int32))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def term_weights(df: DataFrame, text: str, terms: dict[str, list[str]], unsupported: dict[str, list[str]], region: Column) -> DataFrame:
    """df with terms: of each label that is met its weight, hits and alias (label, weight, freq, alias), and unsupported: the
    labels of that dictionary that are met, sorted.

    A label weighs 2 if any hit of any of its aliases starts in the requirements, else 1; its alias is the first of the
    dictionary's that is met anywhere. region: place of the requirements from 1, 0 for none. One scan serves both.
    """
    pairs = [(a, f"{sign}{label}") for sign, d in (("+", terms), ("-", unsupported)) for label, names in d.items() for a in names]
    found = automaton_hits(df, text, pairs, "term_hits", apart=True).withColumn("term_region", region)
    of = lambda sign: F.filter("term_hits", lambda h: h["label"].startswith(sign))
    bare = lambda h: F.substring(h["label"], 2, 1 << 30)
    weight = lambda h: F.when((F.col("term_region") > 0) & (h["last_pos"] >= F.col("term_region") - 1), 2).otherwise(1)
    own = F.transform(of("+"), lambda h: F.struct(bare(h).alias("label"), weight(h).alias("weight"), h["freq"].alias("freq"), h["alias"].alias("alias")))
    return found.withColumns({"terms": own, "unsupported": F.array_sort(F.transform(of("-"), bare))}).drop("term_hits", "term_region")


def overlay_aliases(curated: DataFrame, wider: DataFrame) -> DataFrame:
    """(alias, label) of both; the curated one counts where both know an alias."""
    from .joins import precedence

    return precedence([curated.withColumn("n", F.col("label")), wider.withColumn("n", F.col("label"))], ["alias"], "n").select("alias", "label")


def contained(items: DataFrame, texts: DataFrame, item: str, text: str, tokens: str, share: float) -> DataFrame:
    """item, text, common, size: pairs of an item and a text that holds this share of its distinct tokens.

    A text that lacks fewer than n - ceil(share * n) + 1 of an item's n tokens holds one of its so many rarest: only
    these meet, so a word that is in every text joins nothing. What meets is counted as sets.
    """
    t, n = "contained_token", "contained_size"
    seen = texts.select(F.explode(tokens).alias(t)).groupBy(t).agg(F.count("*").alias("contained_seen"))
    own = items.select(item, F.size(tokens).alias(n), F.explode(tokens).alias(t)).join(seen, t)
    # tokens that no text has would be the rarest
    rank = F.row_number().over(Window.partitionBy(item).orderBy("contained_seen", t)) + F.col(n) - F.count("*").over(Window.partitionBy(item))
    need = F.ceil(F.col(n) * F.lit(share) - 1e-9)
    rare = own.withColumn("contained_rank", rank).where(F.col("contained_rank") <= F.col(n) - need + 1)
    met = rare.select(item, t).join(texts.select(text, F.explode(tokens).alias(t)), t).select(item, text).distinct()
    both = met.join(items.select(item, F.col(tokens).alias("contained_a")), item).join(texts.select(text, F.col(tokens).alias("contained_b")), text)
    out = both.select(item, text, F.size(F.array_intersect("contained_a", "contained_b")).cast("long").alias("common"), F.size("contained_a").cast("long").alias("size"))
    return out.where(F.col("common") >= F.col("size") * F.lit(share)).select(item, text, "common", "size")


#: Parameters of the fit score.
KEEP, STRONG, SMOOTH, GAP_DISCOUNT = 45, 68, 2, 0.6
SOFT_MANAGER, SOFT_ANALYST, SOFT_OTHER = 0.40, 0.25, 0.15
LEAD_WORDS = r"(?i)\b(senior|lead|principal|head of|head|director|manager|chief|staff)\b"


def importance(freq: Column, first_pos: Column, region: Column) -> Column:
    """Hits count up to three, twice from the requirements on. Positions from 0; region from 1, 0 for none."""
    return F.when((region > 0) & (first_pos >= region - 1), 2).otherwise(1) * F.least(freq, F.lit(3))


def soft_weight(title: Column, text: Column, region: Column) -> Column:
    """What soft labels count for a role. region: the text from its requirements on."""
    from ..functions import classify as K

    lead = F.coalesce(title, F.lit("")).rlike(LEAD_WORDS) | region.rlike(K.SENIOR_WORDS)
    return F.when(lead, SOFT_MANAGER).when(K.role_family(title, text) == "business_analyst", SOFT_ANALYST).otherwise(SOFT_OTHER)


def lacked(first_pos: Column, region: Column) -> Column:
    """What a tool that the candidate lacks counts: twice from the requirements on. Places as for importance."""
    return F.when((region > 0) & (first_pos >= region - 1), 4).otherwise(2)


FLAGS = ("unmet", "no_authorization", "senior", "off_target", "in_region")


def fit_score(hits: DataFrame, key: str, profile: DataFrame, unknown: str, soft_weight: str, lacked: str = "lacked_weight", flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Score of each key from its label hits.

    hits: key, label, imp, and the per-key columns named here: number of unknown acronyms, weight of soft labels,
    weight of labels that the candidate lacks, and flags: those that cap the score, and whether requirements were
    found, without which confidence is low. profile: label, supported, soft, excluded. A key without hits has a row
    with a null label. Soft labels are tested before excluded ones.
    """
    unmet, authorization, senior, off_target, in_region = flags
    # a profile is small, and labels are few: by a shuffle each would be one task
    rows = hits.join(F.broadcast(profile), "label", "left")
    is_soft, has, out = (F.coalesce(F.col(c), F.lit(False)) for c in ("soft", "supported", "excluded"))
    live = F.col("label").isNotNull()

    def total(test: Column, factor: float = 1.0) -> Column:
        return F.coalesce(F.sum(F.when(live & test, F.col("imp") * factor)), F.lit(0.0))

    def labels(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(live & test, F.col("label"))))

    sums = rows.groupBy(key).agg(
        total(~is_soft & has).alias("sup"),
        total(is_soft & has).alias("sup_soft"),
        total(is_soft & ~has, GAP_DISCOUNT).alias("gap_soft"),
        total(~is_soft & ~has & ~out, GAP_DISCOUNT).alias("gap"),
        labels(has).alias("supported"),
        labels(~is_soft & ~has).alias("lacking"),
        *[F.first(c).alias(c) for c in (unknown, soft_weight, lacked, unmet, authorization, senior, off_target)],
        (F.first(in_region) if in_region in hits.columns else F.lit(True)).alias(in_region),
    )
    w = F.col(soft_weight)
    whole = F.col("sup") + F.col("gap") + F.col(lacked) + 2 * F.col(unknown) + w * (F.col("sup_soft") + F.col("gap_soft"))
    num = F.col("sup") + w * F.col("sup_soft")
    raw = F.when(whole == 0, F.lit(0.0)).otherwise(100 * num / (whole + SMOOTH))
    raw = F.when(F.col(authorization), F.least(raw, F.lit(25.0))).when(F.col(unmet), F.least(raw, F.lit(35.0))).otherwise(raw)
    raw = raw * F.when(F.col(senior), 0.85).otherwise(1.0) * F.when(F.col(off_target), 0.7).otherwise(1.0)
    fit = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 9))), 0).cast("int")
    cover = F.when(whole == 0, 0).otherwise(F.bround(F.round(100 * num / whole, 9), 0)).cast("int")
    band = F.when(fit >= STRONG, "strong").when(fit >= KEEP, "fair").otherwise("drop")
    return sums.select(
        key, fit.alias("fit"), cover.alias("coverage_pct"), (F.col(in_region) & (whole >= 4)).alias("enough"), band.alias("band"),
        F.array_join("supported", ", ").alias("supported"), F.array_join("lacking", ", ").alias("lacking"),
    )


def rescored(stored: DataFrame, hits: DataFrame, key: str, old: DataFrame, new: DataFrame, unknown: str, soft_weight: str, lacked: str = "lacked_weight", flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Scores after a change of profile: stored (what fit_score gave by the old profile) with the rows anew that hit a label
    whose entry changed, came or went; all others are carried over by key. recomputed says which. hits by label are the
    index: only keys of changed labels are looked up and scored.
    """
    entry = lambda p, name: p.select("label", F.struct(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("supported", "soft", "excluded")]).alias(name))
    plain = F.struct(*[F.lit(False).alias(c) for c in ("supported", "soft", "excluded")])  # what a label without an entry counts as
    both = entry(old, "was").join(entry(new, "now"), "label", "full")
    changed = both.where(F.coalesce("was", plain) != F.coalesce("now", plain)).select("label")
    touched = hits.select(key, "label").join(F.broadcast(changed), "label", "left_semi").select(key).distinct()
    again = fit_score(hits.join(touched, key, "left_semi"), key, new, unknown, soft_weight, lacked, flags).withColumn("recomputed", F.lit(True))
    return stored.join(touched, key, "left_anti").withColumn("recomputed", F.lit(False)).unionByName(again)


def explained(band: Column, fit: Column, family: Column, supported: Column, lacking: Column, knockouts: Column, senior: Column, off_target: Column) -> Column:
    """A score in words: what speaks for it, what is missing, what capped it, what to verify. Lists are arrays."""
    details = lambda test: F.transform(F.filter(knockouts, test), lambda k: k["detail"])
    unmet, verify = details(lambda k: k["status"] == "unmet"), details(lambda k: k["status"] == "unknown")
    no_work = F.exists(knockouts, lambda k: (k["type"] == "work_authorization") & (k["status"] == "unmet"))
    caps = F.array(
        F.when(no_work, "work authorization required").when(F.size(unmet) > 0, F.concat(F.lit("auto-reject risk: "), F.array_join(unmet, "; "))),
        F.when(senior, "senior/lead level"), F.when(off_target, "off-target role"),
    )
    caps = F.filter(caps, lambda c: c.isNotNull())
    some = lambda a, lead: F.when(F.size(a) > 0, F.concat(F.lit(lead), F.array_join(a, ", "))).otherwise("")
    evidence = F.when(F.size(supported) > 0, F.array_join(F.slice(supported, 1, 3), ", ")).otherwise("no evidenced must-haves")
    risk = F.when(F.size(unmet) > 0, F.concat(F.lit("AUTO-REJECT RISK (needs "), F.array_join(unmet, ", "), F.lit("); "))).otherwise("")
    head = F.concat(band, F.lit(" fit "), fit.cast("string"), F.lit("% - "), F.replace(family, F.lit("_"), F.lit(" ")), F.lit("; evidences "), evidence)
    return F.concat(risk, head, some(F.slice(lacking, 1, 3), "; missing "), some(caps, "; capped: "), some(verify, "; verify: "))

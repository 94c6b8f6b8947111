"""Aliases derived from occupational phrases: a leading verb is taken off, a noun phrase stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Verbs that are taken off, particles after them, heads that say nothing, and aliases that never count.
SKILL_VERBS = [
    "ensure", "manage", "provide", "perform", "administer", "conduct",
    "develop", "maintain", "operate", "apply", "monitor", "coordinate",
    "use", "supervise", "oversee", "prepare", "deliver", "implement",
    "plan", "design", "organise", "organize", "review", "assess",
    "evaluate", "control", "carry", "make", "identify", "support",
    "build", "create", "establish", "lead", "direct", "handle",
    "process", "utilise", "utilize",
]
PARTICLES = ["out", "up", "of", "the", "a", "an", "with", "for", "in", "on"]
GENERIC_HEADS = [
    "procedures", "principles", "practices", "activities", "standards",
    "requirements", "compliance", "regulations", "information", "data",
    "staff", "duties", "services", "systems", "processes", "operations",
    "management", "work", "tasks", "support",
    "needs", "performance", "facilities", "strategy", "strategies",
    "plan", "plans", "resources",
]
DENIED = [
    "human resources", "financial reports", "customer service",
    "data analysis", "project work", "team support", "daily operations",
    "general administration", "best practices",
]
LEAST = 6


def base_of_gerund(word: Column) -> Column:
    """The verb that a gerund is of ('managing': manage); null where it is of none."""
    stem = F.left(word, F.length(word) - 3)
    is_verb = lambda c: c.isin(SKILL_VERBS)
    found = F.when(is_verb(stem), stem).when(is_verb(F.concat(stem, F.lit("e"))), F.concat(stem, F.lit("e")))
    return F.when(word.endswith("ing") & (F.length(word) > 4), found)


def bare_noun(phrase: Column, known: Column | None = None, deny: list[str] = DENIED) -> Column:
    """A phrase without its leading verb, one particle and an article; null where no safe alias is left.

    known: array of aliases that are there already.
    """
    words = F.split(F.lower(T.squeeze(phrase)), " ")
    lead = F.get(words, F.lit(0))
    has_verb = lead.isin(SKILL_VERBS) | base_of_gerund(lead).isNotNull()
    without = lambda w, drop: F.when(F.coalesce(F.get(w, F.lit(0)).isin(drop), F.lit(False)), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    rest = without(without(rest, PARTICLES), ["a", "an", "the"])
    alias = F.array_join(rest, " ")
    ok = has_verb & (F.size(rest) >= 2) & ~F.coalesce(F.get(rest, F.size(rest) - 1).isin(GENERIC_HEADS), F.lit(False)) & (F.length(alias) >= LEAST) & ~alias.isin(deny)
    if known is not None:
        ok = ok & ~F.coalesce(F.array_contains(known, alias), F.lit(False))
    return F.when(ok, alias)

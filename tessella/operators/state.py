"""State beside the data: boards joined to what users did, event logs and folds, migrations and rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from . import merge

#: The states that postings, people and prospects go through.
STATUS_FLOW = ["new", "applied", "phone_screen", "interview", "offer", "rejected", "closed"]
PERSON_FLOW = ["not_contacted", "contacted", "followup_due", "replied", "closed"]
STAGE_FLOW = ["lead", "contacted", "replied", "meeting", "won", "lost"]
#: Kinds of logged events, and what each leaves in the state.
EVENTS = {"applied": ("applied", True), "unapplied": ("applied", False), "dismissed": ("dismissed", True), "restored": ("dismissed", False)}


def joined(jobs: DataFrame, state: DataFrame, status: DataFrame, packages: DataFrame, seen: DataFrame, key: str = "row_key") -> DataFrame:
    """Postings with what there is about each in four side tables; each has a key once at most."""
    out = jobs
    for side in (state, status, packages, seen):
        out = out.join(side, key, "left")
    return out


def shaped(rows: DataFrame) -> DataFrame:
    """Derived columns of a board's rows: flags, tone, status, lists, the day and the time that it counts as posted.

    rows: match_score, applied_at, starred, dismissed, resume_file, notes, app_status, jd_posted_date, first_seen_date,
    matched_evidence and gaps (by ;), jd_terms_missing (by comma), confidence.
    """
    score, no = F.coalesce("match_score", F.lit(0)), F.lit(False)
    day = F.when(F.col("jd_posted_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.left("jd_posted_date", F.lit(10))).otherwise(F.left(F.coalesce("first_seen_date", F.lit("")), F.lit(10)))
    posted = [F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(c)) for c in ("jd_posted_date", "first_seen_date")]
    applied = F.coalesce(F.col("applied_at").cast("string"), F.lit("")) != ""
    return rows.withColumns(
        {
            "applied": applied, "starred": F.coalesce(F.col("starred").cast("boolean"), no), "dismissed": F.coalesce(F.col("dismissed").cast("boolean"), no),
            "has_resume": F.coalesce("resume_file", F.lit("")) != "", "notes": F.coalesce("notes", F.lit("")), "score_tone": F.when(score >= 75, "high").when(score >= 55, "mid").otherwise("low"),
            "status": F.coalesce(F.nullif("app_status", F.lit("")), F.when(applied, "applied").otherwise("new")), "evidence_list": T.split_list(F.col("matched_evidence")), "gaps_list": T.split_list(F.col("gaps")),
            "missing_list": T.split_list(F.col("jd_terms_missing"), ","), "low_confidence": F.coalesce(F.col("confidence") == "low", no), "job_day": day, "posted_at": F.coalesce(*posted, F.lit("")),
        }
    )


def board(rows: DataFrame, now: Column, view: str | None = None, show_dismissed: bool = False, day: str | None = None, starred: bool = False, least: int = 0, fresh: str | None = None, sector: str | None = None, status: str | None = None, query: str | None = None, search: tuple[str, ...] = ("company", "role_title", "location", "sector")) -> DataFrame:
    """Shaped rows that pass every filter given, newest first, then by score, then starred; unscored rows never show."""
    tests = [F.col("match_score").isNotNull()]
    tests += {"to_review": [~F.col("applied"), ~F.col("dismissed")], "applied": [F.col("applied")], "starred": [F.col("starred")]}.get(view or "", [~F.col("applied")])
    if not show_dismissed:
        tests.append(~F.col("dismissed"))
    if day and day != "all":
        tests.append(F.col("job_day") == day)
    if starred:
        tests.append(F.col("starred"))
    if least:
        tests.append(F.col("match_score") >= least)
    if fresh:
        tests.append(dates.fresh(F.col("posted_at"), fresh, now))
    if sector:
        tests.append(F.col("sector") == sector)
    if status:
        tests.append(F.col("status") == status)
    if query:
        tests.append(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in search])), F.lit(query.lower())))
    out = rows
    for t in tests:
        out = out.where(t)
    return out.orderBy(F.desc("posted_at"), F.desc("match_score"), F.desc("starred"), "row_key")


def board_counts(rows: DataFrame) -> DataFrame:
    """Counts over all scored rows, whatever the board shows: one row."""
    on = lambda c: F.count_if(c)
    return rows.where("match_score is not null").agg(F.count("*").alias("total"), on(F.col("applied")).alias("applied"), on(F.col("dismissed")).alias("dismissed"), on(F.col("starred")).alias("starred"), on(~F.col("applied") & ~F.col("dismissed")).alias("to_review"))


def with_counts(shown: DataFrame, every: DataFrame) -> DataFrame:
    """A filtered board's rows beside the counts over all rows, which are one row."""
    counts = board_counts(every)
    return shown.crossJoin(F.broadcast(counts.select(*[F.col(c).alias(f"all_{c}") for c in counts.columns])))


#: Sort keys of the tracker, with the direction that each has unless told otherwise.
SORTS = {"company": ("company", "asc"), "added": ("added_key", "desc"), "fit": ("max_score", "desc"), "applied": ("applied_count", "desc"), "activity": ("last_activity", "desc")}


def tracker(groups: DataFrame, sort: str = "activity", direction: str | None = None, key: str = "company_key") -> DataFrame:
    """Company groups by one of five sort keys; an unknown key sorts by activity."""
    column, default = SORTS.get(sort, SORTS["activity"])
    c = F.lower(F.coalesce(column, F.lit(""))) if column == "company" else F.col(column)
    down = (direction or default) == "desc" if column == "company" else direction != "asc"
    return groups.orderBy(c.desc_nulls_last() if down else c.asc_nulls_first(), key)


def append_events(log: DataFrame, actions: DataFrame) -> DataFrame:
    """A log with more events (row_key, event_type, payload, at); kinds that it does not know are refused."""
    return log.unionByName(actions.where(F.col("event_type").isin(list(EVENTS))).select(*log.columns))


def folded(log: DataFrame, key: str, kind: str, at: str, seq: str) -> DataFrame:
    """What a log leaves for each key: applied and dismissed, by the latest event of either; when last changed."""
    order = F.struct(at, seq)
    flag = lambda name: F.coalesce(F.max_by(F.col(kind).isin([k for k, (f, on) in EVENTS.items() if f == name and on]), F.when(F.col(kind).isin([k for k, (f, _) in EVENTS.items() if f == name]), order)), F.lit(False))
    return log.where(F.col(kind).isin(list(EVENTS))).groupBy(key).agg(flag("applied").alias("applied"), flag("dismissed").alias("dismissed"), F.max(at).alias("changed_at"))


def moved(table: DataFrame, changes: DataFrame, key: str, stage: str, seq: str, flow: list[str]) -> tuple[DataFrame, DataFrame]:
    """table with the last allowed stage that changes give a key, and the changes refused as their stage is unknown."""
    known = F.coalesce(F.col(stage).isin(flow), F.lit(False))
    last = merge.last_by(changes.where(known).select(key, stage, seq), [key], [F.col(seq)]).select(key, F.col(stage).alias("to_stage"))
    rest = [c for c in table.columns if c not in (key, stage)]
    out = table.join(last, key, "left").select(key, F.coalesce("to_stage", stage).alias(stage), *rest)
    return out, changes.where(~known)


def on_conflict(table: DataFrame, new: DataFrame, key: str, update: list[str], seq: str) -> DataFrame:
    """table with new keys added, and of known keys only the update columns taken from the last new row."""
    last = merge.last_by(new, [key], [F.col(seq)]).withColumn("was_new", F.lit(True))
    n = last.select(key, "was_new", *[F.col(c).alias(f"new_{c}") for c in table.columns if c != key and c in new.columns])
    both = table.withColumn("was_old", F.lit(True)).join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("was_old").isNull() | (F.lit(c in update) & F.col("was_new").isNotNull()), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c == key or f"new_{c}" not in both.columns else pick(c) for c in table.columns])


def migrated(target: DataFrame, people: DataFrame, state: DataFrame, companies: DataFrame) -> DataFrame:
    """target as it is once it has rows; else people with their state and their company's name. Running it again on its
    own result changes nothing. The decision is a one-row aggregate of the same plan."""
    filled = target.agg((F.count("*") > 0).alias("filled"))
    rows = people.join(state, "person_key", "left").join(companies, "company_key", "left")
    rows = rows.select(
        "person_key", "company_key", F.coalesce("company_name", "company_key").alias("company_name"), "name", F.col("role").alias("title"), F.col("verified_email").alias("email"),
        F.coalesce(F.nullif("outreach_status", F.lit("")), F.lit("not_contacted")).alias("outreach_status"), F.coalesce("notes", F.lit("")).alias("notes"), "created_at", "updated_at",
    ).dropDuplicates(["person_key"])
    fresh = rows.crossJoin(F.broadcast(filled)).where("not filled").drop("filled")
    return target.unionByName(fresh.select(*target.columns))


def rebuilt(spark, sources: dict[str, DataFrame], folder: str, kept: tuple[str, ...] = ()) -> dict[str, int]:
    """The next versions of a folder's derived tables, from their sources; readers never find one absent; tables that users write to (kept) are never touched.
    Rows of each table written."""
    from ..sources.files import current, replaced

    counts = {}
    for name, df in sources.items():
        if name in kept:
            raise ValueError(f"{name} belongs to the users' zone")
        replaced(df, f"{folder}/{name}")
        counts[name] = current(spark, f"{folder}/{name}").count()
    return counts


def onboarding(skills_built: Column, tracked: Column) -> Column:
    """How far a user has come: the number of tracked positions counts once skills are built."""
    return F.when(~F.coalesce(skills_built, F.lit(False)), "NEEDS_RESUME").when(F.coalesce(tracked, F.lit(0)) == 0, "NEEDS_POSITIONS").otherwise("READY")


def qa_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows that a seed picks: the same at every run, however the table is laid out."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def named_universe(sources: list[DataFrame], key: str, name: str, seq: str) -> DataFrame:
    """Every key of the sources with the name under which it came first: earlier sources, then rows, before later."""
    parts = [s.select(key, F.col(name).alias("name"), F.lit(i).alias("rank"), F.col(seq).alias("seq")) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min_by("name", F.when(T.blank_to_null(F.col("name")).isNotNull(), F.struct("rank", "seq"))).alias("name"), F.min("rank").alias("source_rank"))


def prospect_groups(companies: DataFrame, prospects: DataFrame, key: str, name: str, priority: str) -> DataFrame:
    """Companies with their prospects as a list by name and their number: those of priority first, then by name in any case.
    A company of prospects alone is named by its key and has no priority; one without prospects has an empty list.
    prospects: key, prospect, name."""
    people = prospects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.lower(F.coalesce("name", F.lit(""))).alias("by"), "prospect", "name"))).alias("people"))
    both = companies.select(key, F.col(name).alias("company_name"), F.col(priority).cast("int").alias("priority")).join(people, key, "full")
    out = both.select(key, F.coalesce(F.nullif("company_name", F.lit("")), F.col(key).cast("string")).alias("company_name"), F.coalesce("priority", F.lit(0)).alias("priority"), F.filter(F.transform(F.coalesce("people", F.array(F.lit(None))), lambda p: F.struct(p["prospect"].alias("prospect"), p["name"].alias("name"))), lambda p: p["prospect"].isNotNull()).alias("prospects"))
    return out.withColumn("prospect_count", F.size("prospects")).orderBy(F.desc("priority"), F.lower("company_name"), key)

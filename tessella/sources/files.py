"""Reading and writing the file forms that the pipelines exchange. All columns are text until a query casts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Canonical fields and the headers that are read as them, the first that is not blank.
ALIASES = {
    "company": ["company", "company_name", "employer", "organisation", "organization"],
    "company_domain": ["company_domain", "domain", "company_website", "website"],
    "role_title": ["role_title", "job_title", "title", "position"],
    "location": ["location", "job_location", "work_location"],
    "job_url": ["job_url", "url", "link", "apply_url", "posting_url"],
    "job_text": ["job_text", "job_description", "description", "jd", "summary"],
    "required_skills": ["required_skills", "requirements", "must_have", "required"],
    "preferred_skills": ["preferred_skills", "nice_to_have", "preferred"],
    "notes": ["notes", "note"],
    "source_platform": ["source_platform", "source", "job_source", "alert_source"],
    "posted_date": ["posted_date", "date_posted", "email_date", "alert_date"],
    "alert_query": ["alert_query", "saved_search", "search_query", "gmail_subject"],
}


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Text columns by header; newlines and quotes inside fields are kept, a byte-order mark is not."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE")
    df = r.csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return with_columns(df, columns) if columns else df


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; those that df lacks are null, its others go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in order of first appearance."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def canonical(df: DataFrame) -> DataFrame:
    """Canonical fields by header alias, white space squeezed; unknown columns are carried along."""
    have = {c.strip().lower(): c for c in df.columns}
    taken = {a for names in ALIASES.values() for a in names}

    def pick(names: list[str]) -> Column:
        found = [T.blank_to_null(T.squeeze(F.col(f"`{have[n]}`"))) for n in names if n in have]
        return F.coalesce(*found, F.lit(""))

    rest = [T.squeeze(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns if c.strip().lower() not in taken and c.strip() and not c.strip().startswith("_")]
    return df.select(*[pick(names).alias(field) for field, names in ALIASES.items()], *rest)


def unpivot_people(df: DataFrame, keys: list[str], n: int = 3, fields: tuple[str, ...] = ("Name", "Title", "Email")) -> DataFrame:
    """Columns 'Person 1 Name' ... as a row a person; blank names go."""
    people = [F.struct(F.lit(i).alias("person_no"), *[(F.col(f"`Person {i} {f}`") if f"Person {i} {f}" in df.columns else F.lit(None).cast("string")).alias(f.lower()) for f in fields]) for i in range(1, n + 1)]
    return df.select(*keys, F.explode(F.array(*people)).alias("p")).select(*keys, "p.*").where(F.trim(F.coalesce(F.col(fields[0].lower()), F.lit(""))) != "")


def flat_people(nested: DataFrame, keys: list[str], people: str, status: str, wanted: str = "accepted") -> DataFrame:
    """People nested in rows of a wanted status (null counts as it) as a row each, with their place in the list; lists in
    their fields become text."""
    from pyspark.sql.types import ArrayType

    fields = nested.schema[people].dataType.elementType.fields
    p = nested.where(F.coalesce(status, F.lit(wanted)) == wanted).select(*keys, F.posexplode(people).alias("place", "p"))
    return p.select(*keys, "place", *[(F.array_join(f"p.{f.name}", ";") if isinstance(f.dataType, ArrayType) else F.col(f"p.{f.name}")).alias(f.name) for f in fields])


def import_text(df: DataFrame, text: str, columns: list[str], required: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of pasted CSV text by its header in any case: (rows that have every required column, per key the number
    taken and skipped). Quotes may hold commas, quotes and newlines; a quote that is never closed ends with its line."""
    record = r'((?:[^"\n]++|"(?:[^"]++|"")*+"|")++)'
    lines = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), F.lit(record), F.lit(1)), lambda x: F.trim(x) != "")
    cell = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
    cells = lambda x: F.transform(F.regexp_extract_all(x, F.lit(cell), F.lit(1)), lambda v: F.trim(F.replace(F.regexp_replace(v, '^"|"$', ""), F.lit('""'), F.lit('"'))))
    rows = df.select(key, cells(F.get(lines, F.lit(0))).alias("h"), F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("n", "line"))
    names = F.transform("h", lambda x: F.lower(F.regexp_replace(x, "^\ufeff", "")))
    got = rows.select(key, "n", cells(F.col("line")).alias("c"), names.alias("h"))
    pick = lambda c: F.coalesce(F.get("c", F.array_position("h", F.lit(c)).cast("int") - 1), F.lit(""))
    got = got.select(key, "n", *[pick(c).alias(c) for c in columns])
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.col(c) != "")
    got = got.withColumn("ok", ok)
    return got.where("ok").drop("ok"), got.groupBy(key).agg(F.count_if("ok").alias("taken"), F.count_if(~F.col("ok")).alias("skipped"))


def keyed_last(side: DataFrame, key: str, seq: str) -> DataFrame:
    """A side file's rows as a table by key: the last row of each counts."""
    from ..operators.merge import last_by

    return last_by(side.where(F.col(key).isNotNull()), [key], [F.col(seq)])


def append_json(df: DataFrame, path: str) -> None:
    """More rows of a JSON side table; rows there stay as they are."""
    df.write.mode("append").json(path)


def replaced(df: DataFrame, path: str) -> None:
    """The next version of a table, whole or not at all: `current` gives the old one until it is there, then the new."""
    from .versions import Versions

    Versions(df.sparkSession, path).update(lambda _: df)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """A table's latest version; None before there is one."""
    from .versions import Versions

    return Versions(spark, path).read()


def reports(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    """Reports of a folder, a JSON object a file: their fields, lists as text, and the file's stem."""
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)_match_report\.json$", 1)
    return r.withColumn("stem", stem).withColumns({c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ") for c in lists})


def registry(df: DataFrame, fields: dict[str, list[str]], first: str) -> DataFrame:
    """A registry's fields by the first of their possible headers that has a value, in any case; the field `first` falls
    back to the first column. Rows without it go."""
    have = {c.strip().lower(): c for c in df.columns}

    def pick(names: list[str]) -> Column:
        found = [T.blank_to_null(F.col(f"`{have[n.lower()]}`").cast("string")) for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    cols = {f: pick(names) for f, names in fields.items()}
    cols[first] = F.coalesce(cols[first], T.blank_to_null(F.col(f"`{df.columns[0]}`").cast("string")))
    return df.select(*[c.alias(f) for f, c in cols.items()]).where(F.col(first).isNotNull())


def embedded_json(df: DataFrame, html: str, marker: str, schema: str, name: str = "data") -> DataFrame:
    """Pages with the object that a script assigns to a marker, parsed; null where there is none or it does not parse."""
    import re

    blob = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?s)" + re.escape(marker) + r"\s*=\s*(\{.*?\});\s*</script>", 1)
    return df.withColumn(name, F.from_json(F.nullif(blob, F.lit("")), schema))


#: Cards of a result page, and their fields.
CARD = r'(?is)<article[^>]*data-automation="normalJob"[^>]*>(.*?)</article>'
CARD_FIELDS = {"role_title": "jobTitle", "company_name": "jobCompany", "location": "jobLocation", "posted_relative": "jobListingDate"}


def article_cards(df: DataFrame, html: str) -> DataFrame:
    """Rows of a result page whose cards are articles; cards without a company go."""
    card = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(CARD), F.lit(1))).alias("card")
    keep = [c for c in df.columns if c != html]
    c = df.select(*keep, card)
    fields = [F.trim(F.regexp_extract("card", rf'data-automation="{mark}"[^>]*>([^<]+)<', 1)).alias(f) for f, mark in CARD_FIELDS.items()]
    return c.select(*keep, *fields, F.regexp_extract("card", r'href="(/job/[^"]+)"', 1).alias("path")).where("company_name <> ''")


def documents_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a folder's .txt, .md and .docx files: path and text; other files give null."""
    import io
    import re
    import zipfile
    from collections.abc import Iterator
    from html import unescape

    import pyarrow as pa

    def text(name: str, raw: bytes) -> str | None:
        if re.search(r"\.(txt|md)$", name, re.I):
            return raw.decode("utf-8", "replace")
        if not re.search(r"\.docx$", name, re.I):
            return None
        try:
            xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
        return "\n".join(unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", re.sub(r"<w:tab/>", "<w:t>\t</w:t>", p), re.S))) for p in paragraphs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(p, r) for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def keep_longest(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The longest value of each key, the first of equals."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.length(F.coalesce(F.col(value), F.lit(""))), -F.col(seq))).alias("r")).select(key, "r.*")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def unexpired(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached pages within their time to live, keyed by the URL's hash."""
    return cache.withColumn("url_key", F.sha2("url", 256)).where(F.col("fetched_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def front_matter(df: DataFrame, text: str) -> DataFrame:
    """A document's head between dashes as a map, and its body; without a head all is body."""
    rx = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
    head = F.regexp_extract(text, rx, 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    items = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # the last of equal keys counts
    items = F.filter(items, lambda x, i: F.size(F.filter(F.slice(items, i + 2, F.size(items)), lambda y: y["k"] == x["k"])) == 0)
    return df.withColumn("meta", F.map_from_entries(items)).withColumn("body", F.when(F.col(text).rlike(rx), F.regexp_replace(F.regexp_extract(text, rx, 2), r"^\s+|\s+$", "")).otherwise(F.col(text)))


def cards(df: DataFrame, html: str) -> DataFrame:
    """Rows of a result page: a card each, fields by pattern; cards without an identifier go."""
    chunk = F.explode(F.slice(F.split(html, "<li>"), F.lit(2), F.size(F.split(html, "<li>")))).alias("chunk")
    grab = lambda rx: T.strip_tags(F.regexp_extract("chunk", rx, 1))
    c = df.select(*[x for x in df.columns if x != html], chunk)
    ident = F.regexp_extract("chunk", r"jobPosting:(\d+)", 1)
    return c.where(ident != "").select(
        *[x for x in df.columns if x != html], ident.alias("job_id"),
        grab(r'(?s)subtitle"[^>]*>(.*?)</h4').alias("company"), grab(r'(?s)card__title"[^>]*>(.*?)</h3').alias("role_title"), grab(r'(?s)location"[^>]*>(.*?)</span').alias("location"),
        F.replace(F.regexp_extract("chunk", r'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:]{5,8})?)"', 1), F.lit(" "), F.lit("T")).alias("posted_date"),
    )


def json_ld(df: DataFrame, html: str, schema: str) -> DataFrame:
    """Structured data blocks of a page, one row each, parsed; what does not parse goes."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return df.withColumn("ld", F.explode(F.transform(blocks, lambda b: F.from_json(b, schema)))).where(F.col("ld").isNotNull())


def pasted_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pasted lists: lines of pipes are fields; else an anchor line (a date or time ago) closes a block whose last
    two lines before it are title and company."""
    from ..operators.ordered import lines, previous_two

    l = lines(df, key, text).withColumn("value", F.trim("value")).where("value <> ''")
    parts = F.split("value", r"\s*\|\s*")
    piped = l.where(F.size(parts) >= 3).select(key, "line", F.get(parts, F.lit(0)).alias("role_title"), F.get(parts, F.lit(1)).alias("company"), F.get(parts, F.lit(2)).alias("location"))
    anchor = F.lower("value").rlike(r"\b(ago|today|yesterday)\b")
    blocks = previous_two(l.where(F.size(parts) < 3), key, "line", anchor, "value").select(key, "line", F.col("prev2").alias("role_title"), F.col("prev1").alias("company"), F.lit("").alias("location"))
    return piped.unionByName(blocks)


def directory_state(spark: SparkSession, path: str) -> DataFrame:
    """A folder as a table: state and key from each file's name, 'state_key.md'."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return f.select("path", F.regexp_extract(name, "^([^_]+)_", 1).alias("state"), F.regexp_replace(name, "^[^_]+_", "").alias("key"), "modificationTime", "length")


def dictionary(df: DataFrame, label: str = "preferredLabel", alternatives: str = "altLabels", deny: list[str] = ()) -> DataFrame:
    """(alias, label) of a dictionary whose cells list alternatives by line; short, numeric and denied aliases go."""
    names = F.concat(F.array(F.col(label)), F.split(F.coalesce(F.col(alternatives), F.lit("")), "\n"))
    a = df.select(F.explode(F.transform(names, lambda x: F.lower(F.trim(x)))).alias("alias"), F.col(label).alias("label"))
    keep = (F.length("alias") >= 3) & ~F.col("alias").rlike(r"^\d+$")
    return a.where(keep & ~F.col("alias").isin(list(deny)) if deny else keep).dropDuplicates(["alias", "label"])

"""Table functions for SQL: lines of texts, sections that headers open, rows of pasted lists.

`text_lines` is a function of a text, for LATERAL. The others take rows of (key, line, value) as a table that is partitioned by
key and ordered by line, so that Spark deals and sorts them and a call sees one key's lines in order and holds a line or
two of them:

    SELECT * FROM line_sections(TABLE(lines) PARTITION BY key ORDER BY line)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

LINES = r"SELECT pos, col FROM (SELECT posexplode(split(coalesce(s, ''), '\n')))"
ANCHOR = re.compile(r"\b(ago|today|yesterday)\b")
PIPE = re.compile(r"\s*\|\s*")
#: Characters from which a line is no header.
HEADER = 20


def line_sections(header: int = HEADER):
    """Lines under the last header (a line of fewer characters than `header`) above them, with the header's number; lines above
    the first have none and the number 0."""

    class LineSections:
        def __init__(self):
            self.section, self.number = None, 0

        def eval(self, row: Row) -> Iterator[tuple]:
            if row["value"] is not None and len(row["value"]) < header:
                self.section, self.number = row["value"], self.number + 1
            else:
                yield row["key"], row["line"], row["value"], self.section, self.number

    return udtf(LineSections, returnType="key string, line int, value string, section string, section_no int")


def pasted_rows():
    """Pasted lists: a line of three fields between pipes is a row; else an anchor line (a date or time ago) closes a block
    whose last two lines before it are title and company. Blank lines do not count."""

    class PastedRows:
        def __init__(self):
            self.before: tuple = (None, None)

        def eval(self, row: Row) -> Iterator[tuple]:
            value = (row["value"] or "").strip(" ")
            if not value:
                return
            parts = PIPE.split(value)
            if len(parts) >= 3:
                yield row["key"], row["line"], parts[0], parts[1], parts[2]
                return
            if ANCHOR.search(value.lower()):
                yield row["key"], row["line"], self.before[0], self.before[1], ""
            self.before = self.before[1], value

    return udtf(PastedRows, returnType="key string, line int, role_title string, company string, location string")


def register(spark: SparkSession) -> list[str]:
    """Register them in this session; their names."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_lines(s STRING) RETURNS TABLE (line INT, value STRING) RETURN {LINES}")
    spark.udtf.register("line_sections", line_sections())
    spark.udtf.register("pasted_rows", pasted_rows())
    return ["text_lines", "line_sections", "pasted_rows"]

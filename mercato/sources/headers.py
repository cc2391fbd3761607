"""Export headers: one small matcher, fed by declarative rules, for all three readers.

A reader states which column names it knows (exact names, prefixes) and which
header sets identify a kind of export.  The matcher answers three questions:
which canonical column a header means, which kind a header line belongs to, and
which separator splits a line into the most known columns.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

SEPARATORS = (",", ";", "\t")


@dataclass(frozen=True)
class Kind:
    """A kind of export: at least ``hits`` of ``marks`` and all of ``needs`` stand in its header; higher ``rank`` wins."""

    name: str
    marks: frozenset[str]
    hits: int = 1
    needs: frozenset[str] = frozenset()
    rank: int = 0


@dataclass(frozen=True)
class Names:
    """Known columns of a reader: exact header -> column, and header prefix -> column (the longest prefix counts)."""

    exact: Mapping[str, str]
    prefixes: Mapping[str, str] = field(default_factory=dict)

    def column(self, header: str) -> str | None:
        name = header.strip().strip('"')
        by_prefix = max((p for p in self.prefixes if name.startswith(p)), key=len, default=None)
        return self.exact.get(name) or self.prefixes.get(by_prefix)

    def known(self, headers: Iterable[str]) -> int:
        return sum(self.column(h) is not None for h in headers)


def kind_of(headers: Iterable[str], kinds: Iterable[Kind], default: str) -> str:
    have = {h.strip() for h in headers}
    fits = [(k.rank, len(have & k.marks), k.name) for k in kinds if len(have & k.marks) >= k.hits and k.needs <= have]
    return max(fits, key=lambda x: x[:2])[2] if fits else default


def fields(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), [])


def separator(line: str, names: Names) -> str:
    """The separator that yields the most known columns, then the most columns."""
    return max(SEPARATORS, key=lambda s: (names.known(fields(line, s)), len(fields(line, s))))


def _first_line(spark: SparkSession, path: str, *facts):
    """Facts about the first line that is not blank (a document may be one line of any length, so not the line itself)."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1)
    return lines.select(F.substring(F.ltrim("value"), 1, 200).alias("begin"), *facts).first()


def is_json_document(spark: SparkSession, path: str) -> bool:
    """One JSON document per file (an array, or an object over several lines), as against one record per line."""
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    closed = F.length(F.regexp_replace(bare, "[^{]", "")) == F.length(F.regexp_replace(bare, "[^}]", ""))
    first = _first_line(spark, path, closed.alias("closed"))
    if first is None or first.begin.startswith("[") or not first.closed:
        return True
    if not re.match(r'\{\s*"(?:data|results)"\s*:\s*\[', first.begin):
        return False
    # an array in an object on one line: a document if it stands alone in its file, else one of many pages
    text = spark.read.text(path)
    file = text.metadataColumn("_metadata")["file_path"]
    per_file = text.where(F.trim("value") != "").groupBy(file.alias("file")).count()
    return per_file.agg(F.max("count")).first()[0] == 1


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files: one a line, or the elements of a document's array, which many tasks read.

    Documents of another form (one object over several lines) are read whole, one task a file.
    """
    if not is_json_document(spark, path):
        return spark.read.json(path)
    from mercato.sources.ranges import json_lines
    folder = json_lines(spark, path)
    if folder is None:
        return spark.read.option("multiLine", True).json(path)
    return spark.read.json(folder)


def looks_like_json(spark: SparkSession, path: str) -> bool:
    first = _first_line(spark, path)
    return first is not None and first.begin[:1] in ("[", "{")

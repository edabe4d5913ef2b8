"""Files as a source: metadata scans, text extraction with a status for each file."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.functions import paths, text
from trovesift.sources.readers import READERS

MOST_TEXT = 50 << 20
PROBE = 8192
#: Folders below the root that a scan goes down at most.
DEEPEST = 64
SCHEMA = "path string, status string, text string, error string"


def scan(spark: SparkSession, root: str, ignored=(), roots=(), prune: bool = False, deepest: int = DEEPEST) -> DataFrame:
    """(path, name, extension, size, modified_at, kind, verdict, sensitivity) of the files below `root`; contents aren't read.

    Files more than `deepest` folders down are left out and, with `prune`, those in excluded folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    path = F.regexp_replace("path", "^file:(?://)?", "")
    files = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    name = paths.base_name(F.col("path"))
    extension = F.when(name.rlike(r".\.[^.]+$"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).otherwise("")
    top = F.regexp_replace(F.lit(root.rstrip("/")), "^file:(?://)?", "")
    depth = F.size(F.split(F.col("path"), "/")) - F.size(F.split(top, "/")) - 1
    found = files.where(depth <= deepest).select(
        "path", name.alias("name"), extension.alias("extension"), "size", "modified_at", paths.kind_of(extension).alias("kind"),
        paths.validate(F.col("path"), F.col("size"), ignored, roots).alias("verdict"), paths.sensitivity(F.col("path")).alias("sensitivity"),
    )
    folder = F.concat(paths.directory(F.col("path")), F.lit("/"))
    return found.where(paths.validate(folder, F.lit(0), ignored, roots) != "exclude") if prune else found


def looks_like_text(data: bytes) -> bool:
    """No NUL among the first bytes, and at most 2 % odd control characters."""
    head = data[:PROBE]
    odd = sum(b < 9 or 13 < b < 32 or b == 127 for b in head)
    return 0 not in head and odd * 50 <= len(head)


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def plain_text(data: bytes) -> tuple[str, str | None, str | None]:
    """(status, text, error) of a text file."""
    if len(data) > MOST_TEXT:
        return "too_large", None, f"File size {len(data)} exceeds configured limit {MOST_TEXT}"
    if not looks_like_text(data):
        return "unsupported", None, "Payload is not text"
    return "ok", decode(data), None


#: Extractors by extension or, beyond these, by kind. Formats that need a tool of their own (images, old office files) are registered by the user; without one they are "unsupported".
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, str | None, str | None]]] = {"text": plain_text, "code": plain_text, "markdown": plain_text, **READERS}


def extract(spark: SparkSession, root: str, extractors: dict | None = None) -> DataFrame:
    """(path, status, text, error): each file by its kind's extractor, cleaned; a failure is a row, not an exception."""
    known = dict(EXTRACTORS if extractors is None else extractors)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by = F.when(extension.isin(*known), extension).otherwise(paths.kind_of(extension))
    large = files.where(F.col("length") > MOST_TEXT).select("path", F.col("length").alias("size"))  # never loaded
    files = files.where(F.col("length") <= MOST_TEXT).select("path", by.alias("kind"), "content")

    def run(batches):
        for rows in batches:
            out = []
            for path, kind, data in zip(rows.path, rows.kind, rows.content, strict=True):
                extractor = known.get(kind)
                if extractor is None:
                    out.append((path, "unsupported", None, f"Extension {path.rpartition('.')[2]} is not supported by extractor"))
                    continue
                try:
                    out.append((path, *extractor(bytes(data))))
                except Exception as error:  # a broken file is a failure of its own
                    out.append((path, "failed", None, str(error)[:500]))
            yield pd.DataFrame(out, columns=["path", "status", "text", "error"])

    limit = F.concat(F.lit("File size "), "size", F.lit(f" exceeds configured limit {MOST_TEXT}"))
    found = files.mapInPandas(run, SCHEMA).unionByName(large.select("path", F.lit("too_large").alias("status"), F.lit(None).cast("string").alias("text"), limit.alias("error")))
    empty = (F.col("status") == "ok") & (F.length("text") == 0)
    cleaned: Column = text.clean(F.col("text"))
    return found.select("path", F.when(empty, "empty").otherwise(F.col("status")).alias("status"), cleaned.alias("text"), "error")


def load_ignore(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file."""
    return paths.parse_ignore("\n".join(r.value for r in spark.read.text(path).collect()))

"""File listings and records kept beside files."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .keyed import KeyedTable


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def scan_files(spark: SparkSession, roots: list[str], extensions: set[str] | None = None) -> DataFrame:
    """(path, size, mtime, ext) of all files under the roots; a root that can't be reached is empty. Contents aren't read."""
    out = spark.createDataFrame([], "path string, size long, mtime timestamp, ext string")
    for root in roots:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        except (AnalysisException, Py4JJavaError):  # not there, or not reachable
            continue
        out = out.unionByName(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), extension(F.col("path")).alias("ext")))
    return out.filter(F.col("ext").isin(sorted(extensions))) if extensions else out


def union_roots(*listings: DataFrame) -> DataFrame:
    """One listing of several roots; duplicates stay."""
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out


def with_sidecar(files: DataFrame, sidecars: DataFrame, lines: int = 300, chars: int = 30_000, most_bytes: int | None = None) -> DataFrame:
    """Adds `sidecar`: the text of `{path}.meta`, capped by lines and characters or by bytes, null where there is none."""
    text = F.col("text")
    capped = T.capped_lines(text, lines, chars) if most_bytes is None else T.capped_bytes(text, most_bytes)
    s = sidecars.select(F.col("path").alias("meta_path"), capped.alias("sidecar"))
    return files.join(s, F.concat("path", F.lit(".meta")) == F.col("meta_path"), "left").drop("meta_path")


def memory_records(rated: DataFrame, captured: str) -> DataFrame:
    """(day, file_stem, value) for rows (hash, file_path, user_rating, user_rating_date, description or null)."""
    # Fixed value: the wording is part of the format.
    note = F.lit("# Note:\nOriginal file was not available; captured metadata is limited.\n")
    head = F.concat_ws("\n", F.concat(F.lit("Rating: "), F.col("user_rating").cast("string")), F.concat(F.lit("Soft Hash: "), "hash"), F.concat(F.lit("File Path: "), "file_path"), F.concat(F.lit("File Name: "), T.base_name(F.col("file_path"))), F.lit(f"Captured At: {captured}"), F.lit(""))
    return rated.select(F.coalesce(F.to_date("user_rating_date"), F.to_date(F.lit(captured))).cast("string").alias("day"), F.col("hash").alias("file_stem"), F.concat(head, F.lit("\n"), F.coalesce("description", note)).alias("value"))


def write_memory(records: DataFrame, path: str, batch: str | None = None) -> bool:
    """Dated folders of text records, one per key: writing again replaces, a batch that is named is written once.

    Only the buckets that the records fall into are replaced, when the job succeeds. False if the batch was there.
    """
    table = KeyedTable(records.sparkSession, path, "day string, file_stem string, value string", ["file_stem"], ("day",), 16, "json")
    return table.upsert(records, batch or uuid.uuid4().hex)


def parse_memory(records: DataFrame) -> DataFrame:
    """(day, file_stem, rating, description): line 1 holds the rating; records without one are skipped."""
    first = F.substring_index("value", "\n", 1)
    rest = F.when(F.instr("value", "\n") > 0, F.trim(F.expr("substring(value, instr(value, chr(10)) + 1)"))).otherwise("")
    rating = F.regexp_extract(first, r"^Rating:\s*(\S+)", 1).try_cast("double")
    return records.select("day", "file_stem", rating.alias("rating"), F.regexp_replace(rest, r"^\s+|\s+$", "").alias("description")).filter("rating IS NOT NULL")


def vocabulary(groups: DataFrame, column: str) -> DataFrame:
    """(tag, vocabulary): one level of nesting taken away; the vocabulary's id depends on the set of its tags."""
    flat = groups.select(F.explode(column).alias("tag"))
    version = flat.agg(F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("tag")), "\n")), 1, 12).alias("vocabulary"))
    return flat.crossJoin(F.broadcast(version))  # one row

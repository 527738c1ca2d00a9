"""Several tables in one CSV: each section begins with a header of table.column cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cell(c: Column) -> Column:
    """Quoted only where a separator, quote or line end makes it necessary; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\\r\\n\\\\]'), F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def export_csv(tables: dict[str, DataFrame], excluded: frozenset[str] = frozenset(), order: dict[str, str] | None = None) -> DataFrame:
    """(section, key, line): a header line (key null) and a line per row for every table; sort by section and key."""
    out = None
    for section, (name, df) in enumerate(tables.items()):
        columns = [c for c in df.columns if c not in excluded]
        key = F.col((order or {}).get(name, df.columns[0])).cast("long")
        head = df.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(None).cast("long").alias("key"), F.lit(",".join(f"{name}.{c}" for c in columns)).alias("line"))
        rows = df.select(F.lit(section).alias("section"), key.alias("key"), F.concat_ws(",", *[_cell(F.col(c)) for c in columns]).alias("line"))
        part = head.unionByName(rows)
        out = part if out is None else out.unionByName(part)
    return out


def import_csv(lines: DataFrame, schemas: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """lines: (line_no, line). One frame per known table, of its known columns; the rest is skipped.

    A header is a line whose cells all begin with a known or unknown table name and a dot, as the first cell of
    a section; data rows follow their header. Headers are few: they are found first and joined by range of lines.
    """
    name = F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)\.[A-Za-z_][A-Za-z0-9_]*(?:,\1\.[A-Za-z_][A-Za-z0-9_]*)*$", 1)
    heads = lines.withColumn("table", name).filter(F.col("table") != "").select(F.col("line_no").alias("begins"), F.col("line").alias("header"), "table")
    heads = heads.withColumn("ends", F.lead("begins").over(W.orderBy("begins")))  # a row per section
    out = {}
    for h in heads.collect():  # the sections of one export: as many as there are tables
        if h.table not in schemas:
            continue
        given = [c.split(".", 1)[1] for c in h.header.split(",")]
        body = lines.filter((F.col("line_no") > h.begins) & (F.lit(h.ends is None) | (F.col("line_no") < F.lit(h.ends or 0))))
        cells = F.from_csv("line", F.lit(", ".join(f"`{c}` string" for c in given)), {"escape": '"', "unescapedQuoteHandling": "BACK_TO_DELIMITER", "emptyValue": "", "nullValue": "\u0000"})
        known = [c for c in given if c in schemas[h.table]]
        body = body.select(cells.alias("r")).select(*[typed(F.col("r")[c], schemas[h.table][c]).alias(c) for c in known])
        out[h.table] = out[h.table].unionByName(body) if h.table in out else body
    return out


def typed(c: Column, kind: str) -> Column:
    """Empty is null except for strings; timestamps may lack a fraction."""
    if kind == "string":
        return F.coalesce(F.replace(c, F.lit("\\\\"), F.lit("\\")), F.lit(""))
    return F.nullif(c, F.lit("")).try_cast(kind)

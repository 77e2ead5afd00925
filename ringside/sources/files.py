"""Scans: delimited text with checked headers, ledgers, Markdown tables, pinned Parquet, blobs."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which sources write the fields, in the order in which they are looked for, without case and underscores.
ALIASES = {
    "event_date": ("date", "fight_date", "event_date"),
    "red_name": ("red_fighter", "red_fighter_name", "r_fighter", "red", "red fighter"),
    "blue_name": ("blue_fighter", "blue_fighter_name", "b_fighter", "blue", "blue fighter"),
    "outcome": ("winner", "fight_outcome", "result", "outcome"),
    "rounds": ("no_of_rounds", "scheduled_rounds", "rounds", "time_format"),
    "round_no": ("finish_round", "round", "ending_round"),
    "method": ("method", "finish", "result_method"),
    "event_name": ("event", "event_name"),
    "division": ("weight_class", "division", "bout_type"),
    "location": ("location", "event_location"),
    "clock": ("time", "finish_round_time", "finish_time"),
}


def _folded(name: str) -> str:
    return name.lower().replace("_", "").replace(" ", "").lstrip("﻿")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, line (physical, of the record's first), number (of the record in its file) and text of every record.

    Files are read by splits. A split counts its lines and quotes; sums over the splits before it tell at which line it
    begins and whether inside quotes, and so which of its lines begin a record. Only records of several lines, and the
    last lines of splits, are brought together; all others stay where they are read. Lines without a record, and those
    with nothing in them outside quotes, are left out.
    """
    meta = {n: F.col(f"_metadata.{m}") for n, m in (("file", "file_path"), ("block", "file_block_start"))}
    raw = spark.read.text(path).select("value", *(c.alias(n) for n, c in meta.items()), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    own = ["file", "block"]
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*own).orderBy("at")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    sums = raw.groupBy(*own).agg(F.count("*").alias("lines"), F.sum("quotes").alias("odd"))
    sums = sums.select(*own, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("lines", "odd")))
    placed = raw.join(sums, own)
    opened = F.col("odd") + F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"line": F.col("lines") + F.row_number().over(here), "begins": opened % 2 == 0})
    starts = placed.groupBy(*own).agg(F.max(F.when(F.col("begins"), F.col("line"))).alias("last"), F.count_if("begins").alias("begun"))
    starts = starts.select(*own, F.max("last").over(before).alias("last"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("begun"))
    told = placed.join(starts, own).withColumns({
        "first": F.coalesce(F.max(F.when(F.col("begins"), F.col("line"))).over(so_far), F.col("last")), "number": F.col("begun") + F.count_if("begins").over(so_far),
        "alone": F.col("begins") & F.coalesce(F.lead("begins").over(here), F.lit(False)),
    })
    whole = told.where("alone").select("file", "line", "number", F.col("value").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    parts = told.where("NOT alone").groupBy("file", F.col("first").alias("line")).agg(F.max("number").alias("number"), text.alias("text"))
    return whole.unionByName(parts).where("trim(text) <> ''")


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, trimmed, a digest of the record's values as record_id, and line, where it begins in its file.

    Quotes and line breaks inside them are kept; a file of any size is read in parallel. Every file has the same header.
    Equal records have one id, which first_of_duplicates() then collapses.
    """
    found = records(spark, path)
    header = found.where("number = 1").select("text").distinct().collect()  # a row for each different header
    if len(header) != 1:
        raise ValueError("no header" if not header else "the files have different headers")
    names = [c.strip() for c in next(csv.reader([header[0].text.lstrip("\ufeff")], delimiter=sep))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = found.where("number > 1").select("line", F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}).alias("r"))
    rows = rows.select(*(F.trim(F.col(f"r.c{i}")).alias(n) for i, n in enumerate(names)), "line")
    return rows.withColumn("record_id", F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))), 256))


def aliased(rows: DataFrame, required: tuple[str, ...] = ("event_date", "red_name", "blue_name", "outcome")) -> DataFrame:
    """The semantic fields by whichever of their names the header has; null where it has none, an error if it's required."""
    there = {_folded(c): c for c in rows.columns}
    found = {field: next((there[_folded(n)] for n in names if _folded(n) in there), None) for field, names in ALIASES.items()}
    missing = [f for f in required if found[f] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    fields = [(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()]
    return rows.select("record_id", *(["line"] if "line" in rows.columns else []), *fields)


def exact_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A decision file whose header has to be just these columns, in this order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    header = spark.read.text(path).limit(1).first()
    if header is None or header[0].lstrip("﻿").strip().split(",") != columns:
        raise ValueError("the header is not the agreed one")
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"')


def ledger(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def markdown_table(spark: SparkSession, path: str, columns: list[str], prefix: str = "review-") -> DataFrame:
    """Rows '| prefix... | ... |' of Markdown tables as columns; a row with another number of cells fails."""
    lines = spark.read.text(path).where(F.trim("value").startswith(f"| {prefix}"))
    cells = F.split(F.regexp_replace(F.trim("value"), r"^\|\s*|\s*\|$", ""), r"\s*\|\s*")
    checked = F.when(F.size(cells) == len(columns), cells).otherwise(F.raise_error(F.concat(F.lit("not a row: "), "value")))
    return lines.select(checked.alias("cells")).select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def blobs(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """Files with their digest and size; one beyond most_bytes fails."""
    rows = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length") <= most_bytes, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path")).cast("long"))
    return rows.select("path", size.alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def pinned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet table by an explicit list of columns: no other is read."""
    return spark.read.parquet(path).select(*columns)


def redacted_locator(url: F.Column) -> F.Column:
    """A locator without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def kept_headers(headers: F.Column, names: tuple[str, ...] = ("content-type", "content-length", "etag", "last-modified", "date"), most: int = 512) -> F.Column:
    """A map of response headers, a few of them, their values cut."""
    return F.transform_values(F.map_filter(headers, lambda k, v: F.lower(k).isin(*names)), lambda k, v: F.left(v, F.lit(most)))

"""Sources: applications as CSV, decision logs as JSON lines, images and archives as binary files, registry pages as HTML."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import US_PLACES
from ..operators.batch import base_name, is_image

ALIASES = {
    "application_id": ("id", "application"), "image": ("file", "filename", "image_file", "images"), "brand_name": ("brand",), "class_type": ("class", "type"),
    "alcohol_content": ("alcohol", "abv"), "net_contents": ("volume", "net"), "bottler_name_address": ("bottler",), "country_of_origin": ("country", "origin"),
}
LOG_SCHEMA = """
    ts timestamp, job string, source string, `index` int, application_id string, image string, decision string, key string, label_decision string, overall string, asked string,
    prompts array<struct<key:string,what:string,verdict:string,question:string,left:array<string>,right:array<string>,asked:boolean>>,
    fields array<struct<key:string,verdict:string,expected:string,found:string,note:string>>, read_confidence double, words_read int, reader string, _corrupt string
"""
LARGEST_MEMBER, MOST_MEMBERS = 50_000_000, 2_000


def separator(spark: SparkSession, path: str) -> str:
    """The commonest of comma, semicolon and tab in the header line. Only that line is read to the driver."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(",;\t", key=lambda c: (line.count(c), -",;\t".index(c)))


def read_applications(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Applications with their headers mapped; cells may hold line breaks; blank rows are dropped. (SRC1, SRC2, SRC9)"""
    from ..operators.batch import map_headers

    options = {"header": True, "sep": separator(spark, path), "multiLine": True, "quote": '"', "escape": '"', "encoding": encoding, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    rows = map_headers(spark.read.options(**options).csv(path), ALIASES)
    return rows.na.drop("all").na.fill("")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, record, header, cells) of CSV files, one file at a time: UTF-8 with or without a mark, else Latin-1; the commonest separator of its header line."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                text = content.decode("utf-8-sig")
            except UnicodeDecodeError:
                text = content.decode("latin-1")
            first = text.split("\n", 1)[0]
            parsed = list(csv.reader(io.StringIO(text, newline=""), delimiter=max(",;\t", key=lambda c: (first.count(c), -",;\t".index(c)))))  # noqa: B023
            header = [h.strip() for h in parsed[0]] if parsed else []
            rows = [(path, i, header, [c.strip() for c in cells]) for i, cells in enumerate(parsed[1:], 1) if any(c.strip() for c in cells)]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "record", "header", "cells"])


def read_application_files(spark: SparkSession, folder: str) -> DataFrame:
    """Applications of all CSV files of a folder, each in its own encoding and with its own separator and headers. (SRC1, SRC2)

    Columns: file, record (from 1, blank ones counted) and the keys of ALIASES; a key that a file lacks is empty. Of several headers of a key the first counts. A file is
    read by one task; a row that is shorter than the header has empty cells at its end, further cells of a longer one are left out.
    """
    from ..functions.text import header_key

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True).load(folder)
    rows = rows.select("path", "content").mapInArrow(_records, "file string, record long, header array<string>, cells array<string>")
    rows = rows.withColumn("header", F.transform("header", header_key))

    def cell(key: str, others: tuple[str, ...]) -> Column:
        names = F.array(*[header_key(F.lit(n)) for n in (key, *others)])
        places = F.filter(F.transform("header", lambda h, i: F.when(F.array_contains(names, h), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get("cells", F.get(places, F.lit(0))), F.lit("")).alias(key)

    return rows.select("file", "record", *[cell(k, others) for k, others in ALIASES.items()])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): lines of text files with their number in the file, from 1, however the files are split or packed into tasks.

    A split's lines keep their order in it, and splits are ordered by where they begin: a line's number is its place in the split after the lines of the splits before.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    sizes = rows.groupBy("file", "_split").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_id"))
    return rows.withColumn("_own", own).join(sizes.select("file", "_split", before.alias("_before")), ["file", "_split"]).select("file", (F.col("_before") + F.col("_own")).alias("line"), "text")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Decision records with a fixed schema and their place: file, line and seq, which orders by both. Malformed lines have _corrupt. Blank lines have no row. (SRC8, JS2)"""
    rows = numbered_lines(spark, path).where("trim(text) <> ''")
    files = rows.select("file").distinct().withColumn("_file", F.row_number().over(Window.orderBy("file")))
    parsed = F.from_json("text", LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.join(files, "file").select("file", "line", F.expr("(_file - 1L) * 1099511627776L + line").alias("seq"), parsed.alias("r"))
    return rows.select("r.*", "file", "line", "seq")


def sound(log: DataFrame) -> DataFrame:
    return log.where("_corrupt is null and decision is not null").drop("_corrupt")


def malformed(log: DataFrame) -> DataFrame:
    return log.where("_corrupt is not null").select("file", "line", "seq", "_corrupt")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of archives; one that is broken, encrypted, too large or too full gives a row with an issue instead."""
    names = ("path", "content", "issue")
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows: list[tuple] = []
            if not path.lower().endswith(".zip"):
                rows.append((path, content, None))
            else:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        members = [m for m in archive.infolist() if not m.is_dir()]
                        if len(members) > MOST_MEMBERS:
                            rows.append((path, None, "too many files"))
                            members = []
                        for m in members:
                            issue = "encrypted" if m.flag_bits & 1 else "too large" if m.file_size > LARGEST_MEMBER else None
                            rows.append((m.filename, None if issue else archive.read(m), issue))
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    rows.append((path, None, "not a readable archive"))
            for row in rows:  # one at a time, so that an archive is never held twice
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.string()))], names)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files (name, path, digest, size, issue) of folders and of the archives in them; empty files outside archives are left out by Spark. (SRC4, SRC5)"""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(_members, "path string, content binary, issue string")
    size = F.coalesce(F.length("content"), F.lit(0))
    issue = F.coalesce("issue", F.when(~is_image(F.col("path")), "not an image"), F.when(size == 0, "empty"))
    return found.select(base_name(F.col("path")).alias("name"), "path", F.sha2("content", 256).alias("digest"), size.alias("size"), issue.alias("issue"))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags break lines, other tags become blanks. (SRC11)"""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|nav|head|body|html)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def labelled_field(text: Column, label: str) -> Column:
    """What follows a label and a colon on its line. (SRC12)"""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*(.*)$", 1)), F.lit(""))


#: Kinds of product by the words of their description, in this order.
KINDS = (("spirits", r"(?i)whisk|vodka|\bgin\b|\brum\b|tequila|brandy|liqueur|spirit"), ("wine", r"(?i)wine|champagne|\bport\b|sherry"), ("beer", r"(?i)beer|\bale\b|lager|stout|malt"))


def kind_of(description: Column) -> Column:
    """(SF22)"""
    out = F.lit("other")
    for kind, pattern in reversed(KINDS):
        out = F.when(description.rlike(pattern), kind).otherwise(out)
    return out


def registry_rows(rows: DataFrame) -> DataFrame:
    """Rows of a registry export (id, brand, description, origin) that can be used, with id and texts trimmed, kind and imported.

    An id is digits, with or without single quotes around it; the kind is known and the brand not blank. Null counts as
    blank. A row with a blank origin isn't imported. (FLT11, SF23)
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    tidy = rows.withColumns({c: clean(c) for c in ("id", "brand", "description", "origin")}).withColumn("id", F.regexp_replace("id", "^'+|'+$", ""))
    tidy = tidy.withColumns({"kind": kind_of(F.col("description")), "imported": (F.col("origin") != "") & ~F.upper("origin").isin(*US_PLACES)})
    return tidy.where(F.col("id").rlike("^[0-9]+$") & (F.col("kind") != "other") & (F.col("brand") != ""))

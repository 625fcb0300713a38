"""Batches: rows are validated, joined with their files, exported in scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FIELDS
from ..functions.text import header_key

IMAGE_TYPES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
MAX_FILES = 6


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_image(name: Column) -> Column:
    """(FLT14)"""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*IMAGE_TYPES)


def row_errors(value: dict[str, Column], alcohol: Column, volume: Column) -> Column:
    """All errors of a row: blank required fields, then figures that can't be read. The first one stands for the row. (FLT1, FLT2)"""
    blank = [F.when(F.trim(F.coalesce(value[f.key], F.lit(""))) == "", F.lit(f"missing {f.key}")) for f in FIELDS if f.required]
    return F.array_compact(F.array(*blank, F.when(alcohol.isNull(), F.lit("unreadable alcohol_content")), F.when(volume.isNull(), F.lit("unreadable net_contents"))))


def map_headers(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns renamed to their keys; headers are compared without case, blanks and dashes; the first of several wins. (SRC2)"""
    plain = lambda h: "".join(c for c in h.lower().replace("﻿", "") if c not in " \t_-/")
    wanted = {plain(a): key for key, names in aliases.items() for a in (key, *names)}
    chosen: dict[str, str] = {}
    for h in df.columns:
        chosen.setdefault(wanted.get(plain(h), h), h)
    return df.select(*[F.col(f"`{h}`").alias(k) for k, h in chosen.items()])


def collected_files(files: DataFrame) -> DataFrame:
    """(name, stem, digest) by lower-cased base name, from files (path, digest); digest is null where files of one name differ. (SRC4, ST4)"""
    rows = files.withColumn("name", base_name(F.col("path")))
    same = F.min("digest") == F.max("digest")
    return rows.groupBy("name").agg(F.when(same, F.min("digest")).alias("digest")).withColumn("stem", stem(F.col("name")))


def join_files(named: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file and state (ok, ambiguous, missing) to rows with file_name; the exact name first, else a unique stem. (JN1)"""
    exact = files.select(F.col("name").alias("_n"), F.struct("name", "digest").alias("_e"))
    stems = files.groupBy("stem").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("digest").alias("digest")).select(F.col("stem").alias("_s"), F.struct("n", "name", "digest").alias("_t"))
    key = base_name(F.col("file_name"))
    rows = named.withColumn("_k", key).withColumn("_ks", stem(F.col("_k"))).join(exact, F.col("_k") == F.col("_n"), "left").join(stems, F.col("_ks") == F.col("_s"), "left")
    state = (
        F.when(F.col("_e").isNotNull(), F.when(F.col("_e.digest").isNull(), "ambiguous").otherwise("ok")).when(F.col("_t").isNull(), "missing")
        .when((F.col("_t.n") > 1) | F.col("_t.digest").isNull(), "ambiguous").otherwise("ok")
    )
    rows = rows.withColumn("state", state).withColumn("file", F.when(F.col("state") == "ok", F.coalesce("_e.name", "_t.name")))
    return rows.drop("_k", "_ks", "_n", "_e", "_s", "_t")


def build_items(rows: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, files, error) from rows (row_id, image, error): a row lists files by ; or |. The row's own error comes first, then
    no name, too many, missing, ambiguous. (JN2, AR1)"""
    names = F.filter(F.transform(F.split("image", r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("names", F.coalesce(names, F.array().cast("array<string>")))
    each = join_files(rows.select(key, F.posexplode("names").alias("pos", "file_name")), files)
    per = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"), F.bool_or(F.col("state") == "missing").alias("missing"), F.bool_or(F.col("state") == "ambiguous").alias("ambiguous"))
    out = rows.join(per, key, "left")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("names") == 0, "no image").when(F.size("names") > MAX_FILES, "too many images")
        .when(F.col("missing"), "image missing").when(F.col("ambiguous"), "image ambiguous")
    )
    return out.select(key, F.when(error.isNull(), F.col("files")).alias("files"), error.alias("error"))


def orphans(files: DataFrame, used: DataFrame, named: DataFrame) -> DataFrame:
    """Files (name) that no accepted row uses and no row names, by name or stem; files that differ under one name are left out. (JN3)"""
    mentioned = named.select(base_name(F.col("file_name")).alias("name"))
    left = files.where("digest is not null").join(used.select(F.col("file").alias("name")), "name", "left_anti").join(mentioned, "name", "left_anti")
    return left.join(mentioned.select(stem(F.col("name")).alias("stem")), "stem", "left_anti").select("name")


def export_scope(items: DataFrame, ids: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Both conditions hold where both are given; CLEARED stands for a decision of pass. (FLT3)"""
    if ids:
        items = items.where(F.col("application_id").isin(*ids))
    if statuses:
        items = items.where(F.col("status").isin(*statuses) | (F.lit("CLEARED" in statuses) & F.coalesce(F.col("decision") == "pass", F.lit(False))))
    return items


def parse_scope(text: str | None) -> list[str]:
    """(FLT12)"""
    return [x.strip().upper() for x in (text or "").split(",") if x.strip()]


def guarded(text: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get an apostrophe. (SNK2)"""
    return F.when(F.left(text, F.lit(1)).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


#: Columns of items that an export has only with their group; the group of fields adds four columns a field.
EXPORT_GROUPS = {
    "warning": ("warning_present", "warning_wording", "warning_heading_caps", "warning_heading_bold", "warning_notes", "warning_diff"),
    "decisions": ("decision", "answers"), "ocr": ("label_text",), "timings": ("read_ms", "total_ms"),
}
EXPORTED = ("fields", "warning", "decisions", "timings")


def export_table(items: DataFrame, fields: DataFrame, groups: tuple[str, ...] = EXPORTED) -> DataFrame:
    """One row an item, with the columns of the groups asked for, in their order, and all text guarded. Unknown groups are passed over. (SNK1)"""
    keys = [f.key for f in FIELDS]
    grouped = {c for columns in EXPORT_GROUPS.values() for c in columns}
    picks = [F.first(F.when(F.col("key") == k, F.col(c)), ignorenulls=True).alias(f"{k}_{c}") for k in keys for c in ("expected", "found", "verdict", "score")]
    wide = items.join(fields.groupBy("application_id").agg(*picks), "application_id", "left") if "fields" in groups else items
    shown = [c for c in items.columns if c not in grouped] + [c for c in wide.columns if c not in items.columns] + [c for g, columns in EXPORT_GROUPS.items() if g in groups for c in columns if c in items.columns]
    kinds = dict(wide.dtypes)
    return wide.select(*[guarded(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in shown])


def search(items: DataFrame, text: str, status: str | None = None, columns=("application_id", "file", "brand")) -> DataFrame:
    """Status and a substring over some columns, without case. (FLT4)"""
    hit = F.lower(F.concat_ws(" ", *columns)).contains(text.lower())
    return items.where(hit if status is None else hit & (F.col("status") == status))


def natural_order(name: Column) -> list[Column]:
    """Text before the first digits, then those as a number. (SO3)"""
    return [F.regexp_replace(name, r"\d.*$", ""), F.regexp_extract(name, r"(\d+)", 1).try_cast("decimal(38,0)"), name]


def missing_headers(headers: DataFrame, wanted: DataFrame, floor: int = 60) -> DataFrame:
    """For each wanted key (key, alias) without a header, the header most like one of its aliases, to rename, or to add. (SRC3)"""
    from ..functions import similarity

    have, need = headers.withColumn("h", header_key(F.col("header"))), wanted.withColumn("a", header_key(F.col("alias")))
    present = need.join(have, F.col("a") == F.col("h"), "left_semi").select("key").distinct()
    rows = need.join(present, "key", "left_anti")
    pairs = rows.withColumn("_one", F.lit(1)).join(have.join(need, F.col("a") == F.col("h"), "left_anti").withColumn("_one", F.lit(1)), "_one").withColumn("score", similarity.ratio("a", "h"))
    best = pairs.where(F.col("score") >= floor).groupBy("key").agg(F.max_by("header", F.struct("score", "header")).alias("rename"))
    return rows.select("key").distinct().join(best, "key", "left").select("key", F.coalesce(F.concat(F.lit("rename "), F.col("rename")), F.lit("add")).alias("advice"))

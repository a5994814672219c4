"""Readers of item banks, raw corpora, layouts, tasks and manifests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name, lf
from ..operators.layout import normal_box

RESERVED = ("_assets", "_handouts", "_backups")  # fixed values
FENCE = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
RAW_ORDER = ("_combined_raw.md", "_raw.md")  # suffixes, best first

LAYOUT_ITEM = "array<struct<i:int,w:int,align:string,stack:boolean>>"
META = T.StructType([T.StructField("values", T.MapType(T.StringType(), T.StringType())),
                     T.StructField("tags", T.ArrayType(T.StringType()))])


def skipped(path: Column) -> Column:
    """Paths through a dot folder or a reserved folder."""
    return path.rlike(r"(?:^|/)(?:\.[^/]*|" + "|".join(RESERVED) + r")(?:/|$)")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.url_decode(path), "^.*?" + re.escape(root.strip("/")) + "/", "")


def read_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text, size, modified) of all matching files, reserved folders left out."""
    df = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root))
    meta = F.col("_metadata")
    rel = relative(meta["file_path"], root)
    return (df.select(rel.alias("path"), lf(F.col("value")).alias("text"), meta["file_size"].alias("size"),
                      meta["file_modification_time"].alias("modified")).filter(~skipped(F.col("path"))))


def _meta(block: str):
    """Scalar and list entries of a front block; nested values stay as their text."""
    values, tags, key = {}, [], None
    for line in (block or "").split("\n"):
        item = re.match(r"^\s*-\s+(.*)$", line)
        pair = re.match(r"^([^\s#:][^:]*):\s*(.*)$", line)
        if pair:
            key, raw = pair.group(1).strip(), pair.group(2).strip()
            inner = re.match(r"^\[(.*)\]$", raw)
            if key == "tags" and inner:
                tags = [t.strip().strip("'\"") for t in inner.group(1).split(",") if t.strip()]
            else:
                values[key] = raw.strip("'\"") if not inner else raw
        elif item and key == "tags":
            tags.append(item.group(1).strip().strip("'\""))
        elif key and line.strip():
            values[key] = (values.get(key, "") + "\n" + line).strip("\n")
    return values, tags


@F.pandas_udf(META)
def front_values(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_meta(b) for b in blocks], columns=["values", "tags"])


def sections(body: Column) -> Column:
    """(stem, parts): text before the first second-level heading, then heading and content pairs.

    Where nothing precedes the first heading its section goes back to the stem, unless it
    is the solution.
    """
    pieces = F.split(F.concat(F.lit("\n"), body), r"\n## ")
    cut = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        F.trim(F.get(F.split(p, "\n", 2), 0)).alias("heading"),
        F.regexp_replace(F.coalesce(F.get(F.split(p, "\n", 2), 1), F.lit("")), r"^\n+|\n+$", "").alias("content")))
    stem = F.regexp_replace(F.get(pieces, 0), r"^\n+|\n+$", "")
    first = F.get(cut, 0)
    back = (stem == "") & (F.size(cut) > 0) & (first["heading"] != "解析")
    pulled = F.regexp_replace(F.concat(F.lit("## "), first["heading"], F.lit("\n"), first["content"]), r"\n+$", "")
    rest = F.when(F.size(cut) > 0, F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    return F.struct(F.when(back, pulled).otherwise(stem).alias("stem"), F.when(back, rest).otherwise(cut).alias("parts"))


KNOWN = ("id", "type", "difficulty", "source", "tags", "starred", "order", "number", "created", "updated", "img_split", "sol_img_split",
         "import_scope", "import_index", "original_path", "deleted_at")


def parse_items(texts: DataFrame, kind_field: str = "kind", item_kind: str = "question") -> DataFrame:
    """Item columns from Markdown files with a front block; other kinds of files drop out."""
    fenced = F.col("text").rlike(FENCE)
    rows = texts.select("path", F.when(fenced, F.regexp_extract("text", FENCE, 1)).otherwise("").alias("front"),
                        F.when(fenced, F.regexp_extract("text", FENCE, 2)).otherwise(F.col("text")).alias("_body"))
    rows = rows.withColumn("_m", front_values("front"))
    v = F.col("_m.values")
    rows = rows.filter(F.coalesce(F.lower(F.trim(v[kind_field])) == item_kind, F.lit(True)))
    stem = F.regexp_replace(base_name(F.col("path")), r"\.md$", "")
    rows = rows.withColumn("_s", sections(F.col("_body")))
    part = F.col("_s.parts")
    is_sol = lambda p: p["heading"] == "解析"
    sol_at = F.get(F.filter(F.transform(part, lambda p, i: F.when(is_sol(p), i)), lambda i: i.isNotNull()), 0)
    extra = F.filter(part, lambda p, i: sol_at.isNull() | (i != sol_at))
    note = F.get(F.filter(extra, lambda p: p["heading"] == "备注"), 0)["content"]
    truth = F.lower(v["starred"]).isin("true", "yes", "on", "1")
    return rows.select(
        F.coalesce(F.nullif(v["id"], F.lit("")), stem).alias("id"), stem.alias("title"), "path",
        F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("").alias("folder"),
        F.col("_s.stem").alias("body"), F.coalesce(F.get(part, sol_at)["content"], F.lit("")).alias("solution"),
        F.coalesce(note, F.lit("")).alias("note"), extra.alias("extra_sections"),
        F.coalesce(v["type"], F.lit("")).alias("type"), F.coalesce(v["difficulty"], F.lit("")).alias("difficulty"),
        F.coalesce(v["source"], F.lit("")).alias("source"), F.coalesce("_m.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(truth, F.lit(False)).alias("starred"), F.coalesce(v["order"].try_cast("double"), F.lit(0.0)).alias("order"),
        F.trim(v["number"]).try_cast("int").alias("number"), v["img_split"].alias("img_split"), v["sol_img_split"].alias("sol_img_split"),
        F.coalesce(v["created"], F.lit("")).alias("created"), F.coalesce(v["updated"], F.lit("")).alias("updated"),
        v["import_scope"].alias("import_scope"), v["import_index"].try_cast("int").alias("import_index"),
        v["original_path"].alias("original_path"), v["deleted_at"].alias("deleted_at"),
        F.map_filter(v, lambda k, _x: ~k.isin(*KNOWN, kind_field)).alias("extra_meta"))


def read_bank(spark: SparkSession, root: str, folder: str = "", recursive: bool = True, pattern: str = "*.md", **kind) -> DataFrame:
    """Items of a bank or of one folder; other folders are pruned before any file is read."""
    base = f"{root.rstrip('/')}/{folder}".rstrip("/")
    texts = read_texts(spark, base, pattern).withColumn("path", F.concat(F.lit(folder + "/" if folder else ""), F.col("path")))
    items = parse_items(texts, **kind)
    return items if recursive else items.filter(F.col("folder") == folder)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """One raw text per archive folder, the combined one first, with its metadata where present."""
    texts = read_texts(spark, root)
    rank = F.when(F.col("path").endswith(RAW_ORDER[0]), 0).when(F.col("path").endswith(RAW_ORDER[1]), 1)
    raw = texts.withColumn("rank", rank).filter("rank IS NOT NULL").withColumn("archive", F.regexp_replace("path", r"/[^/]*$", ""))
    best = raw.groupBy("archive").agg(F.min_by("text", F.struct("rank", "path")).alias("raw_md"), F.min_by("path", F.struct("rank", "path")).alias("path"))
    meta = read_texts(spark, root, "meta.json").select(F.regexp_replace("path", r"/[^/]*$", "").alias("archive"), F.from_json("text", "map<string,string>").alias("meta"))
    return best.join(meta, "archive", "left")


LAYOUT_ROW = ("array<struct<page_idx:int,type:string,text:string,list_items:array<string>,img_path:string,bbox:array<double>>>")


def read_layouts(spark: SparkSession, root: str, pattern: str = "*_content_list.json") -> DataFrame:
    """Layout rows of the newest list file per folder, boxes on the 0 to 1000 scale."""
    files = read_texts(spark, root, pattern).withColumn("doc", F.regexp_replace("path", r"/[^/]*$", ""))
    newest = files.groupBy("doc").agg(F.max_by("text", F.struct("modified", "path")).alias("text"))
    rows = newest.select("doc", F.posexplode(F.from_json("text", LAYOUT_ROW)).alias("seq", "r"))
    box = normal_box(F.col("r.bbox"))
    text = F.coalesce("r.text", F.array_join("r.list_items", "\n"))
    return rows.select("doc", F.coalesce("r.page_idx", F.lit(0)).alias("page"), "seq", F.col("r.type").alias("kind"), text.alias("text"),
                       F.regexp_replace("r.img_path", r"^.*[/\\]", "").alias("figure"),
                       F.get(box, 0).alias("x0"), F.get(box, 1).alias("y0"), F.get(box, 2).alias("x1"), F.get(box, 3).alias("y1"))


TASK = ("kind string, task_id string, updated_at string, payload struct<status:string,created_at:double,cancelled:boolean,"
        "groups:array<struct<gid:int,filename:string,status:string,reviewed:string,error:string,md:string,note:string,attempt:int>>>")


def read_tasks(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    tasks = spark.read.schema(TASK).json(path)
    return tasks.filter(F.col("kind") == kind) if kind else tasks


def task_groups(tasks: DataFrame) -> DataFrame:
    return tasks.select("kind", "task_id", F.explode_outer("payload.groups").alias("g")).select("kind", "task_id", "g.*")


MANIFEST = "schema int, id string, title string, created_at string, files array<struct<name:string,size:long,sha256:string>>, _corrupt string"


def read_manifests(spark: SparkSession, path: str, schema_version: int = 1) -> DataFrame:
    """Valid manifests, newest first; unreadable or foreign ones are skipped."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = raw.filter(F.col("_corrupt").isNull() & (F.col("schema") == schema_version) & F.col("id").rlike(r"^[A-Za-z0-9_-]+$"))
    return ok.drop("_corrupt").orderBy(F.col("created_at").desc(), F.col("id"))


OVERRIDE = ("gid int, operation string, number int, idx int, after_number int, after_idx int, expected_body_sha256 string, "
            "expected_reference_body_sha256 string, body string, body_prefix string, solution string, type string, new_number int")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides of all files below ``path``; folder names are not read as columns."""
    return spark.read.schema(OVERRIDE).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, size, mtime) of all files; contents are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = relative(F.col("path"), root)
    return df.select(rel.alias("path"), base_name(rel).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def list_assets(spark: SparkSession, root: str, types) -> tuple[DataFrame, DataFrame]:
    """(assets, ignored) by file extension."""
    files = list_files(spark, root)
    known = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(list(types))
    return files.filter(known), files.filter(~known)

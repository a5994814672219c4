"""References, assets, attachments and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, base_name

EMBED = r"!\[\[([^\]\|]+)(?:\|[^\]]*)?\]\]"  # fixed value
ASSET_TYPES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "avif", "svg", "pdf")  # fixed values
GRACE_SECONDS = 300  # fixed value


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def references(body: Column, originals: Column | None = None) -> Column:
    """Distinct lower-case file names a text uses: embeds, kept originals, the PDF beside an SVG."""
    names = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(EMBED), F.lit(1)), base_name)
    if originals is not None:
        kept = F.filter(F.transform(originals, lambda o: base_name(o["orig"])), lambda n: n.isNotNull() & (n != ""))
        names = F.concat(names, F.coalesce(kept, F.array().cast("array<string>")))
    low = F.transform(names, lambda n: F.lower(n))
    beside = F.transform(F.filter(low, lambda n: n.endswith(".svg")), lambda n: F.regexp_replace(n, r"\.svg$", ".pdf"))
    return F.array_union(low, beside)


def outermost_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie in no other root; each root meets its own ancestors by equality."""
    r = roots.select(F.rtrim("root", F.lit("/")).alias("root")).distinct()
    parts = r.select("root", F.explode(ancestors(F.col("root"))).alias("up")).filter("up <> root")
    inner = parts.join(r.select(F.col("root").alias("up")), "up", "left_semi").select("root").distinct()
    return r.join(inner, "root", "left_anti")


def files_below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct files below the outermost roots."""
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    return up.join(outermost_roots(roots), "root", "left_semi").select("path").distinct()


def classify_assets(assets: DataFrame, refs: DataFrame, now: Column, unreadable: int = 0) -> DataFrame:
    """Assets with ``state``: referenced, recent, orphan. Nothing is an orphan after a read error."""
    used = refs.select(F.lower("name").alias("_n")).distinct().withColumn("_used", F.lit(True))
    j = assets.join(used, F.lower("name") == F.col("_n"), "left")
    young = micros(now) - micros(F.col("mtime")) < GRACE_SECONDS * 1_000_000
    rest = F.when(young | F.lit(unreadable > 0), "recent").otherwise("orphan")
    return j.withColumn("state", F.when(F.col("_used"), "referenced").otherwise(rest)).drop("_n", "_used")


def asset_summary(classified: DataFrame, refs: DataFrame) -> DataFrame:
    names = classified.select(F.lower("name").alias("name")).distinct()
    missing = refs.select(F.lower("name").alias("name")).distinct().join(names, "name", "left_anti").select(F.count("*"))
    state = F.col("state")
    return classified.agg(
        F.count("*").alias("files"), F.count_if(state == "referenced").alias("referenced"),
        F.count_if(state == "recent").alias("recent"), F.coalesce(F.sum(F.when(state == "recent", F.col("size"))), F.lit(0)).alias("recent_bytes"),
        F.count_if(state == "orphan").alias("orphans"), F.coalesce(F.sum(F.when(state == "orphan", F.col("size"))), F.lit(0)).alias("orphan_bytes"),
        missing.scalar().alias("missing_references"))


def confirmed_deletes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Orphans of an earlier scan that are still orphans with the same size and time."""
    a = before.filter("state = 'orphan'").select("name", "size", "mtime")
    b = now.filter("state = 'orphan'").select("name", "size", "mtime")
    return a.join(b, ["name", "size", "mtime"], "left_semi")


def attachments(files: DataFrame, folder: str) -> DataFrame:
    """Non-Markdown files below a folder with their kind, told from the name."""
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    kind = F.when(F.contains(stem, F.lit("答案")) | F.contains(stem, F.lit("解析")), "solution").otherwise("exam")
    return (files.filter(F.col("path").startswith(folder + "/") & ~F.lower("path").endswith(".md"))
            .select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), base_name(F.col("path")).alias("name"), kind.alias("kind"), "size"))


def reference_loss(raw: DataFrame, output: DataFrame) -> DataFrame:
    """References that occur more often in the raw text than in the output, per document."""
    a = raw.groupBy("doc", "name").agg(F.count("*").alias("a"))
    b = output.groupBy("doc", "name").agg(F.count("*").alias("b"))
    lost = F.col("a") - F.coalesce("b", F.lit(0))
    return a.join(b, ["doc", "name"], "left").filter(lost > 0).select("doc", "name", lost.alias("lost"))


def expired_files(files: DataFrame, active: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files past their age that no live task uses."""
    old = micros(now) - micros(F.col("mtime")) > hours * 3_600_000_000
    return files.filter(old).join(active.select("path").distinct(), "path", "left_anti")


def expired_tasks(tasks: DataFrame, now_seconds: Column, days: int = 7) -> DataFrame:
    """Tasks past their age; an unreadable time counts as expired."""
    return tasks.filter(F.coalesce(F.col("updated_at").try_cast("double") < now_seconds - max(1, days) * 86400, F.lit(True)))


def mark_interrupted(tasks: DataFrame, active: list[str], error: str, now: Column, status: str = "interrupted") -> DataFrame:
    """Mark running tasks and their running groups; a task with a marked group is marked too."""
    busy = lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))).isin([a.strip().lower() for a in active])
    hit = F.exists("groups", lambda g: busy(g["status"]))
    groups = F.transform("groups", lambda g: F.when(busy(g["status"]), F.struct(
        g["gid"].alias("gid"), F.lit(status).alias("status"), F.lit(error).alias("error"))).otherwise(g))
    node = busy(F.col("status")) | F.coalesce(hit, F.lit(False))
    return (tasks.withColumn("_node", node).withColumn("groups", groups)
            .withColumn("status", F.when(F.col("_node"), status).otherwise(F.col("status")))
            .withColumn("error", F.when(F.col("_node"), error).otherwise(F.col("error")))
            .withColumn("interrupted_at", F.when(F.col("_node"), now)).drop("_node"))


def batch_overview(groups: DataFrame) -> DataFrame:
    """Counts per batch over its groups (batch, status, reviewed)."""
    s = F.col("status")
    reviewed = F.col("reviewed").isin("imported", "skipped")
    return groups.groupBy("batch").agg(
        F.count("*").alias("total"), F.count_if(s.isin("done", "error", "awaiting_block_review")).alias("done"),
        F.count_if(s == "converting").alias("converting"), F.count_if(s == "pending").alias("pending"),
        F.count_if((s == "done") & F.col("reviewed").isNull()).alias("ready"),
        F.count_if(s == "awaiting_block_review").alias("awaiting_block_review"), F.count_if(reviewed).alias("reviewed"),
        F.count_if(s == "error").alias("errors"), F.bool_and(F.coalesce((s == "error") | reviewed, F.lit(False))).alias("finished"))


def ready_sources(sources: DataFrame, items: DataFrame, originals: DataFrame) -> DataFrame:
    """Sources still to do: their folder lacks items or the original file."""
    done = items.select("folder").distinct().join(originals.select("folder").distinct(), "folder", "left_semi")
    return sources.join(done, "folder", "left_anti")


def reusable_work(pending: DataFrame, finished: DataFrame) -> DataFrame:
    """For pending files the newest finished group with output, from any earlier batch of the year."""
    hits = finished.filter("has_output").join(pending.select("year", "file").distinct(), ["year", "file"], "left_semi")
    return hits.groupBy("year", "file").agg(F.max("batch").alias("batch"), F.max_by("group", F.struct("batch", "group")).alias("group"))


def progress(files: DataFrame) -> DataFrame:
    return files.groupBy("year").agg(
        F.count("*").alias("sources"), F.count_if(F.col("state") == "complete").alias("complete"),
        F.count_if(F.col("state") == "anomaly").alias("anomalies"),
        F.count_if(~F.col("state").isin("complete", "anomaly")).alias("remaining"))

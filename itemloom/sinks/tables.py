"""All-or-nothing table writes and nested reports.

A new version of a table goes to its own folder first; a small pointer file then names
it. Readers follow the pointer, so they see the old table or the new one, never a mix.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT")
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _pointer(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version of the table at ``path``."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path.rstrip('/')}/v={version}")
    jvm, p, fs = _pointer(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(draft), files.makeQualified(p), overwrite)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/v={version}")


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Add a run; an existing run is never overwritten."""
    df.write.mode("error").parquet(f"{path.rstrip('/')}/run={run}")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def nested_report(rows: DataFrame, keys: list[str], name: str, fields: list[str]) -> DataFrame:
    """One row per key with its detail rows as an array, as the JSON reports are laid out."""
    detail = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*keys).agg(detail.alias(name), F.count("*").alias(f"{name}_count"))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the place in it; a bare path and ``file:`` are the local store."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_texts(df: DataFrame, path: str, by: list[str]) -> str:
    """One text file for each row of ``df(value, *by)``, under folders named by ``by``.

    A file costs far more than its row, so the rows are dealt to all tasks whatever the table's
    size in bytes. The tasks write through Arrow: Hadoop's local store starts four processes to set
    the rights of each file and folder. A file is named by its task's number and its own, so a task that
    runs twice writes the same files. Stores that Arrow does not open are left to Spark's writer.
    """
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    try:
        store, root = _opened(path)
        store.create_dir(root, recursive=True)  # the readers expect it also where there are no rows
    except (pa.ArrowException, ValueError, OSError):
        (dealt.write.partitionBy(*by).option("maxRecordsPerFile", 1)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))
        return path

    def run(batches):
        store, root = _opened(path)
        task, made, k = TaskContext.get().partitionId(), set(), 0
        for batch in batches:
            for row in batch.to_pylist():
                folder = "/".join([root, *[f"{c}={row[c]}" for c in by]])
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/part-{task:05d}-{k:06d}.txt") as out:
                    out.write(((row["value"] or "") + "\n").encode())
                k += 1
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    dealt.select("value", *[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in by]).mapInArrow(
        run, "files long").agg(F.sum("files")).collect()
    return path

"""Keyed sequence work that survives one key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. The helpers
here cut a key into consecutive chunks, run the window inside each chunk, and carry
the state of the earlier chunks in from a small per-chunk summary table. Chunks come
from a dense position, from a coarse order expression for heavy keys only, or from
range partitioning when the order has no such structure.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import materialise

CHUNK_ROWS = 65_536
HEAVY_ROWS = 500_000


@dataclass(frozen=True)
class Carry:
    """One running column: what to fold, and whether the current row takes part."""

    kind: str  # sum | max | min | last | lag | lead
    expr: Column
    inclusive: bool = True


def running_sum(expr, inclusive=True):
    return Carry("sum", expr, inclusive)


def running_count(condition, inclusive=True):
    return Carry("sum", F.when(condition, 1).otherwise(0).cast("long"), inclusive)


def row_number():
    return Carry("sum", F.lit(1).cast("long"), True)


def running_max(expr, inclusive=True):
    return Carry("max", expr, inclusive)


def last_seen(expr, inclusive=True):
    """Latest non-null value so far."""
    return Carry("last", expr, inclusive)


def lag(expr):
    return Carry("lag", expr)


def lead(expr):
    return Carry("lead", expr)


def dense_chunk(position, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number for a position that counts the rows of its key."""
    return F.floor(F.col(position) / F.lit(rows)).cast("long")


def _one_chunk(df: DataFrame, chunk: Column) -> bool:
    low, high, none = df.agg(F.min(chunk), F.max(chunk), F.count_if(chunk.isNull())).first()
    return low is None or (low == high and not none)


def chunks_of(df: DataFrame, position: str) -> Column | None:
    """The dense chunk of a position, or None where no position reaches a second chunk.

    For several scans over rows of ``df``, which then need not look again.
    """
    chunk = dense_chunk(position)
    return None if _one_chunk(df, chunk) else chunk


def _in_one_window(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Carry]) -> DataFrame:
    inside = Window.partitionBy(*keys).orderBy(*order)
    folds = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}
    out = []
    for name, spec in columns.items():
        if spec.kind in ("lag", "lead"):
            e = (F.lag if spec.kind == "lag" else F.lead)(spec.expr).over(inside)
        else:
            e = folds[spec.kind](spec.expr).over(inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1))
        out.append((F.coalesce(e, F.lit(0)) if spec.kind == "sum" else e).alias(name))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | str | None,
         columns: dict[str, Carry]) -> DataFrame:
    """Add running columns over ``order`` inside the ``keys``; a null key is a key like others.

    ``chunk`` must not decrease along ``order``. Where the table has one chunk only, or
    ``chunk`` is None, every key fits it and the scan is one window over the keys, with one
    shuffle that later steps by these keys reuse. Else only keys with several chunks appear
    in the carry table. Given as a column name, ``chunk`` stays in the result.
    """
    if chunk is None or _one_chunk(df, F.col(chunk) if isinstance(chunk, str) else chunk):
        return _in_one_window(df, keys, order, columns)
    keep_chunk = isinstance(chunk, str)
    cname = chunk if keep_chunk else "_chunk"
    base = df if keep_chunk else df.withColumn(cname, chunk)
    names = list(columns)
    for i, name in enumerate(names):
        spec = columns[name]
        value = F.struct(spec.expr.alias("v")) if spec.kind in ("lag", "lead") else spec.expr
        base = base.withColumn(f"_v{i}", value)

    inside = Window.partitionBy(*keys, cname).orderBy(*order)
    local = base
    for i, name in enumerate(names):
        spec = columns[name]
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        v = F.col(f"_v{i}")
        if spec.kind == "sum":
            e = F.sum(v).over(frame)
        elif spec.kind == "max":
            e = F.max(v).over(frame)
        elif spec.kind == "min":
            e = F.min(v).over(frame)
        elif spec.kind == "last":
            e = F.last(v, ignorenulls=True).over(frame)
        elif spec.kind == "lag":
            e = F.lag(v).over(inside)
        else:
            e = F.lead(v).over(inside)
        local = local.withColumn(f"_l{i}", e)

    place = F.struct(*[F.col(c) for c in order])
    folds = []
    for i, name in enumerate(names):
        spec, v = columns[name], F.col(f"_v{i}")
        if spec.kind == "sum":
            folds.append(F.sum(v).alias(f"_t{i}"))
        elif spec.kind == "max":
            folds.append(F.max(v).alias(f"_t{i}"))
        elif spec.kind == "min":
            folds.append(F.min(v).alias(f"_t{i}"))
        elif spec.kind == "last":
            folds.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t{i}"))
        elif spec.kind == "lag":
            folds.append(F.max_by(v, place).alias(f"_t{i}"))
        else:
            folds.append(F.min_by(v, place).alias(f"_t{i}"))
    totals = base.groupBy(*keys, cname).agg(*folds)

    across = Window.partitionBy(*keys).orderBy(cname)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_chunks", F.count("*").over(Window.partitionBy(*keys)))
    picks = []
    for i, name in enumerate(names):
        kind, t = columns[name].kind, F.col(f"_t{i}")
        if kind == "sum":
            e = F.sum(t).over(before)
        elif kind == "max":
            e = F.max(t).over(before)
        elif kind == "min":
            e = F.min(t).over(before)
        elif kind == "last":
            e = F.last(t, ignorenulls=True).over(before)
        elif kind == "lag":
            e = F.lag(t).over(across)
        else:
            e = F.lead(t).over(across)
        picks.append(e.alias(f"_c{i}"))
    carried = (carried.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
                              F.col(cname).alias("_kc"), "_chunks", *picks)
               .filter("_chunks > 1").drop("_chunks"))

    match = F.col(cname).eqNullSafe(F.col("_kc"))
    for j, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    joined = local.join(carried, match, "left")

    out = []
    for i, name in enumerate(names):
        kind, here, past = columns[name].kind, F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind == "sum":
            e = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif kind == "max":
            e = F.greatest(here, past)
        elif kind == "min":
            e = F.least(here, past)
        elif kind == "last":
            e = F.coalesce(here, past)
        else:
            e = F.coalesce(here, past)["v"]
        out.append(e.alias(name))
    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *out)


def fold(df: DataFrame, keys: list[str], order: list[str], start, step, finish, schema: str) -> DataFrame:
    """Left fold over the ordered rows of each key, for rules Catalyst cannot express.

    Rows stream through a task in sorted Arrow batches and only ``start()``'s state is
    kept, so a key never has to fit in memory; the caller keeps that state bounded.
    ``step(state, frame)`` takes consecutive rows of one key, ``finish(state)`` gives the
    result tuples, which follow the key columns in ``schema``. A step may return such tuples
    too: they leave at once, so the state need not keep what is settled.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    fields = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        key, state = None, None
        for pdf in batches:
            rows = []
            at = pdf[keys].apply(tuple, axis=1) if len(keys) > 1 else pdf[keys[0]]
            cuts = at.ne(at.shift()).cumsum()
            for _, part in pdf.groupby(cuts.to_numpy(), sort=False):
                k = tuple(part.iloc[0][c] for c in keys)
                if key is not None and k != key:
                    rows += [(*key, *r) for r in finish(state)]
                    state = None
                if state is None:
                    key, state = k, start()
                rows += [(*key, *r) for r in step(state, part) or ()]
            if rows:
                yield pd.DataFrame(rows, columns=fields)
        if key is not None:
            rows = [(*key, *r) for r in finish(state)]
            if rows:
                yield pd.DataFrame(rows, columns=fields)

    return ready.mapInPandas(run, schema)


def heavy_keys(df: DataFrame, keys: list[str], rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows, whatever the size of the table."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)


def heavy_chunk(df: DataFrame, keys: list[str], fine: Column, name: str = "_hc",
                rows: int = HEAVY_ROWS) -> DataFrame:
    """Add a chunk column: ``fine`` for heavy keys, one chunk for all other keys."""
    found = heavy_keys(df, keys, rows)
    if found.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    heavy = found.select(
        *[F.col(k).alias(f"_h{j}") for j, k in enumerate(keys)], F.lit(True).alias("_heavy"))
    match = None
    for j, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_h{j}"))
        match = c if match is None else match & c
    return (df.join(heavy, match, "left")  # small or not, the engine picks the join
            .withColumn(name, F.when(F.col("_heavy"), fine.cast("long")).otherwise(F.lit(0).cast("long")))
            .drop("_heavy", *[f"_h{j}" for j in range(len(keys))]))


def ranged(df: DataFrame, keys: list[str], order: list[Column], chunk: str = "_pid") -> DataFrame:
    """Sort by (keys, order) over range partitions and freeze the partition numbers.

    Each partition is one stretch of the total order, whatever the keys' sizes, so
    ``chunk`` serves as the chunk of ``scan``. ``order`` must end in a unique column.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    spread = spread.sortWithinPartitions(*[F.col(k) for k in keys], *order)
    at = F.monotonically_increasing_id()
    marked = spread.withColumn("_at", at).withColumn(chunk, F.shiftright("_at", 33))
    return materialise(marked)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based position of every row in a total order, without a single-task sort."""
    frozen = ranged(df, [], order)
    sizes = frozen.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (frozen.join(F.broadcast(starts), "_pid")  # one row per partition
            .withColumn(name, F.col("_start") + F.expr("_at & 8589934591") + 1)
            .drop("_pid", "_at", "_start", ))


def rank_in_key(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position inside each key; keys may be of any size.

    Rows are sorted by ranges, which can cut a key, only where a key is heavy.
    """
    if heavy_keys(df, keys).isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    frozen = ranged(df, keys, order)
    out = scan(frozen, keys, ["_at"], F.col("_pid"), {name: row_number()})
    return out.drop("_at", "_pid")


def join_counted(left: DataFrame, right: DataFrame, on: list[str], row_id: str, count: str = "n",
                 how: str = "inner", slice_rows: int = HEAVY_ROWS) -> DataFrame:
    """Join rows to a per-key table that knows each key's row count on the left.

    A key with more than ``slice_rows`` left rows is cut into slices: its single right
    row is repeated once per slice and left rows pick a slice by hash of ``row_id``.
    """
    right = materialise(right)  # read three times below
    big = right.filter(F.col(count) > slice_rows).select(
        *[F.col(k).alias(f"_b{j}") for j, k in enumerate(on)],
        F.ceil(F.col(count) / slice_rows).cast("int").alias("_slices"))
    match = None
    for j, k in enumerate(on):
        c = F.col(k) == F.col(f"_b{j}")
        match = c if match is None else match & c
    parts = [f"_b{j}" for j in range(len(on))]
    cut = (left.join(big, match, "left")
           .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_slices")), F.lit(0)).cast("int"))
           .drop("_slices", *parts))
    spread = (right.join(big, match, "left")
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
              .drop("_slices", *parts))
    return cut.join(spread, [*on, "_slice"], how).drop("_slice")

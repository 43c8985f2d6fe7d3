"""Shared helpers: reading, written intermediate tables, connected components.

Intermediate results are written as Parquet below the shared folder named by
``spark.checkpoint.dir`` and read back. That cuts lineage (a lost executor
recomputes at most one step), costs less than a serialised checkpoint and lets
later steps prune columns.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

#: Zero-argument ASCII ``bytes.split`` splits on exactly these bytes, and ``bytes.lower`` lower-cases A-Z only.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def _fold(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """Connected components of an undirected link table (a, b): rows (node, root), the smallest node as root.

    Alternating large-star and small-star steps until nothing changes (no round limit). Each half step is one
    pre-aggregated minimum per node and one join of that minimum, unique per node, back to the links: a hub's
    links are split by the adaptive skew join and never meet in one group. Nodes without links don't appear.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _fold(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u > v").distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        small = large.join(low, F.col("u") == F.col("k"))
        after = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
                        .where("u > v").distinct())
        now = _fold(after)
        discard(edges, least, large, low)
        edges = after
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())


def frequent(df: DataFrame, count_col: str, most: int) -> int:
    """The least power of two such that at most `most` rows have at least that count."""
    least, room = 1 << 62, most
    by_power = df.groupBy(F.floor(F.log2(count_col)).alias("e")).count().orderBy(F.desc("e")).collect()
    for row in by_power:
        if row["count"] > room:
            break
        least, room = 1 << row["e"], room - row["count"]
    return least


def sliced(batches, most: int = 8 << 20):
    """Arrow batches in slices of about `most` bytes: what a task makes of a slice at once stays small."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        del b
        pa.default_memory_pool().release_unused()


def filtered(df: DataFrame, column: str, decide) -> DataFrame:
    """The rows of df, all columns as they are, for whose text `decide(text or "")` is true; no join, no shuffle."""
    at = df.columns.index(column)

    def run(batches):
        for b in sliced(batches):
            keep = pa.array([bool(decide(t or "")) for t in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(keep)

    return df.mapInArrow(run, df.schema)


def running_sums(df: DataFrame, key: str, order: list, value: str, start: str) -> DataFrame:
    """df with `start`: the sum of `value` over the earlier rows, by `order`, of the same key (key and value: longs, no nulls).

    Rows are dealt in ranges of (key, order), so the rows of a key spread over tasks. Each task adds up as it reads; a small
    table of the sums by key and task gives what came before. The result is written. Rows equal in order come in any order.
    """
    df = df.withColumns({key: F.col(key).cast("long"), value: F.col(value).cast("long")})
    keyed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    names, k_at, v_at = [*df.columns, "_at"], df.columns.index(key), df.columns.index(value)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k, v = b.column(k_at).to_numpy(), b.column(v_at).to_numpy()
            total = np.cumsum(v)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            before = np.repeat(total[first] - v[first], np.diff(np.append(first, len(k))))
            at = total - v - before
            if k[0] == last:
                at[: first[1] if len(first) > 1 else len(k)] += carry
            last, carry = k[-1], at[-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=names)

    out = written(keyed.mapInArrow(run, f"{kind}, _at long").withColumn("_part", F.spark_partition_id()))
    sums = out.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    before = sums.select(key, "_part", F.coalesce(F.sum("_sum").over(
        Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return out.join(before, [key, "_part"]).select(*df.columns, (F.col("_at") + F.col("_before")).alias(start))

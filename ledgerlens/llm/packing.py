"""Best-fit packing in a hierarchy of residuals.

Documents become token pieces of at most `size` tokens. Pieces are dealt at random (by hash) over tasks; each task
packs its items best-fit in decreasing order, emits the bins that are nearly full or that nothing left can still fit
into, and passes the underfull bins on, each as one item of its fill. A quarter of the tasks then packs those again,
and so on up the tree until one round on a single task, or no further gain, ends it.

Bounded memory: a task holds at most about PER_TASK items. Rounds shrink the number of tasks only as far as that holds,
so the last rounds may use several tasks when very many bins stay underfull (for example when all pieces are a little
over half the size: then no bin can take another, the smallest-item rule emits them all at once).

Defined cases: a null or empty text is the end id alone. Rows that repeat, or have null ids, are packed each for
itself (an internal row number keeps them apart). Ties in length go by row number. An empty table gives no rows.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import sliced, written
from ledgerlens.llm.tokens import encoder

#: Items (pieces or underfull bins) a task packs at once, on average.
PER_TASK = 50_000
#: A bin with at most this share of free room is emitted.
NEARLY = 1 / 256
FAN_IN = 4


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `size` behind a first one that may be shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row's whole text: ids, then end_id, cut into pieces."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = encoder(tokenizer)
        for b in sliced(batches):
            at, numbers, starts, lengths, sums = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                for number, (s, n) in enumerate(piece_bounds(len(ids), size)):
                    at.append(k)
                    numbers.append(number)
                    starts.append(s)
                    lengths.append(n)
                    sums.append(zlib.crc32(ids[s: s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(fills: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. Bins wait by their free room; the tightest that fits is taken."""
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # free rooms with waiting bins, sorted: at most `size` of them
    bins: list[list[int]] = []
    for k in np.argsort(-fills, kind="stable").tolist():
        need = int(fills[k])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = waiting[room].pop()
            if not waiting[room]:
                rooms.pop(at)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(k)
        room -= need
        if room:
            if not waiting[room]:
                insort(rooms, room)
            waiting[room].append(b)
    return bins


def pack(pieces: DataFrame, size: int, per_task: int = PER_TASK) -> DataFrame:
    """pieces (length, and any more columns) with sequence_id and offset: gapless places in sequences of `size`."""
    items = written(pieces.withColumn("item", F.monotonically_increasing_id()))
    state = items.select(F.col("length").alias("fill"), F.array("item").alias("members"), F.array("length").alias("lengths"))
    kind = "fill long, members array<bigint>, lengths array<bigint>, done boolean"
    bins = None
    tasks = before = 0
    while True:
        left = state.agg(F.count("*").alias("n"), F.min("fill").alias("least")).first()
        if not left["n"]:
            break
        wanted = -(-left["n"] // per_task)
        tasks = max(wanted, tasks // FAN_IN) if tasks else wanted
        last = tasks == 1 or (tasks == wanted and left["n"] == before)
        before, least = left["n"], int(left["least"])

        def run(batches, least=least, last=last):
            got = [pa.RecordBatch.from_arrays(b.columns, names=b.schema.names) for b in batches]
            if not got:
                return
            t = pa.Table.from_batches(got)
            fills = t.column("fill").to_numpy()
            members, lengths = t.column("members").to_pylist(), t.column("lengths").to_pylist()
            out = [[], [], [], []]
            for b in best_fit(fills, size):
                fill = int(fills[b].sum())
                out[0].append(fill)
                out[1].append([m for k in b for m in members[k]])
                out[2].append([m for k in b for m in lengths[k]])
                out[3].append(last or size - fill < max(least, size * NEARLY))
                if len(out[0]) >= 10_000:
                    yield made(out)
                    out = [[], [], [], []]
            yield made(out)

        packed = written(state.repartition(tasks, F.xxhash64("members", F.lit(tasks))).mapInArrow(run, kind))
        done = packed.where("done")
        bins = done if bins is None else bins.union(done)
        if last:
            break
        state = packed.where("not done").drop("done")
    if bins is None:
        return items.drop("item").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # a bin's number is its first member's, which is in no other bin
    placed = bins.select(F.col("members")[0].alias("sequence_id"), "members", F.expr(
        "slice(aggregate(lengths, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size(lengths))").alias("at")
    ).select("sequence_id", F.explode(F.arrays_zip("members", "at")).alias("m")).select(
        F.col("m.members").alias("item"), "sequence_id", F.col("m.at").alias("offset"))
    return items.join(placed, "item").drop("item")


def made(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64())),
         pa.array(out[3], pa.bool_())], names=["fill", "members", "lengths", "done"])


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", per_task: int = PER_TASK) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row."""
    return pack(token_pieces(df, id_col, text_col, tokenizer, end_id, size), size, per_task)

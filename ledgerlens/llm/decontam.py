"""Benchmark decontamination by size-partitioned MinHash containment search.

Items (short) are looked for inside documents (any length). Both become sets of shingles of `width` words. Containment
of an item with n distinct shingles is the share of them that a document holds.

Items are partitioned by size: classes of n in [2^j, 2^(j+1)). An item's signature is its k smallest shingle hashes
(bottom-k MinHash), with k = n - ceil(t n) + 1: a document with containment t or more lacks at most k - 1 of the item's
shingles, so it holds at least one signature hash. The search is therefore lossless at any document length, unlike
banded signatures of the document, whose Jaccard similarity with a short item is near zero. Classes that a
document is too small for are skipped. Candidates are verified by the exact shingle texts.

Documents are read once for each block of items; a block has about BLOCK shingles, which bounds what is broadcast
whatever the number of items. Documents are never shuffled. A passage in a third of the documents costs one check in each.

Words: lower case, ASCII punctuation is white space. Defined cases: an item of fewer words than `width` is one shingle
of all its words; an item (or document) without words, or null, never matches. Repeated items or rows each give rows.
Empty tables give no rows (documents without items all stay). Clashing extra columns aren't read.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import filtered, sliced, written

#: Shingles of items that are broadcast at once, about.
BLOCK = 500_000
#: Words of a document that are hashed at once.
PART = 65_536
_GAPS = bytes(32 if chr(b) in string.punctuation or b < 32 or b == 127 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_GAPS).split())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                _POWERS[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base))])
    return _POWERS[0], _POWERS[1]


def shingles(words: bytes, width: int):
    """Hash, start and end of each run of `width` words in normalised text, in parts of bounded size."""
    if not words:
        return
    a = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(a == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(a)]])
    for i in range(0, len(starts) - width + 1, PART):
        s = starts[i: min(i + PART, len(starts) - width + 1)]
        e = ends[i + width - 1: i + width - 1 + len(s)]
        low, high = int(s[0]), int(e[-1])
        power, inverse = _powers(high - low + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((a[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
            h = (sums[e - low] - sums[s - low]) * inverse[s - low]
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
        yield h, s, e


def item_shingles(words: bytes, width: int) -> dict[bytes, int]:
    """Distinct shingle texts of an item and their hashes."""
    width = min(width, words.count(b" ") + 1)
    return {words[i:j]: k for h, s, e in shingles(words, width) for k, i, j in zip(h.tolist(), s.tolist(), e.tolist())}


class Partition:
    """Items of one size class and shingle width, with their signatures."""

    def __init__(self, width: int, items: list[tuple[int, dict[bytes, int]]], threshold: float):
        self.width, self.items = width, items
        self.least = min(needed(len(x), threshold) for _, x in items)
        pairs = sorted((h, k) for k, (_, x) in enumerate(items) for h in sorted(x.values())[: len(x) - needed(len(x), threshold) + 1])
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        h = h[self.maybe[h >> np.uint64(44)]]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        return {int(k) for i, j in set(zip(low.tolist(), high.tolist())) for k in self.owner[i:j]}


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def partitions(items: list[tuple[int, bytes]], width: int, threshold: float) -> list[Partition]:
    groups: dict[tuple[int, int], list] = {}
    for number, words in items:
        if words:
            x = item_shingles(words, width)
            groups.setdefault((min(width, words.count(b" ") + 1), len(x).bit_length()), []).append((number, x))
    return [Partition(w, g, threshold) for (w, _), g in sorted(groups.items())]


def search(text: str | None, parts: list[Partition], threshold: float):
    """(item number, matched, n) of each item that the text holds to the threshold."""
    words = normalised(text)
    count = words.count(b" ") + 1 if words else 0
    by_width: dict[int, list] = {}
    for p in parts:
        if count - p.width + 1 < p.least:
            continue
        if p.width not in by_width:
            by_width[p.width] = list(shingles(words, p.width))
        found = set().union(*(p.candidates(h) for h, _, _ in by_width[p.width]))
        if not found:
            continue
        wanted = np.unique(np.array([v for k in found for v in p.items[k][1].values()], np.uint64))
        held = set()
        for h, s, e in by_width[p.width]:
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            held.update(words[i:j] for i, j in zip(s[at].tolist(), e[at].tolist()))
        for k in sorted(found):
            number, x = p.items[k]
            matched = len(x.keys() & held)
            if matched >= needed(len(x), threshold):
                yield number, matched, len(x)


def blocks(items: DataFrame, text_col: str, width: int, threshold: float, block: int = BLOCK):
    """Broadcast partitions and the item rows of each block, an item whole."""
    spark = items.sparkSession
    rows = written(items.withColumn("item_row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.length(text_col) / 5 + 1).alias("n")).first()["n"] or 0
    count = max(1, math.ceil(size / block))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_row"), F.lit(count)) == k)
        got = [(r["item_row"], normalised(r[text_col])) for r in part.select("item_row", text_col).collect()]
        yield spark.sparkContext.broadcast(partitions(got, width, threshold)), part


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", width: int = 5, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(id, item, matched, n_shingles, containment) of every pair at or over the threshold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("item_text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, item_row long, matched long, n_shingles long"
    out = None
    for shared, part in blocks(bench, "item_text", width, threshold, block):
        def run(batches, shared=shared):
            for b in sliced(batches):
                at, found = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    for x in search(text, shared.value, threshold):
                        at.append(k)
                        found.append(x)
                columns = [pa.array([x[c] for x in found], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns],
                                                 names=["id", "item_row", "matched", "n_shingles"])

        got = rows.mapInArrow(run, kind).join(part.select("item_row", "item"), "item_row").select(
            "id", "item", "matched", "n_shingles", (F.col("matched") / F.col("n_shingles")).alias("containment"))
        out = got if out is None else out.union(got)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", width: int = 5,
                  threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that hold no item to the threshold."""
    bench = items.select(F.col(item_text).cast("string").alias("item_text"))
    for shared, _ in blocks(bench, "item_text", width, threshold, block):
        docs = filtered(docs, text_col, lambda t, shared=shared: next(search(t, shared.value, threshold), None) is None)
    return docs

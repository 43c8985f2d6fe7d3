"""SimHash near-duplicates with pivot distance tables.

Fingerprint: one bit vector of 64 votes over the XXH64 hashes of all word shingles, repeats included. Distinct
fingerprints get a table of Hamming distances to many fixed reference fingerprints (pivots). By the triangle
inequality two fingerprints within k bits differ by at most k in every coordinate, so a pair whose largest
coordinate difference is over k is discarded, and survivors are verified bit by bit.

The table is made once, as columns beside each distinct fingerprint, and travels with it. Coordinates of random fingerprints
crowd around 32, so they can discard pairs but not deal them out to tasks. Pairs are therefore met by pigeonhole: of `blocks` bit ranges at least blocks - k are equal, and each choice of that many
ranges is one equi-key. That is lossless for every k < blocks.

Hot keys: exact copies collapse to one fingerprint before any pair is made. A key with more fingerprints than
CHUNK is dealt out as a grid of chunk pairs; in a cell the fingerprints lie in order of their first coordinate, so only those
in its range are paired, and the cell returns a spanning forest of its links, not all pairs.

Defined cases: a null, empty or white-space text has fingerprint zero, linked like any other. Repeated rows each give
a row. A null id takes part but is never a component's id unless all ids of it are null (then null). An empty table
gives no rows. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlens.llm.common import components, sliced, written

SEED = 42
#: Fingerprints of one key compared in one piece.
CHUNK = 1024
#: Keys up to this size return all their links; larger ones a spanning forest.
FEW = 8


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1:].tolist())]


def fingerprint(text: bytes, width: int) -> int:
    hashes = shingle_hashes(text, width)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at: at + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row's whole text as a signed long."""
    def run(batches):
        for b in sliced(batches):
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def pivots(count: int) -> np.ndarray:
    """Fixed reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def with_coordinates(distinct: DataFrame, references: np.ndarray) -> DataFrame:
    """distinct with its pivot table: the Hamming distances of fp to the references, eight to a long, in columns c0, c1, ..."""
    def packed(some):
        apart = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("long") for p in some]
        return sum((F.shiftleft(d, 8 * k) for k, d in enumerate(apart)), F.lit(0).cast("long"))

    return distinct.withColumns({f"c{at // 8}": packed(references.view(np.int64)[at: at + 8]) for at in range(0, len(references), 8)})


def coordinates(columns: list[np.ndarray]) -> np.ndarray:
    """The table of the packed columns, a row for each reference (uint8)."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype("<i8").view(np.uint8).T)


def _near(fa, ca, fb, cb, i, j, bits):
    """The pairs (i, j) that pass every coordinate and then the bit count."""
    for x, y in zip(ca, cb):
        keep = np.abs(x[i].astype(np.int16) - y[j]) <= bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fa[i] ^ fb[j]) <= bits
    return i[keep], j[keep]


def _forest(size: int, i: np.ndarray, j: np.ndarray):
    """A spanning forest of the graph of pairs (i, j) over `size` nodes."""
    order = np.argsort(np.concatenate([i, j]), kind="stable")
    to = np.concatenate([j, i])[order]
    first = np.searchsorted(np.concatenate([i, j])[order], np.arange(size + 1))
    seen, out_i, out_j = np.zeros(size, bool), [], []
    for start in np.flatnonzero(np.diff(first)).tolist():
        if seen[start]:
            continue
        seen[start], stack = True, [start]
        while stack:
            k = stack.pop()
            new = to[first[k]: first[k + 1]]
            new = new[~seen[new]]
            if len(new):
                new = np.unique(new)
                seen[new] = True
                out_i += [k] * len(new)
                out_j += new.tolist()
                stack += new.tolist()
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def _group_links(fps, sides, table, bits):
    """Links among the fingerprints of one large key; where both sides occur, between the sides only."""
    a = np.flatnonzero(sides <= 1)
    b = np.flatnonzero(sides == 2) if (sides == 2).any() else a
    ordered = b[np.argsort(table[0][b], kind="stable")]
    first = table[0][ordered].astype(np.int16)
    got_i, got_j = [], []
    for at in range(0, len(a), 256):
        some = a[at: at + 256]
        here = table[0][some].astype(np.int16)
        low, high = np.searchsorted(first, here - bits, "left"), np.searchsorted(first, here + bits, "right")
        count = high - low
        i = np.repeat(some, count)
        j = ordered[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)]
        if b is a:
            keep = i < j
            i, j = i[keep], j[keep]
        i, j = _near(fps, table, fps, table, i, j, bits)
        got_i.append(i)
        got_j.append(j)
    i, j = _forest(len(fps), np.concatenate(got_i), np.concatenate(got_j))
    return fps[i], fps[j]


def _links(keys, fps, sides, table, bits):
    """Links of the rows of whole keys, sorted by key."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    out = []
    for s, n in zip(edges[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        out.append(_group_links(fps[s: s + n], sides[s: s + n], table[:, s: s + n], bits))
    small = np.repeat((sizes <= FEW) & (sizes > 1), sizes)
    fps, keys, sides, table = fps[small], keys[small], sides[small], table[:, small]
    if len(fps):
        at = np.arange(len(fps))
        for step in range(1, FEW):
            at = at[at + step < len(fps)]
            at = at[keys[at] == keys[at + step]]
            ok = at[(sides[at] == 0) | (sides[at] != sides[at + step])]
            i, j = _near(fps, table, fps, table, ok, ok + step, bits)
            out.append((fps[i], fps[j]))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def links(distinct: DataFrame, max_bits: int = 4, blocks: int = 6, n_pivots: int = 16) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most max_bits apart.

    Their connected components are exactly those of all such pairs; large keys return spanning forests only.
    """
    if not 0 <= max_bits < blocks:
        raise ValueError("blocks must be over max_bits")
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    ranges = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    masks = [sum(c) for c in combinations(ranges, blocks - max_bits)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    references = pivots(n_pivots)
    tables = [f"c{k}" for k in range(-(-n_pivots // 8))]
    keyed = with_coordinates(distinct.select("fp"), references).select("fp", *tables, F.explode(F.array(*[
        F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for n, m in enumerate(masks)
    ])).alias("k")).select(F.xxhash64("k.choice", "k.bits").alias("key"), "fp", *tables)
    # keys that collide in the 64-bit hash only add pairs to verify
    groups = written(keyed.groupBy("key").count().where("count > 1")
                     .select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")))
    met = keyed.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    cells = met.select("key", "fp", *tables, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), *tables)

    def run(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32), *[np.empty(0, np.int64)] * len(tables)]

        def found(some):
            x, y = _links(*some[:3], coordinates(some[3:]), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for b in batches:
            new = [c.to_numpy() for c in b.columns]
            new[1] = new[1].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on in the next batch
            yield found([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        if len(held[0]):
            yield found(held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
                    max_bits: int = 4, blocks: int = 6, n_pivots: int = 16) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links of at most max_bits bits."""
    docs = written(fingerprints(df, id_col, text_col, shingle_words))
    distinct = written(docs.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = components(links(distinct.select("fp"), max_bits, blocks, n_pivots))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    of = written(of)
    # written first, so that the adaptive join can split a component with very many fingerprints
    least = written(of.groupBy("root").agg(F.min("least_id").alias("component")))
    named = written(of.join(least, "root").select("fp", "component"))
    return docs.join(named, "fp").select("id", "fp", "component")

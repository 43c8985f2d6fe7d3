"""Exact top-k inner-product search with M-trees.

Inner products become a metric: with M the largest norm, each vector x gets one more component sqrt(M^2 - |x|^2) and a
query q gets 0 there; then D(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest are the highest scores.

Index: vectors are dealt by their nearest of a few centres (a bounded sample, CENTRES) and the distance to it, over
range partitions of about ROWS vectors each, ties by id, so that no crowded place makes a large partition. Each
partition becomes an M-tree, written as pages: a node's routing object is one of its vectors, with the covering
radius, its distance to the parent's routing object, the least id below it, and in leaves each vector's distance to the
routing object. Every row is indexed.

Search: queries in blocks of about QUERIES (broadcast, bounded), each against every tree. Within a tree best-first: the
page with the highest possible score next, and |D(q, parent) - D(o, parent)| - radius, from stored distances alone,
tells which pages and vectors need no distance computation. The k-th score of each query against a sample of about
SAMPLE rows is the bound to start from. Bounds are rounded in the safe direction and scores are exact integers, so the
result is exact, ties (smaller id first) included.

Defined cases: null vectors, and such with null, NaN or infinite components take no part, nor do null ids. Only vectors
of equal length are compared. Repeated candidate rows each take a place; if a query id repeats, its smallest vector asks.
Queries with fewer candidates return all. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

CENTRES, SAMPLE, ROWS, QUERIES = 64, 1024, 4096, 2048
PAGE, FAN_OUT = 64, 16


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each usable vector, as doubles without fractions."""
    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().cast(pa.float64())
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # null components read as NaN
            ok = (bad[ends] == bad[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            ok &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            x = np.floor(np.where(np.isfinite(x), x, 0) * scale)
            keep = np.flatnonzero(ok)
            values = x[np.repeat(ok, sizes)]
            offsets = np.concatenate([[0], np.cumsum(sizes[keep])])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))], names=["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        run, "id long, v array<double>")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows of a with b (one or more rows)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if top < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([int(x) for x in b], object)
    return np.clip(exact, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - point) ** 2).sum(axis=1))


def build(ids: np.ndarray, vectors: np.ndarray, norm2: float) -> list[dict]:
    """Pages of an M-tree, a parent before its children. Page 0 is the root."""
    points = lifted(vectors, norm2)
    pages: list[dict] = []

    def split(members: np.ndarray, parts: int) -> list[np.ndarray]:
        """Even halves along the distance to a far member, again and again."""
        if parts <= 1 or len(members) <= PAGE:
            return [members]
        far = members[int(np.argmax(distances(points[members], points[members[0]])))]
        order = members[np.argsort(distances(points[members], points[far]), kind="stable")]
        half = len(order) // 2
        return split(order[:half], parts // 2) + split(order[half:], parts // 2)

    def node(members: np.ndarray, parent: int, parent_routing: int) -> None:
        routing = int(members[np.argmin(distances(points[members], points[members].mean(axis=0)))])
        own = distances(points[members], points[routing])
        number, leaf = len(pages), len(members) <= PAGE
        pages.append({
            "page": number, "parent": parent, "routing": vectors[routing], "radius": float(own.max()), "least_id": int(ids[members].min()),
            "parent_distance": float(distances(points[routing: routing + 1], points[parent_routing])[0]) if parent >= 0 else 0.0,
            "ids": ids[members] if leaf else [], "own": own if leaf else [], "vectors": vectors[members].ravel() if leaf else []})
        if not leaf:
            for part in split(members, FAN_OUT):
                node(part, number, routing)

    if len(ids):
        node(np.arange(len(ids)), -1, -1)
    return pages


class Best:
    """The k best (score, id) of one query so far; `floor` is a score that k candidates are known to reach."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = scores >= self.floor
        scores, ids = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))

    def may_take(self, score: int, least_id: int) -> bool:
        if score != self.floor:
            return score > self.floor
        full = len(self.ids) == self.k and self.scores[-1] == score
        return not full or least_id < self.ids[-1]


def search(pages: list[dict], children: list[list[int]], q: np.ndarray, own_id: int, norm2: float, best: Best) -> int:
    """Best-first over one tree; returns the number of distances computed."""
    base = float(q @ q) + norm2
    slack = 1e-3 + 1e-12 * base

    def highest(least_distance: float) -> int:  # the highest score at that distance or over it
        return math.floor((base - max(0.0, least_distance) ** 2) / 2 + slack)

    def to(page: int) -> float:
        return math.sqrt(max(0.0, base - 2.0 * float(pages[page]["routing"] @ q)))

    d = to(0)
    seen = 1
    heap = [(-highest(d - pages[0]["radius"]), 0, d)]
    while heap:
        bound, number, d = heapq.heappop(heap)
        page = pages[number]
        if -bound < best.floor:
            break
        if not best.may_take(-bound, page["least_id"]):
            continue
        if len(page["ids"]):
            gap = np.abs(d - page["own"])
            near = np.floor((base - gap * gap) / 2 + slack) >= best.floor
            near &= page["ids"] != own_id
            if near.any():
                seen += int(near.sum())
                best.add(products(page["vectors"][near], q), page["ids"][near])
            continue
        for c in children[number]:
            child = pages[c]
            if not best.may_take(highest(abs(d - child["parent_distance"]) - child["radius"]), child["least_id"]):
                continue
            dc = to(c)
            seen += 1
            score = highest(dc - child["radius"])
            if best.may_take(score, child["least_id"]):
                heapq.heappush(heap, (-score, c, dc))
    return seen


PAGES = ("tree long, dim int, page int, parent int, routing array<double>, radius double, least_id long, parent_distance double, "
         "ids array<bigint>, own array<double>, vectors array<double>")


def _sample(vectors: DataFrame, n: int, size: int, seed: int) -> pa.Table:
    """About `size` of the n rows (all, if fewer). Which rows decides on pruning only, not on results."""
    return (vectors if n <= size else vectors.where(F.rand(seed) < size / n)).toArrow()


def index(vectors: DataFrame, norm2: float, rows: int = ROWS) -> DataFrame:
    """The pages of all trees, written. vectors: (id, v)."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = _sample(vectors, n, CENTRES, 5).column("v").to_pylist()
    groups: dict[int, np.ndarray] = {}
    for v in sample:
        groups[len(v)] = np.vstack([groups[len(v)], v]) if len(v) in groups else np.array([v], float)
    shared = spark.sparkContext.broadcast({k: lifted(c, norm2) for k, c in groups.items()})

    def near(batches):
        for b in batches:
            ids, vs = b.column(0), b.column(1)
            centre, distance = np.zeros(len(ids), np.int32), np.zeros(len(ids))
            sizes = vs.value_lengths().to_numpy()
            flat, ends = vs.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                c = shared.value.get(dim)
                if c is None:
                    continue
                x = lifted(flat[(ends[at] - dim)[:, None] + np.arange(dim)], norm2)
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T))
                centre[at], distance[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([ids, vs, pa.array(sizes.astype(np.int32)), pa.array(centre), pa.array(distance)],
                                             names=["id", "v", "dim", "centre", "distance"])

    placed = vectors.mapInArrow(near, "id long, v array<double>, dim int, centre int, distance double")
    order = ("dim", "centre", "distance", "id")
    placed = placed.repartitionByRange(max(1, -(-n // rows)), *order).withColumn("tree", F.spark_partition_id())

    def pages(batches):
        tables = [pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks()
        sizes, tree = t.column("dim").to_numpy(), int(t.column("tree")[0].as_py())
        for dim in np.unique(sizes).tolist():
            part = t.filter(pa.array(sizes == dim))
            flat = part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, dim)
            made = build(part.column("id").to_numpy(), flat, norm2)
            for i in range(0, len(made), 256):
                some = made[i: i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree * 4096 + dim % 4096] * len(some), pa.int64()), pa.array([dim] * len(some), pa.int32())]
                    + [pa.array([p[k] for p in some], t) for k, t in (
                        ("page", pa.int32()), ("parent", pa.int32()), ("routing", pa.list_(pa.float64())), ("radius", pa.float64()),
                        ("least_id", pa.int64()), ("parent_distance", pa.float64()), ("ids", pa.list_(pa.int64())),
                        ("own", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64())))],
                    names=["tree", "dim", "page", "parent", "routing", "radius", "least_id", "parent_distance", "ids", "own", "vectors"])

    return written(placed.mapInArrow(pages, PAGES))


def _trees(batches):
    """Whole trees from rows sorted by tree and page."""
    held: list[dict] = []
    for b in batches:
        for p in b.to_pylist():
            if held and (p["tree"], p["dim"]) != (held[0]["tree"], held[0]["dim"]):
                yield held
                held = []
            p["routing"], p["ids"], p["own"] = (np.array(p[k]) for k in ("routing", "ids", "own"))
            p["vectors"] = np.array(p["vectors"], float).reshape(len(p["ids"]), p["dim"])
            held.append(p)
    if held:
        yield held


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
          rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query. is_query: over column id."""
    spark = df.sparkSession
    vectors = written(whole_vectors(df, id_col, vector_col, scale))
    norm2 = float(vectors.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.max("n")).first()[0] or 0.0)
    asked = written(vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    trees = index(vectors, norm2, rows)
    sample = _sample(vectors, vectors.count(), SAMPLE, 6)
    n_blocks = max(1, math.ceil(asked.count() / queries))
    result = None
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast(_with_floors(part, sample, k))

        def run(batches, shared=shared):
            found = [Best(k, floor) for _, _, floor in shared.value]
            for pages in _trees(batches):
                children: list[list[int]] = [[] for _ in pages]
                for p in pages[1:]:
                    children[p["parent"]].append(p["page"])
                for (own_id, q, _), best in zip(shared.value, found):
                    if len(q) == pages[0]["dim"]:
                        search(pages, children, q, own_id, norm2, best)
            rows_out = [(own_id, i, s) for (own_id, _, _), best in zip(shared.value, found)
                        for i, s in zip(best.ids.tolist(), best.scores.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_out], pa.int64()) for c in range(3)],
                                             names=["query_id", "vec_id", "score"])

        got = trees.repartition("tree", "dim").sortWithinPartitions("tree", "dim", "page").mapInArrow(
            run, "query_id long, vec_id long, score long")
        result = got if result is None else result.union(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_floors(part: pa.Table, sample: pa.Table, k: int) -> list[tuple[int, np.ndarray, int]]:
    """Id, vector and starting floor (k-th score within the sample) of each query of a block."""
    by_dim: dict[int, list] = {}
    for i, v in zip(sample.column("id").to_pylist(), sample.column("v").to_pylist()):
        by_dim.setdefault(len(v), []).append((i, v))
    held = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x], float)) for d, x in by_dim.items()}
    out = []
    for i, v in zip(part.column("id").to_pylist(), part.column("v").to_pylist()):
        q, floor = np.array(v, float), -(2 ** 63)
        if len(q) in held:
            ids, vs = held[len(q)]
            scores = np.sort(products(vs[ids != i], q))
            if len(scores) >= k:
                floor = int(scores[-k])
        out.append((i, q, floor))
    return out

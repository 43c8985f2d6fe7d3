"""A trie of conversations by their turns, built as z-fast tries over ranges of paths.

A conversation's path is its turns' digests (16 bytes of SHA-256 over role and text) in order. Copies of a path are collapsed
first. Distinct paths are dealt in ranges of their bytes, which is the order of a walk through the trie, so however many
conversations share their first turns, their subtree spreads over tasks. Each task inserts its range, batch by batch, into a
z-fast trie: compacted nodes are found by the hash of their handle, the prefix whose depth is the two-fattest number of the
edge; a path's exit node is found by fat binary search in log2(depth) look-ups; of those that leave at the same place with the
same turn one is inserted, the others look again. Then edges are expanded to one row for each depth.

A node belongs to one task unless it lies on the first or the last path of its task (the rim). Rim nodes of neighbouring tasks
may be the same: they carry partial sums, are merged by prefix hash, and a last small step, of at most two paths for each task,
sums their subtrees. The hash of the ids that end at a node streams ids in order; only lists that cross a task's border are
finished, from text chunks, in a second pass.

Bounds: a task holds one range of distinct paths (16 bytes a turn, twice) and the rim step two paths a task. A path is one
value: a conversation's digests and word counts (24 bytes a turn; never its texts) have to fit into a task.

Defined cases: rows without conversation id take no part; turns go by turn (null first), role, then SHA-256 of the text; null
roles and texts are empty. A conversation without turns is a member of the root alone. Rows that repeat are turns that repeat.
An empty table gives no rows, not even a root. Only the four named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

#: Paths that are looked up together; turns of a task's paths; characters of an id list handed on at once; bytes of a digest.
BATCH = 2048
PER_TASK = 250_000
CHUNK = 1 << 16
WIDTH = 16


def conversation_paths(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (digest, words)) of each conversation, its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"), F.unhex(digest).alias("digest"),
                    F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_start(paths: DataFrame, block: int, shared: int) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % block for its own; h = crc32(c) % (shared + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared + 1)).cast("int")
    starts = paths.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("from"), F.slice("turns", 1, shared).alias("start"))
    joined = paths.withColumns({"h": h, "from": F.col("conv_id") - F.col("conv_id") % block}).join(starts, "from", "left")
    none = F.slice("turns", 1, 0)
    start = F.when(F.col("start").isNull(), none).otherwise(F.slice("start", F.lit(1), F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(start, own).alias("turns"))


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of paths: node k has an extent (a depth of its representative path) and a parent; node 0 is the root."""

    def __init__(self):
        self.extent, self.parent, self.of, self.ends = [0], [-1], [b""], [None]
        self.handles: dict[bytes, int] = {}  # hash of the prefix of two-fattest depth: node
        self.names: dict[bytes, int] = {}  # hash of the prefix one deeper than the parent's extent: node

    @staticmethod
    def hashes(path: bytes) -> bytes:
        """The 16-byte hash of each prefix of a path of 16-byte turns, in a row."""
        out, h = [], b""
        for k in range(0, len(path), WIDTH):
            h = hashlib.blake2b(h + path[k: k + WIDTH], digest_size=WIDTH).digest()
            out.append(h)
        return b"".join(out)

    @staticmethod
    def at(hashes: bytes, depth: int) -> bytes:
        return hashes[(depth - 1) * WIDTH: depth * WIDTH]

    def exit(self, hashes: bytes) -> tuple[int, int]:
        """The exit node of a path, and how deep the two agree."""
        depth, at = len(hashes) // WIDTH, self.at
        low, high, node, found = 0, depth, 0, None
        while low < high:
            f = two_fattest(low, high)
            k = self.handles.get(at(hashes, f))
            if k is None:
                high = f - 1
            elif self.extent[k] <= depth and at(hashes, self.extent[k]) == at(self.of[k], self.extent[k]):
                low, node = self.extent[k], k
            else:
                found = k  # through the handle but not to the extent
                break
        if found is None:
            found = self.names.get(at(hashes, low + 1)) if low < depth else None
        if found is None:
            return node, low
        low, high = self.extent[self.parent[found]], min(depth, self.extent[found])
        while low < high:
            middle = (low + high + 1) // 2
            if at(hashes, middle) == at(self.of[found], middle):
                low = middle
            else:
                high = middle - 1
        return found, low

    def _handle(self, node: int) -> bytes:
        return self.at(self.of[node], two_fattest(self.extent[self.parent[node]], self.extent[node]))

    def _add(self, extent: int, parent: int, hashes: bytes) -> int:
        node = len(self.extent)
        self.extent.append(extent)
        self.parent.append(parent)
        self.of.append(hashes)
        self.ends.append(None)
        self.names[self.at(hashes, self.extent[parent] + 1)] = node
        self.handles[self._handle(node)] = node
        return node

    def _split(self, node: int, depth: int) -> int:
        """A new node at this depth of the edge above node."""
        del self.handles[self._handle(node)]
        upper = self._add(depth, self.parent[node], self.of[node])
        self.parent[node] = upper
        self.names[self.at(self.of[node], depth + 1)] = node
        self.handles[self._handle(node)] = node
        return upper

    def insert(self, batch: list[tuple[bytes, object]]) -> None:
        """Insert (prefix hashes, value) pairs of different paths; value is kept at the node where the path ends."""
        while batch:
            leaving: dict[int, dict[int, dict[bytes, tuple]]] = {}
            again = []
            for item in batch:
                node, depth = self.exit(item[0])
                here = leaving.setdefault(node, {}).setdefault(depth, {})
                way = self.at(item[0], depth + 1)
                if way in here:
                    again.append(item)
                else:
                    here[way] = item
            for node, depths in leaving.items():
                for depth in sorted(depths, reverse=True):  # from the lower end of the edge, whose upper piece goes on
                    if depth < self.extent[node]:
                        node = self._split(node, depth)
                    for way, (hashes, value) in depths[depth].items():
                        self.ends[self._add(len(hashes) // WIDTH, node, hashes) if way else node] = value
            batch = again


NODE = ("key binary, parent binary, depth int, words long, n_convs long, conv_id long, parent_conv_id long, n_children long, "
        "n_leaves long, saved long, class binary, rim boolean")


def expanded(paths: list[tuple[bytes, int, int, bytes, np.ndarray]]):
    """The nodes (as NODE) of sorted distinct paths: (path, number of conversations, least id, class, words by turn).

    Rows of rim nodes hold what this task knows: counts of their members, and sums over the subtrees that hang on the rim.
    """
    trie = ZFastTrie()
    for k in range(0, len(paths), BATCH):
        trie.insert([(ZFastTrie.hashes(p[0]), p) for p in paths[k: k + BATCH]])
    at, size = ZFastTrie.at, len(trie.extent)
    ending = {id(p): node for node, p in enumerate(trie.ends) if p is not None}
    rim = {0}
    for p in (paths[0], paths[-1]):
        node = ending[id(p)]
        while node not in rim:
            rim.add(node)
            node = trie.parent[node]
    n, least, words = [0] * size, [None] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    order = sorted(range(size), key=trie.extent.__getitem__, reverse=True)
    for node in order:
        mine, up = trie.ends[node], trie.parent[node]
        if mine is not None:
            n[node] += mine[1]
            least[node] = mine[2] if least[node] is None else min(least[node], mine[2])
            words[node] = mine[4]
        if node not in rim and not children[node]:
            leaves[node] = 1
        if up < 0:
            continue
        n[up] += n[node]
        least[up] = least[node] if least[up] is None else min(least[up], least[node])
        words[up] = words[node]
        if node not in rim:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node] + (n[node] - 1) * int(words[node][trie.extent[up]: trie.extent[node]].sum())
    for node in order:
        mine, up, h, on_rim = trie.ends[node], trie.parent[node], trie.of[node], node in rim
        sums = [children[node], leaves[node], saved[node]]
        for depth in range(trie.extent[node], trie.extent[up] if up >= 0 else -1, -1):
            w = int(words[node][depth - 1]) if depth else 0
            if not on_rim:
                sums[2] += (n[node] - 1) * w
            above = None if not depth else at(h, depth - 1) if depth > 1 else b""
            inside = depth > trie.extent[up] + 1 if up >= 0 else False
            known = None if on_rim else least[node] if inside else None if up in rim else least[up]
            yield (at(h, depth) if depth else b"", above, depth, w, n[node], least[node], known, *sums, mine[3] if mine else None, on_rim)
            mine, sums = None, [0, 0, 0] if on_rim else [1, *sums[1:]]


def _nodes(rows) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _local_tries(batches):
    paths = []
    for b in batches:
        lists = b.column(4)
        offsets, words = lists.offsets.to_numpy(), lists.values.to_numpy()
        paths += zip(*(b.column(k).to_pylist() for k in range(4)), [words[i:j] for i, j in zip(offsets, offsets[1:])])
    nodes = expanded(paths) if paths else iter(())
    while rows := list(islice(nodes, 8192)):
        yield _nodes(rows)


def _rim_sums(batches):
    """Merged rim nodes, deepest first, with the sums over what hangs on the rim added."""
    left: dict[bytes, list] = {}
    for b in batches:
        out = []
        for key, up, depth, words, n, least, _, children, leaves, saved, mine, _ in zip(*(c.to_pylist() for c in b.columns)):
            more = left.pop(key, (0, 0, 0))
            children += more[0]
            leaves = leaves + more[1] or 1
            saved += more[2] + (n - 1) * words
            if up is not None:
                above = left.setdefault(up, [0, 0, 0])
                for k, x in enumerate((1, leaves, saved)):
                    above[k] += x
            out.append((key, up, depth, words, n, least, None, children, leaves, saved, mine, True))
        if out:
            yield _nodes(out)


def ends(members: DataFrame) -> DataFrame:
    """(class, ends_sha256): the digest of each class's ids, ascending, joined by commas. members: (class binary, conv_id long)."""
    dealt = members.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")

    def batch(rows):
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["class", "first", "sha", "chunk"])

    def run(batches):
        now, parts, size, start, first_run, out = None, [], 0, 0, True, []
        for b in batches:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now != key:
                    if parts:
                        text = ",".join(parts)
                        # a list that starts and ends inside the task is whole
                        out.append((now, start, None, text) if first_run else (now, start, hashlib.sha256(text.encode()).hexdigest(), None))
                        first_run = False
                    now, parts, size, start = key, [], 0, conv
                elif size > CHUNK:
                    out.append((now, start, None, ",".join(parts)))
                    parts, size, start, first_run = [], 0, conv, True
                parts.append(str(conv))
                size += len(parts[-1]) + 1
                if len(out) >= 4096 or out and out[-1][3] and len(out) >= 64:
                    yield batch(out)
                    out = []
        if parts:
            out.append((now, start, None, ",".join(parts)))
        if out:
            yield batch(out)

    def finish(batches):
        now, sha, out = None, None, []
        for b in batches:
            for key, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if now == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((now, None, sha.hexdigest(), None))
                    now, sha = key, hashlib.sha256()
                sha.update(chunk.encode())
        if sha:
            out.append((now, None, sha.hexdigest(), None))
        if out:
            yield batch(out)

    kind = "class binary, first long, sha string, chunk string"
    parts = written(dealt.mapInArrow(run, kind))
    rest = parts.where("sha is null").select("class", "first", "chunk").repartition("class").sortWithinPartitions("class", "first")
    return parts.where("sha is not null").select("class", F.col("sha").alias("ends_sha256")).union(
        rest.mapInArrow(finish, kind).select("class", "sha"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. paths: (conv_id, turns), as conversation_paths gives them."""
    # hexadecimal text is joined to one value; a turn's digest is 16 bytes, so the order of bytes is that of the walk
    joined = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    flat = written(paths.select("conv_id", joined.alias("path"), F.col("turns")["words"].alias("words")).select(
        "conv_id", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * WIDTH)).alias("class"), F.unhex("path").alias("path"), "words"))
    classes = written(flat.groupBy("class").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
                                                F.first("words").alias("words")).select("path", "n", "least", "class", "words"))
    turns = classes.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    tasks = max(-(-turns // PER_TASK), min(paths.sparkSession.sparkContext.defaultParallelism, turns // BATCH), 1)
    nodes = written(classes.repartitionByRange(tasks, "path").sortWithinPartitions("path").mapInArrow(_local_tries, NODE))
    firsts = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")]
    rim = nodes.where("rim").groupBy("key").agg(*firsts, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                                F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("class").alias("class"), F.lit(True).alias("rim"))
    rim = written(rim.select(*nodes.columns).coalesce(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_rim_sums, NODE))
    # a task knows the parents inside it, those on the rim are looked up
    up = rim.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    below = nodes.where("not rim and parent_conv_id is null").union(rim).join(up, "parent", "left")
    known = nodes.where("not rim and parent_conv_id is not null").withColumn("up", F.col("parent_conv_id")).unionByName(below)
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
               F.col("saved").alias("saved_tokens")]
    # only nodes where a conversation ends have a class
    nothing = hashlib.sha256(b"").hexdigest()
    return known.where("class is null").select(*columns, F.lit(nothing).alias("ends_sha256")).union(
        known.where("class is not null").join(ends(flat.select("class", "conv_id")), "class").select(*columns, "ends_sha256"))

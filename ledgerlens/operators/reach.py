"""How many cells each cell of a dependency graph reaches, without writing the transitive closure.

1. A cell with one dependent reaches that dependent and what it reaches. Such runs end at a cell with no or several
   dependents, found for all cells at once by doubling pointers: log2 of the longest run rounds.
2. Cells with several dependents are start cells. 64 of them share a word; a row (cell, word, bits) tells which of them
   reach the cell, and a round passes on only bits that are new. Rounds follow the longest path in a graph in which each
   run of cells with one precedent and one dependent is a single, weighted cell. Start cells go in blocks, so the
   state is at most cells x words of a block.
3. A run that ends on a cycle may meet its own cells again, so its cells are start cells too, in a second pass.

Pointers, frontiers and states are written each round: a lost executor recomputes one round at most, and the planner sees
the size of the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import _round, row_positions

KEY = ["book", "cell"]


def run_ends(step: DataFrame) -> DataFrame:
    """(book, cell, end, hops) of pointers (book, cell, nxt), one a cell: the first cell without a pointer and the hops to it;
    end is null for a cell whose pointers lead into a cycle."""
    known = step.select("book", F.col("cell").alias("nxt"), F.lit(True).alias("_open"))
    p = _round(step.join(known, ["book", "nxt"], "left").select(
        *KEY, "nxt", F.lit(1).cast("long").alias("hops"), F.coalesce("_open", F.lit(False)).alias("open")))
    left, before = p.where("open").count(), None
    # after k rounds the open pointers have run 2^k hops, and the next round ends those with at most 2^(k + 1) to go. A cell with
    # more to go has such a cell on its way, so once a round ends none, all that are open lead into a cycle
    while left and left != before:
        at = p.select(F.col("book").alias("_b"), F.col("cell").alias("_c"), F.col("nxt").alias("_n"), F.col("hops").alias("_h"),
                      F.col("open").alias("_o"))
        met = (F.col("book") == F.col("_b")) & (F.col("nxt") == F.col("_c"))
        still = p.where("open").join(at, met).select(*KEY, F.col("_n").alias("nxt"), (F.col("hops") + F.col("_h")).alias("hops"),
                                                     F.col("_o").alias("open"))
        p = _round(p.where("not open").unionByName(still))
        left, before = p.where("open").count(), left
    return p.select(*KEY, F.when(~F.col("open"), F.col("nxt")).alias("end"), "hops")


def weighted(e: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (book, cell, dep) in which each run of cells with one precedent and one dependent is its first cell, and that
    cell's weight (book, cell, weight). Start cells stay; edges of cells that nothing reaches and that don't start go."""
    reached = e.select("book", F.col("dep").alias("cell")).distinct()
    e = _round(e.join(reached.unionByName(starts.select(*KEY)).distinct(), KEY, "left_semi"))
    out = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_out"), F.min("dep").alias("nxt"))
    into = e.groupBy("book", F.col("dep").alias("cell")).agg(F.count(F.lit(1)).alias("_in"))
    through = _round(out.where("_out = 1").join(into.where("_in = 1"), KEY).join(starts, KEY, "left_anti").select(*KEY, "nxt"))
    # a run that closes on itself is reached from nowhere else
    runs = run_ends(through).where("end is not null")
    inner = e.join(through.select(*KEY), KEY, "left_semi").select("book", F.col("dep").alias("cell")).join(through, KEY, "left_semi")
    heads = _round(runs.join(inner, KEY, "left_anti"))
    kept = e.join(through, KEY, "left_anti").unionByName(heads.select(*KEY, F.col("end").alias("dep")))
    return _round(kept.select(*KEY, "dep")), heads.select(*KEY, F.col("hops").alias("weight"))


def reach_counts(e: DataFrame, starts: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """(book, cell, cascade_size, on_cycle) of the start cells: the cells they reach, themselves not counted, and whether they
    reach themselves. At most `at_once` start cells share a state."""
    numbered = _round(row_positions(starts.select(*KEY).distinct(), KEY))
    total, done = numbered.count(), []
    if not total:
        return starts.select(*KEY).limit(0).selectExpr("*", "0L AS cascade_size", "false AS on_cycle")
    graph, weights = weighted(e, numbered)
    for low in range(0, total, at_once):
        block = numbered.where((F.col("_pos") >= low) & (F.col("_pos") < low + at_once)).select(
            *KEY, F.floor(F.col("_pos") / 64).alias("word"), F.expr("shiftleft(1L, cast(_pos % 64 AS int))").alias("bits"))
        frontier = block
        known = None
        while True:
            new = (frontier.join(graph, KEY).select("book", F.col("dep").alias("cell"), "word", "bits")
                   .groupBy(*KEY, "word").agg(F.bit_or("bits").alias("bits")))
            if known is None:
                frontier = known = _round(new)
            else:
                held = known.withColumnRenamed("bits", "_held")
                frontier = _round(new.join(held, [*KEY, "word"], "left").select(
                    *KEY, "word", F.expr("bits & ~coalesce(_held, 0L)").alias("bits")).where("bits <> 0"))
                if not frontier.isEmpty():
                    known = _round(known.unionByName(frontier).groupBy(*KEY, "word").agg(F.bit_or("bits").alias("bits")))
            if frontier.isEmpty():
                break
        w = F.coalesce("weight", F.lit(1).cast("long"))
        sums = known.join(weights, KEY, "left").groupBy("word").agg(
            F.array(*[F.sum(F.expr(f"shiftright(bits, {k}) & 1L") * w) for k in range(64)]).alias("_s"))
        sums = sums.select("word", F.posexplode("_s").alias("_k", "_reached")).where("_reached > 0")
        own = known.join(block.withColumnRenamed("bits", "_own"), [*KEY, "word"]).where("(bits & _own) <> 0").select(
            *KEY, F.lit(True).alias("on_cycle"))
        done.append(_round(
            block.select(*KEY, "word", F.expr("cast(round(log2(bits & 9223372036854775807)) AS int)").alias("_k0"), "bits")
            .select(*KEY, "word", F.when(F.col("bits") < 0, 63).otherwise(F.col("_k0")).alias("_k"))
            .join(sums, ["word", "_k"], "left").join(own, KEY, "left")
            .select(*KEY, (F.coalesce("_reached", F.lit(0)) - F.coalesce("on_cycle", F.lit(False)).cast("long")).alias("cascade_size"),
                    F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))))
    return reduce(DataFrame.unionByName, done)


def cascade_sizes(edge_rows: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """(book, cell, cascade_size): the distinct cells that depend on a cell, directly or not, itself not counted, for every
    cell with a dependent other than itself. Edges are (book, src, dst): src depends on dst."""
    e = _round(edge_rows.select("book", F.col("dst").alias("cell"), F.col("src").alias("dep")).where("cell <> dep").distinct())
    out = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_out"), F.min("dep").alias("nxt"))
    runs = _round(run_ends(out.where("_out = 1").select(*KEY, "nxt")))
    first = reach_counts(e, out.where("_out > 1").select(*KEY).unionByName(runs.where("end is null").select(*KEY)), at_once)
    at = first.select("book", F.col("cell").alias("end"), F.col("cascade_size").alias("_beyond"), "on_cycle")
    ended = _round(runs.where("end is not null").join(at, ["book", "end"], "left"))
    plain = ended.where("not coalesce(on_cycle, false)").select(
        *KEY, (F.col("hops") + F.coalesce("_beyond", F.lit(0))).alias("cascade_size"))
    again = reach_counts(e, ended.where("on_cycle").select(*KEY), at_once)
    return reduce(DataFrame.unionByName, [plain, first.select(*KEY, "cascade_size"), again.select(*KEY, "cascade_size")])

import numpy as np
import pytest

from ledgerlens.operators import reach


def brute(rows):
    after = {}
    for b, s, d in rows:
        after.setdefault((b, d), set()).add((b, s))
    out = {}
    for cell, direct in after.items():
        seen, todo = set(), list(direct)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        if direct - {cell}:
            out[cell] = len(seen - {cell})
    return out


def sizes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "book string, src string, dst string")
    got = reach.cascade_sizes(df, **kw).collect()
    out = {(r["book"], r["cell"]): r["cascade_size"] for r in got}
    assert len(out) == len(got)
    return out


def graph(seed):
    """Random edges with runs, joins, hubs, self references and cycles; the second book has no cycle."""
    rng = np.random.default_rng(seed)
    rows = []
    for book, n, loops in (("x", 150, True), ("y", 200, False)):
        for k in range(1, n):
            for d in rng.integers(0, k, int(rng.choice([0, 1, 1, 1, 2, 3]))):
                rows.append((book, f"c{k}", f"c{d}"))
        for k in range(20):
            rows.append((book, f"r{k + 1}", f"r{k}"))
        rows.append((book, "r0", "c7"))
        if loops:
            rows += [(book, "c3", f"c{n - 1}"), (book, "c5", "c5"), (book, "p1", "p0"), (book, "p0", "p1"), (book, "p0", "q0"), (book, "q0", "q1"),
                     (book, "r2", "r9")]
    return rows + rows[:30]


@pytest.mark.parametrize("seed,at_once", [(0, 1 << 20), (1, 64)])
def test_equals_brute_force(spark, seed, at_once):
    rows = graph(seed)
    assert sizes(spark, rows, at_once=at_once) == brute(rows)


def test_long_balance_column(spark):
    """20,000 cells, each made of the one above and an input, behind one cell that several use: log2(n) rounds, no n^2 rows."""
    n = 20_000
    rows = [("b", f"A{k}", f"A{k - 1}") for k in range(1, n)] + [("b", f"A{k}", f"B{k}") for k in range(1, n)]
    rows += [("b", "A0", "S"), ("b", "T", "S")]
    got = sizes(spark, rows)
    assert got["b", "S"] == n + 1 and len(got) == 2 * n - 1
    assert all(got["b", f"A{k}"] == n - 1 - k and (k == 0 or got["b", f"B{k}"] == n - k) for k in range(n - 1))


def test_empty(spark):
    assert sizes(spark, []) == {}


def estimate_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_follow_the_runs_and_the_estimate_stays_small(spark, monkeypatch):
    """1,500 runs of four cells beside a cycle: rounds go with the longest run, not with the number of cells, and the planner's
    size doesn't grow from round to round (it had twice the digits after each)."""
    rounds = []
    own = reach._round
    monkeypatch.setattr(reach, "_round", lambda df: rounds.append(1) or own(df))
    rows = [("b", f"r{k}x{i}", f"r{k}x{i + 1}") for k in range(1500) for i in range(3)] + [("b", "p", "q"), ("b", "q", "p"), ("b", "o", "p")]
    step = spark.createDataFrame(rows, "book string, cell string, nxt string")
    ends = reach.run_ends(step)
    got = {r.cell: (r.end, r.hops) for r in ends.collect()}
    assert len(rounds) <= 4 and len(got) == len(rows)
    assert all(got[f"r{k}x{i}"] == (f"r{k}x3", 3 - i) for k in range(1500) for i in range(3))
    assert got["p"][0] is None and got["q"][0] is None and got["o"][0] is None
    assert estimate_bits(ends) < 64


def test_estimate_of_deep_levels_stays_small(spark):
    from ledgerlens.operators import cells as C
    rows = [("b", "s", f"D{k}", k, 4, f"=D{k - 1}+1" if k > 1 else "=1") for k in range(1, 13)]
    cells = spark.createDataFrame(rows, "book string, sheet string, cell string, row_no long, col_no int, formula string")
    levels = C.dependency_levels(cells, C.parse_formulas(cells))
    assert {r.cell: r.level for r in levels.collect()} == {f"s!D{k}": k for k in range(1, 13)}
    assert estimate_bits(levels) < 256

"""Reusable DuckDB SQL fragments for the oracles (independent SQL, not Spark code)."""

from __future__ import annotations


def lcs_sql(a: str, b: str) -> str:
    """LCS length by the textbook DP written with DuckDB list lambdas."""
    return (f"list_reduce(string_split({a}, ''), lambda prev, c: list_reduce(generate_series(1, length({b})), "
            f"lambda acc, j: list_append(acc, greatest(acc[j], CASE WHEN substring({b}, j, 1) = c "
            f"THEN prev[j] + 1 ELSE prev[j + 1] END)), [0]), "
            f"list_transform(generate_series(0, length({b})), lambda x: 0))[-1]")


def fuzzy_pairs_ctes(rest: str, keys: str, t: float, pfx: str = "fz", self_pairs: bool = False) -> list[tuple[str, str]]:
    """CTEs ending in ``{pfx}_ok(ka, kb, pos, l, n, score)``: all pairs with ratio >= t.

    ``rest(k)`` are the probe keys, ``keys(k, pos)`` the candidates. The
    length and character-count filters are necessary conditions, so they
    only save work.
    """
    t = float(t)
    extra = " AND r.k < b.k" if self_pairs else ""
    return [
        (f"{pfx}_pairs", f"SELECT r.k AS ka, b.k AS kb, length(r.k) AS la, length(b.k) AS lb, b.pos AS pos "
                         f"FROM {rest} r JOIN {keys} b ON least(length(r.k), length(b.k)) * 200.0 >= {t} * "
                         f"(length(r.k) + length(b.k)){extra}"),
        (f"{pfx}_ca", f"SELECT k, c, count(*) AS n FROM (SELECT k, unnest(string_split(k, '')) AS c FROM {rest}) "
                      f"GROUP BY k, c"),
        (f"{pfx}_cb", f"SELECT k, c, count(*) AS n FROM (SELECT k, unnest(string_split(k, '')) AS c FROM {keys}) "
                      f"GROUP BY k, c"),
        (f"{pfx}_ov", f"SELECT p.ka, p.kb, sum(least(x.n, y.n)) AS o FROM {pfx}_pairs p "
                      f"JOIN {pfx}_ca x ON x.k = p.ka JOIN {pfx}_cb y ON y.k = p.kb AND y.c = x.c GROUP BY p.ka, p.kb"),
        (f"{pfx}_sc", f"SELECT p.ka, p.kb, p.pos, p.la + p.lb AS n, {lcs_sql('p.ka', 'p.kb')} AS l "
                      f"FROM {pfx}_pairs p JOIN {pfx}_ov o ON o.ka = p.ka AND o.kb = p.kb "
                      f"WHERE o.o * 200.0 >= {t} * (p.la + p.lb)"),
        (f"{pfx}_ok", f"SELECT ka, kb, pos, l, n, CAST(l AS DOUBLE) * 200 / n AS score FROM {pfx}_sc "
                      f"WHERE l * 200.0 >= {t} * n"),
    ]


def fuzzy_best_ctes(rest: str, keys: str, t: float, pfx: str = "fz") -> list[tuple[str, str]]:
    """Adds ``{pfx}_best(k, bk, score)``: best key per probe key, ties to the smallest position."""
    return fuzzy_pairs_ctes(rest, keys, t, pfx) + [
        (f"{pfx}_best", f"SELECT ka AS k, kb AS bk, score FROM {pfx}_ok "
                        f"QUALIFY row_number() OVER (PARTITION BY ka ORDER BY score DESC, pos) = 1"),
    ]


def build(final: str, ctes: list[tuple[str, str]]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + final

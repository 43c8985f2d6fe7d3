"""Language identification, word first.

A known word is scored by its log frequency in each language. A word that is not known falls back to its character
n-grams, its ends marked: the longest order of which any n-gram is known decides, with the mean log frequency of its
known n-grams; the orders get shorter down to single characters. A text's evidence is the mean over its words times
min(words, EVIDENCE), and the score is the posterior probability of the best language.

Counts cover all training texts, pre-aggregated in tasks, and every counted word and n-gram takes part. The most frequent
MOST_WORDS words and MOST_GRAMS n-grams are broadcast ("held"). If that isn't all of them, the other words of the texts
go through an equi-join with the written table of words, and the n-grams of the distinct words not found there, as far
as they aren't held, through one with the table of n-grams. The bounds therefore change no result. None of the joined
units is frequent in training; a word frequent only in the scored texts is left to the adaptive skew join.

The posterior only compares the learned languages: text in none of them, or of random letters, gets a sure label too. So
select() also asks how well a text fits its language at all. A language's common words are those that make up COMMON of its
training words; together they have a usual share of its running text. A text fits unless its own share is significantly
(by DEVIATIONS of a binomial) below FIT times the usual one. Too few words to tell (about a dozen) always fit.

Words are runs of letters, lower-cased. Defined cases: `und` with score 0 for a null text, a text without a letter, or
where no language was learned. Rows without language don't train. Ties go to the language first in order. Ids may repeat
or be null. An empty table gives no rows. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain, repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, filtered, frequent, sliced, written

MOST_WORDS = 100_000
MOST_GRAMS = 200_000
ORDERS = 5
EVIDENCE = 32
SMOOTH = 0.1
FLUSH = 200_000
#: Results of unknown words that a worker keeps, for speed only.
KEPT = 50_000
#: Least frequency of a common word (so a language has 1 / COMMON at most); share of the usual share that a text needs;
#: standard deviations that a share must be below that.
COMMON = 1 / 2000
FIT = 0.5
DEVIATIONS = 2.0
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    found = _LETTERS.findall((text or "").lower())
    if not (text or "").isascii():  # numerals like a superscript two pass the pattern
        found = [w for w in found if w.isalpha() or any(map(str.isalpha, w))]
    return found


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    if order == 1:
        return list(word)
    return [marked[i: i + order] for i in range(len(marked) - order + 1)]


def _counted(rows: DataFrame, pairs, unit: str, langs: list[str]) -> DataFrame:
    """(unit, all, by): sums of pairs(batch) -> (lang, Counter) steps, flushed in tasks, then shuffled; by goes by langs."""
    def run(batches):
        held: dict[str, Counter] = {}

        def emit():
            names = [k for k, c in held.items() for _ in c]
            batch = pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([u for c in held.values() for u in c], pa.string()),
                pa.array([n for c in held.values() for n in c.values()], pa.int64())], names=["lang", unit, "c"])
            held.clear()
            return batch

        for b in sliced(batches):
            for _ in pairs(b, held):
                if sum(map(len, held.values())) > FLUSH:
                    yield emit()
        yield emit()

    each = [F.coalesce(F.sum(F.when(F.col("lang") == F.lit(lang), F.col("c"))), F.lit(0)) for lang in langs]
    return rows.mapInArrow(run, f"lang string, {unit} string, c long").groupBy(unit).agg(
        F.sum("c").alias("all"), F.array(*each).cast("array<long>").alias("by"))


def _word_pairs(b, held):
    for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        held.setdefault(lang, Counter()).update(words_of(text))
        yield


def _gram_pairs(langs: list[str]):
    def pairs(b, held):
        for k, (word, by) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            grams = [g for order in range(1, ORDERS + 1) for g in grams_of(word, order)]
            for lang, c in zip(langs, by):
                if c:
                    own = held.setdefault(lang, Counter())
                    for g in grams:
                        own[g] += c
            if k % 500 == 0:
                yield

    return pairs


class Model:
    """Log frequencies of the held words and n-grams, a column for each language, and tables of the others.

    rare_words (word, v) and rare_grams (gram, v) are None if there are no others. The methods know the held units
    alone; predict() and select() of this module use all.
    """

    def __init__(self, langs: list[str], prior: np.ndarray, words: tuple, grams: tuple, common: tuple):
        self.langs, self.prior = langs, prior
        self.common, self.usual = common  # word: 0 or 1 by language; the share of common words in each language's text
        self.place, self.word_lp, self.rare_words = words
        self.gram_place, self.gram_lp, self.rare_grams = grams
        self.kept: dict[str, int] = {}  # unknown words met before, and their rows in self.rows
        self.rows = np.zeros((0, len(langs)), np.float32)

    @property
    def complete(self) -> bool:
        return self.rare_words is None and self.rare_grams is None

    def known_grams(self, word: str) -> list[int]:
        """Places of the known n-grams of the longest order that has any."""
        marked, get = f"<{word}>", self.gram_place.get
        for order in range(min(ORDERS, len(marked)), 1, -1):
            at = [k for i in range(len(marked) - order + 1) if (k := get(marked[i: i + order])) is not None]
            if at:
                return at
        return [k for c in word if (k := get(c)) is not None]

    def unknown(self, words: list[str]) -> np.ndarray:
        """Sum over the words of the mean log frequency of their known n-grams."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.kept]
        first = len(self.kept)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((len(new) + KEPT, len(self.langs)), np.float32)])
        if new:
            found = [self.known_grams(w) for w in new]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            some = sizes > 0
            self.rows[first: first + len(new)] = 0
            if some.any():
                starts = np.cumsum(sizes[some]) - sizes[some]
                flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
                self.rows[first + np.flatnonzero(some)] = np.add.reduceat(self.gram_lp[flat], starts) / sizes[some][:, None]
            self.kept.update(zip(new, range(first, first + len(new))))
        at = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
        return np.ones(len(at), np.float32) @ self.rows[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        known = self.word_lp[at[at >= 0]]
        total = np.ones(len(known), np.float32) @ known + self.unknown([words[k] for k in np.flatnonzero(at < 0).tolist()])
        z = self.prior + total / len(words) * min(len(words), EVIDENCE)
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())

    def commons(self, words: list[str]) -> np.ndarray:
        """How many of the words are common, by language."""
        found = [row for w in words if (row := self.common.get(w)) is not None]
        return np.sum(found, axis=0, dtype=np.int64) if found else np.zeros(len(self.langs), np.int64)

    def fits(self, text: str | None, lang: str) -> bool:
        words, k = words_of(text), self.langs.index(lang)
        return bool(self.commons(words)[k] >= least_commons(len(words), self.usual[k]))


def least_commons(n, usual):
    """A text of n words fits with at least this many common ones; for numbers and columns."""
    root = np.sqrt if isinstance(n, (int, float)) else F.sqrt
    return n * (FIT * usual) - root(n * (FIT * usual * (1 - FIT * usual))) * DEVIATIONS


def _common_words(counts: DataFrame, langs: list[str]) -> tuple[dict, list[float]]:
    """The common words of all languages, 1 / COMMON at most for each, and the share of its words that they make up."""
    by = [F.col("by")[i] for i in range(len(langs))]
    totals = [x or 0 for x in counts.agg(F.array(*map(F.sum, by)).alias("t")).first()["t"]] if langs else []
    often = [b >= F.lit(max(1.0, COMMON * n)) for b, n in zip(by, totals)]
    rows = counts.where(reduce(or_, often)).select("word", F.array(*[o.cast("int") for o in often]).alias("c"), "by").collect() if langs else []
    share = [sum(r["by"][i] for r in rows if r["c"][i]) / n if n else 0.0 for i, n in enumerate(totals)]
    return {r["word"]: np.array(r["c"], np.int8) for r in rows}, share


def _frequencies(counts: DataFrame, unit: str, most: int, langs: list[str]) -> tuple[dict, np.ndarray, DataFrame | None]:
    """Places of the most frequent units, their smoothed log frequencies, n-grams by order; and (unit, v) of the others."""
    size, by = F.length(unit) if unit == "gram" else F.lit(0), [F.col("by")[i] for i in range(len(langs))]
    base = {r["n"]: np.array(r["c"], float) + SMOOTH * (max(r["k"], default=0) + 1) for r in counts.groupBy(size.alias("n")).agg(
        F.array(*map(F.sum, by)).alias("c"), F.array(*[F.count_if(c > 0) for c in by]).alias("k"), F.sum("all").alias("all")).collect()}
    least = frequent(counts, "all", most)
    top = counts.where(F.col("all") >= least).select(unit, "by").toArrow()
    units = top.column(unit).to_pylist()
    lp = np.array(top.column("by").to_pylist(), float).reshape(len(units), len(langs))
    for k, u in enumerate(units):
        lp[k] = np.log((lp[k] + SMOOTH) / base[len(u) if unit == "gram" else 0])
    others = counts.where(F.col("all") < least)
    rare = None
    if not others.isEmpty():
        below = F.coalesce(*[F.when(size == n, F.array(*[F.lit(float(x)) for x in row])) for n, row in base.items()])
        rare = others.withColumn("below", below).select(
            unit, F.array(*[F.log((c + F.lit(SMOOTH)) / F.col("below")[i]) for i, c in enumerate(by)]).alias("v"))
    return {u: k for k, u in enumerate(units)}, lp.astype(np.float32), rare


def fit(df: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS,
        most_grams: int = MOST_GRAMS) -> Model:
    """The model of the rows where train is true and the language isn't null."""
    rows = df.where(train & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    share = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(share)
    prior = np.log(np.array([share[k] for k in langs], float)) if langs else np.empty(0)
    words = written(_counted(rows, _word_pairs, "word", langs))
    grams = written(_counted(words.select("word", "by"), _gram_pairs(langs), "gram", langs))
    model = Model(langs, prior, _frequencies(words, "word", most_words, langs), _frequencies(grams, "gram", most_grams, langs),
                  _common_words(words, langs))
    for counts, rare in ((words, model.rare_words), (grams, model.rare_grams)):
        if rare is None:
            discard(counts)
    return model


def _plus(*columns: Column, size: int) -> Column:
    """The sum of arrays; a null one counts as zeros."""
    return F.array(*[sum((F.coalesce(c[i], F.lit(0.0)) for c in columns), F.lit(0.0)) for i in range(size)])


def _spelled(words: DataFrame, model: Model) -> DataFrame:
    """(word, v) of unknown distinct words: the mean log frequency of the n-grams of the longest order that has known ones.

    A word's orders are given from the longest down to the first with a held n-gram; n-grams that aren't held are joined.
    """
    size, names = len(model.langs), ["word", "n", "held", "v", "rest"]
    shared = words.sparkSession.sparkContext.broadcast((model.gram_place, model.gram_lp))
    joined = model.rare_grams is not None

    def run(batches):
        place, lp = shared.value
        for b in sliced(batches, 1 << 20):
            out = [[] for _ in names]
            for word in b.column(0).to_pylist():
                for order in range(min(ORDERS, len(word) + 2), 0, -1):
                    grams = grams_of(word, order)
                    held = [k for g in grams if (k := place.get(g)) is not None]
                    rest = [g for g in grams if g not in place] if joined else []
                    for column, x in zip(out, (word, order, len(held), lp[held].sum(axis=0, dtype=np.float64), rest)):
                        column.append(x)
                    if held:
                        break
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.list_(pa.float64())), pa.array(out[4], pa.list_(pa.string()))], names=names)

    orders = words.mapInArrow(run, "word string, n int, held long, v array<double>, rest array<string>")
    if joined:
        orders = written(orders)
        more = orders.select("word", "n", F.explode("rest").alias("gram")).join(model.rare_grams, "gram").groupBy("word", "n").agg(
            F.count("*").alias("found"), F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("w"))
        orders = orders.join(more, ["word", "n"], "left").select(
            "word", "n", (F.col("held") + F.coalesce("found", F.lit(0))).alias("held"), _plus(F.col("v"), F.col("w"), size=size).alias("v"))
    best = orders.where("held > 0").groupBy("word").agg(F.max_by(F.struct("held", "v"), "n").alias("x"))
    return best.select("word", F.transform("x.v", lambda y: y / F.col("x.held")).alias("v"))


def _predict_joined(rows: DataFrame, model: Model, fit: bool = False) -> DataFrame:
    """predict() with a model that doesn't hold all its units, and, if asked for, whether the text fits."""
    size = len(model.langs)
    shared = rows.sparkSession.sparkContext.broadcast((model.place, model.word_lp, model.common if fit else None))

    def run(batches):
        place, lp, common = shared.value
        for b in sliced(batches):
            n, totals, words, times, ends, commons = [], [], [], [], [0], []
            for text in b.column(1).to_pylist():
                found = words_of(text)
                at = np.fromiter(map(place.get, found, repeat(-1)), np.int64, len(found))
                rare = Counter([found[k] for k in np.flatnonzero(at < 0).tolist()])
                rows = [row for w in found if (row := common.get(w)) is not None] if fit else []
                commons.append(np.sum(rows, axis=0, dtype=np.int64) if rows else np.zeros(size, np.int64))
                n.append(len(found))
                totals.append(lp[at[at >= 0]].sum(axis=0, dtype=np.float64))
                words += rare.keys()
                times += rare.values()
                ends.append(len(words))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "k"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(totals, pa.list_(pa.float64())), rare,
                                              pa.array(commons, pa.list_(pa.int64()))], names=["id", "words", "total", "rare", "commons"])

    kind = rows.schema["id"].dataType.simpleString()
    docs = written(rows.mapInArrow(run, f"id {kind}, words long, total array<double>, rare array<struct<word: string, k: bigint>>, commons array<long>")
                   .withColumn("row", F.monotonically_increasing_id()))
    rare = docs.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    found = rare.select("word").distinct()
    found = written(found.join(model.rare_words, "word", "left") if model.rare_words is not None else
                    found.withColumn("v", F.lit(None).cast("array<double>")))
    of = written(found.where("v IS NOT NULL").union(_spelled(found.where("v IS NULL").select("word"), model)))
    more = rare.join(of, "word").groupBy("row").agg(F.array(*[F.sum(F.col("k") * F.col("v")[i]) for i in range(size)]).alias("more"))
    total = _plus(F.col("total"), F.col("more"), size=size)
    factor = F.least(F.col("words"), F.lit(EVIDENCE)) / F.col("words")
    z = docs.drop("rare").join(more, "row", "left").withColumn("total", total).select(
        "id", "words", "commons", F.when(F.col("words") > 0, F.array(*[
            F.lit(float(p)) + F.col("total")[i] * factor for i, p in enumerate(model.prior)])).alias("z")).withColumn("top", F.array_max("z"))
    best = F.array_position("z", F.col("top")).cast("int") - 1
    usual = F.get(F.array(*map(F.lit, model.usual)), best)
    return z.select(
        "id", F.coalesce(F.get(F.array(*map(F.lit, model.langs)), best), F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))), F.lit(0.0)).alias("score"),
        F.coalesce(F.get("commons", best) >= least_commons(F.col("words"), usual), F.lit(False)).alias("fits"))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row's whole text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not model.complete:
        return _predict_joined(rows, model).select("id", "lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            got = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()),
                                              pa.array([s for _, s in got], pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def select(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose language is one of the learned ones with probability `least` or more, and fits."""
    if not model.complete:
        row = "_row_of_df"
        numbered = written(df.withColumn(row, F.monotonically_increasing_id()))
        rows = numbered.select(F.col(row).alias("id"), F.col(text_col).cast("string").alias("text"))
        sure = _predict_joined(rows, model, True).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least) & F.col("fits"))
        return numbered.join(sure.select(F.col("id").alias(row)), row, "left_semi").select(*df.columns)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def sure(text: str) -> bool:
        lang, p = shared.value.predict(text)
        return lang != UNDETERMINED and p >= least and shared.value.fits(text, lang)

    return filtered(df, text_col, sure)

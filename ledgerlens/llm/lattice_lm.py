"""Subword lattice likelihood.

The vocabulary is an existing one (a public sentencepiece file): its pieces, byte fallback included. Any word has many
segmentations into pieces; the forward recursion in log space sums the weights of all of them, so the score is the
marginal probability of the text and not that of one segmentation. Words begin with the vocabulary's space mark, which
occurs nowhere else, so the lattice of a text is a chain of the lattices of its words and each distinct word is
computed once.

Weights come from the training documents, whole:
* piece scores: the file's order gives the start (p ~ 1/(rank + 10)), then expectation-maximisation over all distinct
  training words (each of weight one, as the spelling model has to spell new words) gives piece log-probabilities, with
  one stop unit a word;
* the lattice of a word that training has seen has one more arc, the whole word, with weight (c - D) / N. D is the
  absolute discount n1 / (n1 + 2 n2); what it frees, D V / N, is the weight of the spelled arcs.

The probabilities of all texts add up to at most one. Beside it, the add-one word score of the contract (base).

Scale: counts are pre-aggregated in tasks before the shuffle. The most frequent words (at most HOT of them, found from a
histogram of counts) are broadcast and scored in the pass over the texts; all other words, none of them hot, go through
an equi-join with the scored vocabulary. Nothing of the size of the vocabulary reaches the driver or one task.

Defined cases: a null or empty text is the end token alone. Ids may repeat or be null: each input row gives a row.
Empty tables give no rows; without training rows N and V are 0 and every word is spelled by the starting scores. Only
the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, frequent, sliced, written

#: Most words broadcast with their scores.
HOT = 100_000
#: Distinct words a task counts before it passes them on.
FLUSH = 200_000
#: Longer words are spelled by the plain recursion, and cut to parts of this size in training.
LONG = 2048
STOP, BEGIN = b"", b" "
LN10 = float(np.log(10.0))


def read_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Distinct piece byte strings (the space mark as one blank) and their starting log-probabilities; STOP is last.

    Blanks occur at the start of a piece only, as words hold none; pieces of several blanks are left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rank: dict[bytes, int] = {BEGIN: 0}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        name = sp.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            rank.setdefault(piece, i)
    for b in range(256):  # every byte string can be spelled
        rank.setdefault(bytes([b]), len(rank))
    pieces = sorted(rank, key=lambda p: (rank[p], p))
    weight = 1.0 / (np.arange(len(pieces)) + 10.0)
    weight = np.append(weight, weight.sum() / 4)  # about four pieces a word
    return [*pieces, STOP], np.log(weight / weight.sum())


class Lattice:
    """Substring look-up by polynomial hashes, vectorised over many words."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, pieces: list[bytes]):
        self.sizes = sorted({len(p) for p in pieces if p})
        self.number = {p: i for i, p in enumerate(pieces)}
        self.stop = self.number[STOP]
        n = LONG + 64
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.BASE))])
            inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
            keys = np.array([self._of(p) for p in pieces if p], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def _of(self, piece: bytes) -> np.uint64:
        a = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
        return np.uint64(len(piece)) * np.uint64(0xC2B2AE3D27D4EB4F) + (a * self.power[: len(a)]).sum(dtype=np.uint64)

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """words: (n, L) bytes of words of one length. Size -> (n, L - size + 1) piece numbers, -1 for none."""
        n, length = words.shape
        with np.errstate(over="ignore"):
            sums = np.zeros((n, length + 1), np.uint64)
            np.cumsum((words.astype(np.uint64) + np.uint64(1)) * self.power[:length], axis=1, out=sums[:, 1:])
            out = {}
            for size in self.sizes:
                if size > length:
                    break
                key = (sums[:, size:] - sums[:, :-size]) * self.inverse[: length - size + 1]
                key += np.uint64(size) * np.uint64(0xC2B2AE3D27D4EB4F)
                found = np.full(key.shape, -1, np.int32)
                at = np.nonzero(self.maybe[key >> np.uint64(44)])
                some = key[at]
                pos = np.searchsorted(self.keys, some)
                pos[pos == len(self.keys)] = 0
                found[at] = np.where(self.keys[pos] == some, self.ids[pos], -1)
                if (found >= 0).any():
                    out[size] = found
        return out

    def forward(self, hits: dict[int, np.ndarray], n: int, length: int, lp: np.ndarray) -> np.ndarray:
        """Log-weights of all segmentations of each prefix: (n, L + 1). lp ends with -inf, for piece number -1."""
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0.0
        for end in range(1, length + 1):
            terms = np.stack([alpha[:, end - s] + lp[h[:, end - s]] for s, h in hits.items() if s <= end])
            top = terms.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[:, end] = safe + np.log(np.exp(terms - safe).sum(axis=0))
        return alpha

    def backward(self, hits: dict[int, np.ndarray], n: int, length: int, lp: np.ndarray) -> np.ndarray:
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0.0
        for start in range(length - 1, -1, -1):
            terms = np.stack([beta[:, start + s] + lp[h[:, start]] for s, h in hits.items() if start + s <= length])
            top = terms.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                beta[:, start] = safe + np.log(np.exp(terms - safe).sum(axis=0))
        return beta

    def marginal_long(self, word: bytes, lp: np.ndarray) -> float:
        """The same recursion for one very long word, with a window of the largest piece."""
        reach = self.sizes[-1]
        window = [0.0]
        for end in range(1, len(word) + 1):
            terms = []
            for s in self.sizes:
                if s > min(end, reach):
                    break
                k = self.number.get(word[end - s: end])
                if k is not None:
                    terms.append(window[-s] + lp[k])
            top = max(terms)
            window.append(top + float(np.log(sum(np.exp(t - top) for t in terms))))
            if len(window) > reach + 1:
                window = window[-(reach + 1):]
        return window[-1] + float(lp[self.stop])

    def marginals(self, words: list[bytes], lp: np.ndarray) -> np.ndarray:
        """Log-probability of each word under the spelling model, all segmentations and the stop unit included."""
        out = np.empty(len(words))
        padded = np.append(lp, -np.inf)
        for at, hits, n, length in self._groups(words, out, lp):
            out[at] = self.forward(hits, n, length, padded)[:, -1] + lp[self.stop]
        return out

    def expected(self, words: list[bytes], lp: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words."""
        total = np.zeros(len(lp))
        padded = np.append(lp, -np.inf)
        parts = [w[i: i + LONG - 1] for w in words for i in range(0, len(w), LONG - 1)]
        for _, hits, n, length in self._groups(parts, None, lp):
            alpha = self.forward(hits, n, length, padded)
            beta = self.backward(hits, n, length, padded)
            for s, h in hits.items():
                gain = alpha[:, : length - s + 1] + padded[h] + beta[:, s:] - alpha[:, -1:]
                there = h >= 0
                total += np.bincount(h[there], np.exp(gain[there]), minlength=len(lp))
        total[self.stop] += len(words)
        return total

    def _groups(self, words: list[bytes], out, lp):
        """Words of one length as a matrix, in pieces of bounded size: their places, hits and shape."""
        marked = [BEGIN + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        for length in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == length)
            if length > LONG:
                for k in places.tolist():
                    out[k] = self.marginal_long(marked[k], lp)
                continue
            step = max(1, (1 << 18) // length)
            for i in range(0, len(places), step):
                at = places[i: i + step]
                block = np.frombuffer(b"".join([marked[k] for k in at.tolist()]), np.uint8).reshape(len(at), length)
                yield at, self.hits(block), len(at), length


_LATTICES: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    """One look-up structure a worker."""
    if model_file not in _LATTICES:
        _LATTICES[model_file] = Lattice(read_pieces(model_file)[0])
    return _LATTICES[model_file]


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c, c_train) over rows (text, train): every word of every text, counted in tasks first."""
    names = ["word", "c", "c_train"]

    def run(batches):
        seen, trained = Counter(), Counter()

        def emit():
            keys = list(seen)
            batch = pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array([seen[k] for k in keys], pa.int64()),
                pa.array([trained.get(k, 0) for k in keys], pa.int64())], names=names)
            seen.clear()
            trained.clear()
            return batch

        for b in sliced(batches):
            for text, train in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                seen.update(w)
                if train:
                    trained.update(w)
                if len(seen) > FLUSH:
                    yield emit()
        yield emit()

    return rows.select("text", "train").mapInArrow(run, "word binary, c long, c_train long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("c_train").alias("c_train"))


def fit_pieces(counts: DataFrame, model_file: str, rounds: int) -> np.ndarray:
    """Piece log-probabilities after expectation-maximisation over all training words."""
    lp = read_pieces(model_file)[1]
    words = counts.where("c_train > 0").select("word")
    for _ in range(rounds):
        def run(batches, lp=lp):
            total = np.zeros(len(lp))
            for b in batches:
                total += lattice(model_file).expected(b.column(0).to_pylist(), lp)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "uses"])

        found = words.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        if not len(found):
            break
        uses = np.full(len(lp), 1e-2)  # no piece dies out
        uses[found["piece"]] += found["uses"]
        lp = np.log(uses / uses.sum())
    return lp


def score_texts(df: DataFrame, train: Column, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                rounds: int = 2, hot: int = HOT) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10.

    train: a boolean column over df, true where the row belongs to the training set (null counts as false).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                     F.coalesce(train, F.lit(False)).alias("train"))
    counts = written(count_words(rows))
    n_docs = rows.where("train").count()
    found = counts.where("c_train > 0").agg(
        F.coalesce(F.sum("c_train"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c_train") == 1).alias("n1"),
        F.count_if(F.col("c_train") == 2).alias("n2")).first()
    n, v = found["n"] + n_docs, found["v"] + (n_docs > 0)
    discount = min(0.95, max(0.05, found["n1"] / (found["n1"] + 2 * found["n2"]))) if found["n1"] and found["n2"] else 0.5
    spelled = float(np.log(discount * found["v"] / n)) if found["v"] else 0.0
    divisor = float(np.log10(n + (v + 1)))
    end_base = float(np.log10(n_docs + 1))
    end_score = float(np.log10(n_docs / n)) if n_docs else 0.0
    lp = fit_pieces(counts, model_file, rounds)

    def value(batches):
        for b in batches:
            c = b.column(1).to_numpy()
            whole = np.full(len(c), -np.inf)
            whole[c > 0] = np.log((c[c > 0] - discount) / n)
            s = np.logaddexp(whole, spelled + lattice(model_file).marginals(b.column(0).to_pylist(), lp)) / LN10
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(s)], names=["word", "c", "c_train", "s"])

    vocabulary = written(counts.select("word", "c_train", "c").mapInArrow(value, "word binary, c long, c_train long, s double"))
    least = frequent(vocabulary, "c", hot)  # the frequent words are broadcast, at most `hot`
    top = vocabulary.where(F.col("c") >= least).select("word", "c_train", "s").toArrow()
    words = top.column(0).to_pylist()
    known = top.column(1).to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((
        {w: i for i, w in enumerate(words)}, np.log10(known + 1.0), np.asarray(top.column(2).to_numpy()), known > 0))

    def score(batches):
        place, base, model, is_known = shared.value
        for b in sliced(batches):
            out = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
            rare_words, rare_counts, rare_ends = [], [], [0]
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                w = words_of(text)
                at = np.array([place.get(x, -1) for x in w], np.int64)
                rare = Counter([w[k] for k in np.flatnonzero(at < 0).tolist()])
                at = at[at >= 0]
                out["n_tokens"].append(len(w) + 1)
                out["n_known"].append(int(is_known[at].sum()) + (n_docs > 0))
                out["base"].append(float(base[at].sum()) + end_base)
                out["score"].append(float(model[at].sum()) + end_score)
                rare_words += rare.keys()
                rare_counts += rare.values()
                rare_ends.append(len(rare_words))
            rare = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "k"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()),
                 pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64()), rare],
                names=["id", "train", "n_tokens", "n_known", "base", "score", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    docs = written(rows.select("id", "text", "train").mapInArrow(
        score, f"id {kind}, train boolean, n_tokens long, n_known long, base double, score double, "
        "rare array<struct<word: binary, k: bigint>>").withColumn("row", F.monotonically_increasing_id()))
    rare = docs.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(
        vocabulary.where(F.col("c") < least).select("word", "c_train", "s"), "word")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("c_train") + F.lit(1.0))).alias("base_more"), F.sum(F.col("k") * F.col("s")).alias("score_more"),
        F.sum(F.when(F.col("c_train") > 0, F.col("k")).otherwise(0)).alias("known_more"))
    out = docs.drop("rare").join(sums, "row", "left").select(
        "id", "train", "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"))
    discard(counts)
    return out

"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

The acceptor is a set of tables. A state of the minimal acceptor is what can follow a prefix: prefixes with the same set of
rests are one state, named by a fingerprint of that set (one aggregate per prefix, so a frequent prefix is summed before it is
shuffled). An arc is (state, character, rest of the word behind it).

In the composed machine the two acceptors walk together, in one and the same state q, until the edit; from there both must
accept the same rest. So a composed path is an edit at a state q between two of its arcs with the same rest (a replaced
character), or between an arc and q itself with that rest ahead (an inserted or deleted one): arcs that share (q, rest). These
are found once per state, however many prefixes lead to it. A character in a run of its like can be inserted at several places;
only the last place of the run counts, so each pair comes once. Accepted pairs are then enumerated from the initial states of
the edit: each prefix that leads to q, with each composed path at q, gives two words.

Prefixes and rests are carried as 64-bit polynomial fingerprints, from which those of both words follow. Fingerprints can only
bring pairs too many; every pair is verified on its words, before and behind the edit. A pair's rows at one (q, rest) number at
most the alphabet and one, the prefix table and the pairs are joined by state and by word, so no group grows with the input
except the first states' prefixes, which the adaptive skew join splits.

Every join is of two tables that grow with the vocabulary, and all are merge joins by hint. Spark sizes what a step makes of a
written table from that table's compressed file: the walks of a 4 MB file of words count as 6 MB, and were broadcast as 671.

Defined cases: null and empty texts have no words; a null id counts as empty text in the rule that shortens runs; rows that
repeat count each. Without words there are no rows. Only the id and text columns are read, so other columns can't clash. The
prefix fingerprints of a single word are made in one task (some 50 bytes a character).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, sliced, written
from ledgerlens.llm.mixing import mixed

#: [A-Za-zÀ-ÿ]+ on lower-cased UTF-8: U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Odd factor of the fingerprints and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: The symbol of the place where a word goes on without the edited character.
NOTHING = -1


def shortened(run: bytes, h: int) -> bytes:
    """run without its code point number h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def word_counts(df: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(word, n): how often each run occurs, where runs with crc32(id:run) divisible by `every` lack a character."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in sliced(batches):
            counts = Counter()
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                salt = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(RUN.findall((text or b"").lower())).items():
                    h = zlib.crc32(w, salt)
                    counts[w if h % every else shortened(w, h)] += n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def symbols(x: np.ndarray) -> np.ndarray:
    return mixed(x.astype(np.uint64))


def walks(words: DataFrame) -> DataFrame:
    """A row for each place of each word: prefix, place, symbol (code point, or NOTHING at the end), last (the next symbol
    differs), rest, after (the rest behind the symbol)."""

    def run(batches):
        for b in sliced(batches, 1 << 20):
            if not b.num_rows:
                continue
            w = b.column(0)
            n = pc.utf8_length(w).to_numpy().astype(np.int64)
            points = np.frombuffer("".join(w.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
            size = n + 1  # the place behind the last character counts
            word = np.repeat(np.arange(len(n)), size)
            first = np.cumsum(size) - size
            place = np.arange(len(word)) - first[word]
            symbol = np.full(len(word), NOTHING, np.int64)
            symbol[place < n[word]] = points
            up, down = powers(FACTOR, int(size.max())), powers(INVERSE, int(size.max()))
            term = np.where(symbol == NOTHING, np.uint64(0), symbols(symbol) * up[place])
            total = np.cumsum(term)
            prefix = total - term
            prefix -= prefix[first][word]
            whole = prefix[first + n]
            rest = (whole[word] - prefix) * down[place]
            after = np.append(rest[1:], np.uint64(0))
            follows = np.append(symbol[1:], NOTHING)
            last = (symbol != NOTHING) & (symbol != follows)
            yield pa.RecordBatch.from_arrays(
                [signed(prefix), pa.array(place.astype(np.int32)), pa.array(symbol.astype(np.int32)), pa.array(last), signed(rest), signed(after)],
                names=["prefix", "place", "symbol", "last", "rest", "after"])

    return words.select("word").mapInArrow(run, "prefix long, place int, symbol int, last boolean, rest long, after long")


def composed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes of the minimal acceptor's states (prefix, place, state), and the composed machine's edits
    (state, rest, a, b): symbols a < b at the same state with the same rest, a = NOTHING for an insertion of b."""
    steps = walks(words)
    language = F.xxhash64(F.bit_xor(F.xxhash64("rest")), F.bit_xor(F.xxhash64(F.lit(1), "rest")), F.count("*"))
    prefixes = written(steps.groupBy("prefix").agg(language.alias("state"), F.first("place").alias("place")))
    at = steps.join(prefixes.select("prefix", "state").hint("merge"), "prefix")
    # a word's place stands for the arc that it takes, and for taking none
    mark = F.explode(F.array(
        F.struct(F.col("after").alias("rest"), F.when(F.col("symbol") != NOTHING, F.col("symbol")).alias("symbol"), F.col("last")),
        F.struct(F.col("rest"), F.lit(NOTHING).alias("symbol"), F.lit(True).alias("last"))))
    marks = at.select("state", mark.alias("m")).select("state", "m.*").where("symbol is not null")
    code = F.col("symbol") * 2 + F.col("last").cast("int")
    meeting = marks.groupBy("state", "rest").agg(F.min("symbol").alias("low"), F.max("symbol").alias("high"), F.collect_set(code).alias("codes")).where("low < high")
    two = meeting.select("state", "rest", "codes", F.explode("codes").alias("x")).select("state", "rest", "x", F.explode("codes").alias("y"))
    a, b = F.shiftright("x", 1), F.shiftright("y", 1)
    # against NOTHING a character counts only as the last of its run
    edits = two.where(a < b).where((a != NOTHING) | (F.col("y") % 2 == 1)).select("state", "rest", a.alias("a"), b.alias("b"))
    return prefixes, edits


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): all ordered pairs of different words one edit apart. words: (word, and any more), words distinct."""
    prefixes, edits = composed(words)
    # the enumeration starts from the initial states of the edit: every prefix that leads to the state
    paths = edits.join(prefixes.hint("merge"), "state").select("prefix", "place", "rest", "a", "b")

    def ends(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, rest = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 2))
            place = batch.column(1).to_numpy()
            up = powers(FACTOR, int(place.max()) + 2)
            out = []
            for symbol in (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4)):
                out.append(signed(np.where(symbol == NOTHING, prefix + up[place] * rest, prefix + up[place] * symbols(symbol) + up[place + 1] * rest)))
            yield pa.RecordBatch.from_arrays([*out, batch.column(1), pa.array(batch.column(3).to_numpy() == NOTHING)], names=["u", "v", "place", "inserted"])

    def named(batches):
        for b in sliced(batches, 1 << 20):
            if not b.num_rows:
                continue
            w = b.column(0)
            n = pc.utf8_length(w).to_numpy().astype(np.int64)
            term = symbols(np.frombuffer("".join(w.to_pylist()).encode("utf-32-le"), "<u4"))
            first = np.cumsum(n) - n
            term = term * powers(FACTOR, int(n.max()) + 1)[np.arange(len(term)) - np.repeat(first, n)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
            yield pa.RecordBatch.from_arrays([w, signed(total[first + n] - total[first])], names=["word", "name"])

    names = written(words.select("word").mapInArrow(named, "word string, name long"))
    # the edit's place is known, so the words are compared around it (Spark's levenshtein takes quadratic time)
    alike = F.expr("left(one, place) = left(two, place) and substr(one, if(inserted, place + 1, place + 2)) = substr(two, place + 2) "
                   "and char_length(two) = char_length(one) + int(inserted) and one <> two")
    pairs = paths.mapInArrow(ends, "u long, v long, place int, inserted boolean").join(
        names.select(F.col("name").alias("u"), F.col("word").alias("one")).hint("merge"), "u").join(
        names.select(F.col("name").alias("v"), F.col("word").alias("two")).hint("merge"), "v").where(alike)
    return pairs.select(F.explode(F.array(F.struct(F.col("one").alias("word"), F.col("two").alias("other")),
                                          F.struct(F.col("two").alias("word"), F.col("one").alias("other")))).alias("p")).select("p.*")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_chars: int = 5,
             least_count: int = 3, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of at least `least_chars` characters and `least_count` occurrences.

    form: the near word of largest n (ties: the first in code-point order), if that n is at least `times` the word's.
    root: the end of the forms followed from the word.
    """
    words = written(word_counts(df, id_col, text_col, every).where((F.char_length("word") >= least_chars) & (F.col("n") >= least_count)))
    counted = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.other"))
    out = written(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")))
    # counts grow along forms, so they never come back: each round doubles the steps that are taken at once
    at = written(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        moved = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        going = moved.where("moved").limit(1).count()
        discard(at)
        at = moved.drop("moved")
        at.written_to = moved.written_to
        if not going:
            break
    return out.join(at.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole (encoding sections apart would give other tokens at their borders). Token
byte lengths give the character span of every token; token spans and section spans are then interval-joined per
document by sorted search. A token that crosses a border is allocated by an explicit rule:

* start: to the sections that hold its first character;
* end: to the sections that hold its last character;
* middle: to the sections that hold its middle character (the left one of two);
* share: to every section, by the share of its characters that lie in it (fractions).

A token that covers part of one character only (byte-level tokens) counts as lying at that character. Sections may
overlap or leave gaps; tokens of gaps count for no section (row with section null, if there are any).

Scale: one pass, no shuffle; a document's spans stay in its row. Long documents are only held one at a time.

Defined cases: a null text is empty; an empty text has 0 tokens in each section given, and no sentence. Null, empty or reversed
sections and those beyond the text are cut to the text. Repeated rows each give rows. An empty table gives no rows.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import sliced
from ledgerlens.llm.tokens import ordinary_ids, token_sizes

RULES = ("start", "end", "middle", "share")


def token_spans(text: str, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token of the whole text."""
    raw = text.encode()
    ids = np.array(ordinary_ids(tokenizer, text), np.int64)
    ends = np.cumsum(token_sizes(tokenizer)[ids])
    starts = ends - token_sizes(tokenizer)[ids]
    if len(raw) == len(text):
        return starts, ends
    # the character that each byte belongs to
    of = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return of[starts], of[ends - 1] + 1


def attribute(text: str, low: np.ndarray, high: np.ndarray, tokenizer: str, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section [low, high), how many of its tokens cross a border of it, and tokens of no section."""
    starts, ends = token_spans(text, tokenizer)
    low = np.clip(low, 0, len(text))
    high = np.maximum(low, np.clip(high, 0, len(text)))
    crossing = np.zeros(len(low), np.int64)
    for border in (low, high):  # tokens that begin before the border and end behind it
        crossing += np.searchsorted(starts, border, "left") - np.searchsorted(ends, border, "right")
    both = np.searchsorted(starts, low, "left") - np.searchsorted(ends, high, "right")
    crossing = np.where(high > low, crossing - np.maximum(both, 0), 0)
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, low, 1)
    np.add.at(inside, high, -1)
    free = np.cumsum(inside)[:-1] == 0
    if rule == "share":
        per = np.zeros(len(text) + 1)
        np.add.at(per, starts, 1.0 / (ends - starts))
        np.add.at(per, ends, -1.0 / (ends - starts))
        weight = np.cumsum(per)[:-1]
        total = np.concatenate([[0.0], np.cumsum(weight)])
        return total[high] - total[low], crossing, float(weight[free].sum())
    anchor = {"start": starts, "end": ends - 1, "middle": (starts + ends - 1) // 2}[rule]
    counts = np.searchsorted(anchor, high, "left") - np.searchsorted(anchor, low, "left")
    return np.where(high > low, counts, 0).astype(float), crossing, float(free[anchor].sum()) if len(anchor) else 0.0


_SENTENCE_END = re.compile(r"[.!?]\s+")


def sentence_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of a text as sections: they end behind `.`, `!` or `?` and the white space after it."""
    ends = np.array([m.end() for m in _SENTENCE_END.finditer(text)], np.int64)
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]]), ends


def section_counts(df: DataFrame, sections: Column | Callable, tokenizer: str, rule: str = "start", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing) for each section of each row.

    sections: array<struct<start: bigint, end: bigint>> of character offsets, a column over df (fields or sections);
    or a function of the text that returns arrays of starts and ends, such as sentence_spans.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans_of = sections if callable(sections) and not isinstance(sections, Column) else None
    given = F.lit(None).cast("array<struct<start: bigint, end: bigint>>") if spans_of else F.transform(
        F.filter(F.coalesce(sections, F.array()), lambda x: x.isNotNull()),
        lambda x: F.struct(F.coalesce(x["start"], F.lit(0)).cast("long").alias("start"),
                           F.coalesce(x["end"], F.lit(1 << 60)).cast("long").alias("end")))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), given.alias("sections"))
    names = ["id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches):
        for b in sliced(batches):
            lists = b.column(2)
            spans, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            given_low, given_high = spans.field("start").to_numpy(), spans.field("end").to_numpy()
            at, section, kept, out = [], [], [], [[] for _ in range(4)]
            for k, text in enumerate(b.column(1).to_pylist()):
                own = slice(bounds[k], bounds[k + 1])
                low, high = spans_of(text or "") if spans_of else (given_low[own], given_high[own])
                n, crossing, rest = attribute(text or "", low, high, tokenizer, rule)
                size = len(n) + (rest > 0)  # tokens of no section come last
                cells = (low, high, n, crossing) if size == len(n) else (
                    np.append(low, 0), np.append(high, 0), np.append(n, rest), np.append(crossing, 0))
                at.append(np.full(size, k))
                section.append(np.arange(size))
                kept.append(np.arange(size) < len(n))
                for column, values in zip(out, cells):
                    column.append(values)
            if not at:
                continue
            at, section, kept = (np.concatenate(x) for x in (at, section, kept))
            low, high, n, crossing = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(section, pa.int32(), mask=~kept), pa.array(low, pa.int64(), mask=~kept),
                 pa.array(high, pa.int64(), mask=~kept), pa.array(n, pa.float64()), pa.array(crossing, pa.int64())], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, section int, start long, end long, n_tokens double, n_crossing long")

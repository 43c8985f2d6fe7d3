"""Chat formatting by token-level assembly.

Role and text of each turn are encoded apart, as ordinary text, and reserved ids (beyond the vocabulary) are spliced
between them: [turn] role [sep] text [end]. No text can therefore yield a reserved id. So that the rendered string is
safe too, control strings inside texts are escaped reversibly: behind the first character of each (and of each that
holds escapes already) one more backslash is put; unescaping takes one away.

Loss mask: the token spans of the texts of the trained roles. A turn carries its place in the conversation and the
mask is the prefix sum of +1 at each span's start and -1 at its end.

Scale: places come from a distributed prefix sum: turns are range-partitioned by (conversation, turn), so that a
conversation of any size spreads over many tasks; each adds up as it encodes, and one broadcast row for each partition
gives what came before in its first conversation, the only one that can have begun earlier. Encoded turns aren't
shuffled for that. Nothing collects a conversation. digests() alone, a check value that is sequential by its
definition, streams the turns of a conversation through one task, without holding more than a turn.

Defined cases: a null text or role is empty. Turns go by turn (null first), then role, then text; repeated rows are
turns of their own. Null conversation ids form one conversation. An empty table gives no rows. Only the four named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import sliced, written
from ledgerlens.llm.tokens import ordinary_ids, rank_encoder, token_sizes

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Reserved strings around role and text, and the roles whose texts are trained on."""

    turn: str = "[INST]"
    sep: str = "[/INST]"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    more: tuple[str, ...] = ("<s>", "<|endoftext|>")

    def __post_init__(self):
        marks = self.marks
        for a in marks:
            if len(a) < 2 or ESCAPE in a:
                raise ValueError(f"a control string has two characters at least and no backslash: {a!r}")
            for b in marks:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b)))) or (a != b and a in b):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.turn, self.sep, self.end, *self.more)))

    def escape(self, text: str) -> str:
        """One more backslash behind the first character of each control string, plain or escaped."""
        return re.sub("|".join(rf"{re.escape(m[0])}(?=\\*{re.escape(m[1:])})" for m in self.marks), lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return re.sub("|".join(rf"{re.escape(m[0])}\\(?=\\*{re.escape(m[1:])})" for m in self.marks), lambda m: m[0][0], text)

    def ids(self, first: int) -> dict[str, int]:
        return {m: first + k for k, m in enumerate(self.marks)}


def first_reserved(tokenizer: str) -> int:
    return len(token_sizes(tokenizer))


def format_turns(df: DataFrame, tokenizer: str, template: Template = Template(), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, turn, ids, loss_start, loss_end (in ids), start (its place in the conversation).

    The ids of a conversation are those of its turns in order of start, gapless.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["conv_id", "turn", "ids", "loss_start", "loss_end"]

    def run(batches):
        reserved = template.ids(first_reserved(tokenizer))
        now, at, begun = None, 0, False
        for b in sliced(batches):
            out = [[], [], [], []]
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                ids = [reserved[template.turn], *ordinary_ids(tokenizer, template.escape(role)), reserved[template.sep]]
                low = len(ids)
                ids += ordinary_ids(tokenizer, template.escape(text))
                out[1].append(low if role in template.trained else 0)
                out[2].append(len(ids) if role in template.trained else 0)
                out[0].append([*ids, reserved[template.end]])
                if not begun or (conv != now and (conv == conv or now == now)):  # a new conversation; not-a-number equals itself
                    now, at, begun = conv, 0, True
                out[3].append(at)
                at += len(ids) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out[0], pa.list_(pa.int32())), *[pa.array(x, pa.int64()) for x in out[1:]]],
                names=[*names, "inside"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = ("conv_id", "turn", "role", "text")
    # rows go on in order of the partition: a task adds up places as it encodes, and no row changes place after that
    turns = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, loss_start long, loss_end long, inside long"
    ).withColumn("part", F.spark_partition_id()))
    # of each conversation one row for each partition that it spreads over
    sums = turns.groupBy("conv_id", "part").agg(F.sum(F.size("ids")).alias("n"))
    before = sums.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    # partitions are ranges, so only the first conversation of one can have begun before: a row for each partition at most
    before = F.broadcast(before.where("_before is not null"))
    same = turns["conv_id"].eqNullSafe(before["_conv"]) & (turns["part"] == before["_part"])
    return turns.join(before, same, "left").select(*names, (F.col("inside") + F.coalesce("_before", F.lit(0))).alias("start"))


def loss_mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """0 or 1 for each of n tokens, by the prefix sum of the span borders."""
    steps = np.zeros(n + 1, np.int64)
    for low, high in spans:
        steps[low] += 1
        steps[high] -= 1
    return np.cumsum(steps)[:n]


def parse(ids: np.ndarray, tokenizer: str, template: Template) -> list[tuple[str, str, np.ndarray, np.ndarray]]:
    """Role and text of each turn of an id sequence, with the places of its text tokens."""
    marks = template.ids(first_reserved(tokenizer))
    enc = rank_encoder(tokenizer)
    out = []
    turns, seps, ends = (np.flatnonzero(ids == marks[m]) for m in (template.turn, template.sep, template.end))
    for a, b, c in zip(turns, seps, ends, strict=True):
        role, text = (template.unescape(enc.decode(ids[i:j].tolist())) for i, j in ((a + 1, b), (b + 1, c)))
        out.append((role, text, b + 1, c))
    return out


def digests(turns: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """What reads back from the formatted ids, a row for each conversation.

    conv_id, n_turns, turns_sha256 (role, line break, text, line break of each turn), loss_chars and loss_sha256 (the
    unescaped text under the loss mask), formatted_chars (of the rendered string) and n_tokens.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches):
        enc = rank_encoder(tokenizer)
        first = first_reserved(tokenizer)
        strings = {v: k for k, v in template.ids(first).items()}
        now, held, done = None, None, []

        def start(conv):
            return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]

        def flush():
            columns = [list(x) for x in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa_conv)] + [
                pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=names)

        def close(x):
            done.append((x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]))

        pa_conv = None
        for b in batches:
            pa_conv = b.column(0).type
            lists = b.column(2)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten().to_numpy()
            lows, highs = b.column(3).to_pylist(), b.column(4).to_pylist()
            for k, conv in enumerate(b.column(0).to_pylist()):
                if held is None or conv != now:
                    if held is not None:
                        close(held)
                    now, held = conv, start(conv)
                ids = flat[bounds[k]: bounds[k + 1]]
                for role, text, _, _ in parse(ids, tokenizer, template):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                mask = loss_mask(len(ids), [(lows[k], highs[k])])
                under = template.unescape(enc.decode(ids[(mask == 1)].tolist()))
                held[3] += len(under)
                held[4].update(under.encode())
                special = np.flatnonzero(ids >= first)
                held[5] += len(enc.decode(ids[ids < first].tolist())) + sum(len(strings[int(i)]) for i in ids[special])
                held[6] += len(ids)
            if len(done) > 5000:
                yield flush()
        if held is not None:
            close(held)
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "start", "ids", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                           "formatted_chars long, n_tokens long")

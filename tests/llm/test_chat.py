import hashlib

import numpy as np
import public_tokenizers
import pytest

from ledgerlens.llm import chat

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
T = chat.Template()
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>[\\INST]", "[[INST]]", "<", "[/INST", "</s></s>", "<|endoftext|>", "\\", "<s>\\</s>", ""]


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = np.random.default_rng(0)
    parts = ["<", "/s>", "[", "INST]", "/INST]", "\\", "s>", "|endoftext|>", "a"]
    texts = NASTY + ["".join(rng.choice(parts, int(rng.integers(1, 9)))) for _ in range(3000)]
    safe = {}
    for t in texts:
        e = T.escape(t)
        assert T.unescape(e) == t
        assert not any(m in e for m in T.marks)
        assert safe.setdefault(e, t) == t


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        chat.Template(turn="<a<", sep="a<b")
    with pytest.raises(ValueError):
        chat.Template(turn="aba")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'clash' AS ids", "'clash' AS start", "'clash' AS part", "'clash' AS row")


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest(),
                len(loss := "".join(t for r, t in x if r == "assistant")), hashlib.sha256(loss.encode()).hexdigest(),
                sum(len(T.turn + T.escape(r) + T.sep + T.escape(t) + T.end) for r, t in x)) for c, x in out.items()}


def test_reads_back(spark):
    rows = [(c, k, ["user", "assistant", "system", None, "tool</s>"][(c + k) % 5], NASTY[(3 * c + k) % len(NASTY)] + f" é🙂{k}")
            for c in range(20) for k in range(1 + c % 7)]
    rows += [(3, 1, "assistant", "a tie"), (3, 1, "assistant", "a tie"), (None, 2, "assistant", "x"), (None, None, "user", None), (50, 0, None, None)]
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.digests(chat.format_turns(frame(spark, rows), RANKS, T), RANKS, T).collect()}
    assert got == plain(rows)


def test_places_of_a_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation: its turns are laid out gapless in order."""
    rows = [(7, k, "assistant" if k % 2 else "user", f"text {k} " * (k % 5)) for k in range(500)] + [(c, 0, "user", "hi") for c in range(100, 1100)]
    turns = chat.format_turns(frame(spark, rows), RANKS, T)
    at = 0
    for r in sorted((r for r in turns.collect() if r["conv_id"] == 7), key=lambda r: r["turn"]):
        assert r["start"] == at
        at += len(r["ids"])
        mask = chat.loss_mask(len(r["ids"]), [(r["loss_start"], r["loss_end"])])
        assert mask.sum() == (len(r["ids"]) - mask.argmax() - 1 if mask.any() else 0)


def test_places_need_no_shuffle_of_encoded_turns(spark):
    """Three conversations over all partitions, and one of not-a-number; the written turns are joined by a broadcast only."""
    rows = [(float(k % 3), k, "user", f"text {k} " * (k % 4)) for k in range(600)] + [(float("nan"), k, "user", "x") for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id double, turn long, role string, text string")
    turns = chat.format_turns(df, RANKS, T)
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    at = {}
    for r in sorted(turns.collect(), key=lambda r: r["turn"]):
        key = str(r["conv_id"])
        assert r["start"] == at.get(key, 0)
        at[key] = r["start"] + len(r["ids"])
    assert len(at) == 4


def test_mask_is_a_prefix_sum():
    assert chat.loss_mask(6, [(1, 3), (4, 6), (2, 2)]).tolist() == [0, 1, 1, 0, 1, 1]


def test_empty(spark):
    assert chat.digests(chat.format_turns(frame(spark, []), RANKS, T), RANKS, T).count() == 0


def test_turn_with_a_million_blanks(spark):
    text = "a" + " " * 1_000_000 + "b"
    talk = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn int, role string, text string")
    row = chat.digests(chat.format_turns(talk, RANKS), RANKS).first()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()

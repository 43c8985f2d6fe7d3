import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.tokens import encoder
from tests.llm.helpers import ODD_TEXTS, documents, empty_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_ids_are_those_of_tokenizers():
    slow = Tokenizer.from_file(PATH)
    fast = encoder(PATH)
    for t in [*ODD_TEXTS, "a <|endoftext|> b", "<|endoftext|>", "it's  \n\n we'll   ", "\t" * 3000, "ab" * 3000]:
        assert fast(t or "").tolist() == slow.encode(t or "", add_special_tokens=False).ids, (t or "")[:20]


def test_pieces_and_places(spark):
    size = 64
    texts = ["word " * n for n in (1, 5, 30, 62, 63, 64, 65, 127, 128, 300)] + ODD_TEXTS
    rows = packing.pack_documents(documents(spark, texts), PATH, size, 0).collect()
    slow = Tokenizer.from_file(PATH)
    got = defaultdict(dict)
    for r in rows:
        got[r["id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(got[i]) == list(range(math.ceil(len(ids) / size)))
        at = 0
        for k in sorted(got[i]):
            r = got[i][k]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            assert r["length"] == size or k == 0
            at += r["length"]
        assert at == len(ids)
    used = check_places(rows, size)
    assert used <= math.ceil(sum(r["length"] for r in rows) / size) + 2


def test_tree_of_rounds(spark):
    """Many small tasks, merged in rounds, still give few sequences, and every item once."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 3000).tolist()
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k long, length long")
    rows = packing.pack(df, 100, per_task=200).collect()
    assert sorted(r["k"] for r in rows) == list(range(3000))
    assert check_places(rows, 100) <= 1.03 * len(packing.best_fit(np.array(lengths), 100)) + 1


def test_items_over_half_the_size_end(spark):
    df = spark.createDataFrame([(k, 60) for k in range(500)], "k long, length long")
    assert check_places(packing.pack(df, 100, per_task=50).collect(), 100) == 500


def test_best_fit_takes_the_tightest():
    bins = packing.best_fit(np.array([60, 70, 30, 40]), 100)
    assert sorted(sorted(b) for b in bins) == [[0, 3], [1, 2]]


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = packing.pack_documents(df, PATH, 2048, 0).collect()
    assert sum(r["piece"] == 0 for r in rows) == df.count()
    check_places(rows, 2048)
    assert packing.pack_documents(empty_documents(spark), PATH).count() == 0

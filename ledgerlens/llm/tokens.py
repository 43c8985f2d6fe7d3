"""Byte-level BPE ids from a public rank file, one encoder a worker."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import tiktoken
import tokenizers

END_OF_TEXT = "<|endoftext|>"
#: White-space runs from this length on are not left to the pattern engine. The class is White_Space, as the engine's.
LONG_SPACE = 10_000
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_SPACE = re.compile(rf"(?<!{_SPACE}){_SPACE}{{{LONG_SPACE},}}")
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
_SIZES: dict[str, np.ndarray] = {}


def _tiktoken(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {END_OF_TEXT: len(ranks)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), ranks


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids. path: a .tiktoken rank file, or a tokenizers .json file with a rank file of that name beside it.

    With a .json path the ids are those of tokenizers, which takes the text of an added token for its id; the rank file
    gives the same ids several times faster. A text that its pattern engine gives up on (millions of blanks) goes to
    tokenizers itself.
    """
    if path not in _ENCODERS:
        as_json = path.endswith(".json")
        fast, _ = _tiktoken(path.removesuffix(".json") + ".tiktoken" if as_json else path)

        def encode(text: str) -> np.ndarray:
            try:
                if as_json and END_OF_TEXT in text:
                    return np.array(fast.encode(text, allowed_special="all"), np.int64)
                return np.array(fast.encode_ordinary(text), np.int64)
            except BaseException as e:  # the pattern engine panics with a class of its own
                if not as_json or isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                return np.array(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.int64)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def rank_encoder(path: str) -> tiktoken.Encoding:
    """The encoding itself, to encode ordinary text and to decode."""
    key = f"{path}#"
    if key not in _ENCODERS:
        _ENCODERS[key] = _tiktoken(path)[0]
    return _ENCODERS[key]


def ordinary_ids(path: str, text: str) -> list[int]:
    """Ids of ordinary text. Long white-space runs, of which a million characters overflow the pattern engine's stack, are
    cut out as the pattern cuts them: all but the last character, or all at the text's end, are one piece."""
    enc, ids, at = rank_encoder(path), [], 0
    half = LONG_SPACE // 2  # a long run covers a whole one of these windows; isspace takes no less than _SPACE
    if any(text[k: k + half].isspace() for k in range(0, len(text) - half + 1, half)):
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += enc.encode_ordinary(text[at: run.start()])
            ids += enc._encode_single_piece(text[run.start(): end])
            at = end
    return ids + enc.encode_ordinary(text[at:])


def token_sizes(path: str) -> np.ndarray:
    """Bytes of each ordinary token."""
    if path not in _SIZES:
        ranks = _tiktoken(path)[1]
        sizes = np.zeros(len(ranks) + 1, np.int64)
        for piece, k in ranks.items():
            sizes[k] = len(piece)
        _SIZES[path] = sizes
    return _SIZES[path]

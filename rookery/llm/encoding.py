"""Encoding of a corpus with a public byte-level BPE by monoid tree reduction.

A text is halved recursively down to leaves; leaves are encoded alone and neighbours joined.
A join re-encodes a window around the seam. The tokenizer first splits text by a pattern that
scans left to right and forgets what lies before a split, then merges bytes within each part, so
tokens on the far side of a certain split can't change. A position is a certain split, whatever
surrounds it, where a letter or digit is followed by white space or punctuation (see _ANCHOR).
The window grows until it reaches such a position on either side or the half's end. Joining is
associative: every tree gives the ids of encoding the text at once.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: A part of a text that is encoded at once; longer ones are halved.
LEAF_CHARS = 1024
#: The split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A certain split: letters and digits that every Unicode version knows, then space or punctuation.
_ANCHOR = re.compile(r"(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-鿋а-яА-Я])(?=[ \n!-/:-@\[-`{-~。、！？])")
_WINDOW = 64


def rank_file(folder: str, name: str) -> bytes:
    """The rank file of a tokenizer: one line a token, a few MB whatever the corpus."""
    with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def coding_of(name: str, raw: bytes):
    """(encode function, bytes of each id) of a rank file, once per process."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    coding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coding, sizes


def tokenizer(folder: str, name: str):
    return coding_of(name, rank_file(folder, name))


def _cut_after(ids, sizes: np.ndarray, n_bytes: int) -> int:
    """How many of the first ids make n_bytes bytes; the split must fall between two ids."""
    count, total = 0, 0
    for i in ids:
        if total >= n_bytes:
            break
        total += int(sizes[i])
        count += 1
    if total != n_bytes:
        raise AssertionError("a certain split fell inside a token")
    return count


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], coding, sizes: np.ndarray) -> tuple[str, list[int]]:
    """The encoding of the two halves' text put together."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return (a + b, x or y)
    back, reach = 0, _WINDOW
    while True:  # the last certain split in a
        begin = max(0, len(a) - reach)
        found = [m.start() for m in _ANCHOR.finditer(a, begin) if m.start() > begin]
        if found or begin == 0:
            back = found[-1] if found else 0
            break
        reach *= 4
    ahead, reach = len(b), _WINDOW
    while True:  # the first certain split in b
        m = next((m for m in _ANCHOR.finditer(b[: reach + 1], 1) if m.start() < min(reach + 1, len(b))), None)
        if m or reach >= len(b):
            ahead = m.start() if m else len(b)
            break
        reach *= 4
    tail = len(a[back:].encode())
    keep = len(x) - _cut_after(reversed(x), sizes, tail)
    skip = _cut_after(y, sizes, len(b[:ahead].encode()))
    return a + b, x[:keep] + coding.encode_ordinary(a[back:] + b[:ahead]) + y[skip:]


def encode_tree(text: str, coding, sizes: np.ndarray, leaf: int = LEAF_CHARS) -> list[int]:
    """ids of the text."""

    def reduce(part: str) -> tuple[str, list[int]]:
        if len(part) <= leaf:
            return part, coding.encode_ordinary(part)
        middle = len(part) // 2
        return join(reduce(part[:middle]), reduce(part[middle:]), coding, sizes)

    return reduce(text)[1]


def decode_tree(ids: list[int], coding) -> str:
    """The text of ids: bytes of halves put together up the tree, then read as UTF-8."""

    def reduce(part: list[int]) -> bytes:
        return coding.decode_bytes(part) if len(part) <= 4096 else reduce(part[: len(part) // 2]) + reduce(part[len(part) // 2 :])

    return reduce(list(ids)).decode("utf-8", errors="replace")


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF_CHARS) -> DataFrame:
    """(key, ids): ids array<int> without special tokens, their strings being ordinary text.

    Null and empty texts have an empty list. One row per input row, repeated keys included; other
    columns are ignored. One pass without shuffle; the driver reads the rank file and sends it along,
    so executors need no vocabulary of their own.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, sizes = coding_of(name, ranks.value)
        for batch in batches:
            lists = [encode_tree(t, coding, sizes, leaf) if t else [] for t in batch.column(1).to_pylist()]
            flat = np.fromiter((i for ids in lists for i in ids), np.int32, sum(map(len, lists)))
            offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["key", "ids"])

    return df.select(key, text).mapInArrow(run, f"key {dict(df.dtypes)[key]}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF_CHARS) -> DataFrame:
    """(*keys, n_tokens): the length of each text's encoding, 0 for null and empty texts."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, sizes = coding_of(name, ranks.value)
        for batch in batches:
            counts = [len(encode_tree(t, coding, sizes, leaf)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_tokens long"]))

"""Seams for models, with deterministic stand-ins."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.text import found_tokens, stretches

DIM = 64
#: Tokens whose directions are kept, and tokens of a batch that are summed at a time.
KEPT, AT_A_TIME = 200_000, 1 << 12


class _Seed(np.random.bit_generator.ISeedSequence):
    """A seed sequence whose state is known."""

    def __init__(self, state: np.ndarray):
        self.state = state

    def generate_state(self, n_words, dtype=np.uint32):
        return self.state


def _states(seeds: np.ndarray) -> np.ndarray:
    """SeedSequence(seed).generate_state(4, uint64) of each uint64 seed, for all at once."""
    u, half = np.uint32, np.uint32(16)
    constants = [0x43B0D7E5]
    for _ in range(16):
        constants.append(constants[-1] * 0x931E8875 & 0xFFFFFFFF)
    at = iter(range(16))

    def hashed(x: np.ndarray) -> np.ndarray:
        i = next(at)
        x = (x ^ u(constants[i])) * u(constants[i + 1])
        return x ^ (x >> half)

    def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = u(0xCA01F9DD) * x - u(0x4973F715) * y
        return x ^ (x >> half)

    zero = np.zeros(len(seeds), u)
    pool = [hashed(x) for x in ((seeds & np.uint64(0xFFFFFFFF)).astype(u), (seeds >> np.uint64(32)).astype(u), zero, zero)]
    for source in range(4):
        for target in range(4):
            if source != target:
                pool[target] = mixed(pool[target], hashed(pool[source]))
    out, constant = np.empty((len(seeds), 8), "<u4"), 0x8B51F9DD
    for i in range(8):
        x, constant = pool[i % 4] ^ u(constant), constant * 0x58F38DED & 0xFFFFFFFF
        x = x * u(constant)
        out[:, i] = x ^ (x >> half)
    return out.view("<u8").astype(np.uint64)


class _Directions(dict):
    """The place in rows of each token's pseudo-random direction, that of default_rng(its hash)."""

    def __init__(self, dim: int):
        self.dim, self.rows = dim, np.empty((1024, dim))

    def places(self, tokens: list[str]) -> np.ndarray:
        """Of distinct tokens; what isn't known is added to rows."""
        new = [t for t in tokens if t not in self]
        first = len(self)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows[:first], np.empty((max(first, len(new)), self.dim))))
        for i, state in enumerate(_states(np.array([xxhash.xxh3_64_intdigest(t) for t in new], np.uint64)), first):
            np.random.Generator(np.random.PCG64(_Seed(state))).standard_normal(out=self.rows[i])
        self.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


_DIRECTIONS: dict[int, _Directions] = {}


def hash_embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit rows: the sum of each token's own pseudo-random direction; no tokens give zeros."""
    out = np.zeros((len(texts), dim))
    held = _DIRECTIONS.setdefault(dim, _Directions(dim))
    lower = pa.array([(text or "").lower() for text in texts], pa.string())
    for first, end in stretches(lower):
        row, words = found_tokens(lower.slice(first, end - first))
        words = words.dictionary_encode()
        if len(held) > KEPT:
            held.clear()
        places = held.places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        ends = np.searchsorted(row, np.arange(end - first), "right").tolist()
        low = i = 0
        while i < len(ends):  # as many texts as hold AT_A_TIME tokens, or one
            j = max(i + 1, bisect.bisect_right(ends, low + AT_A_TIME))
            each = held.rows[places[low : ends[j - 1]]]
            at = low
            for text in range(i, j):
                if ends[text] > at:
                    np.add.reduce(each[at - low : ends[text] - low], axis=0, out=out[first + text])  # in the order of the text
                at = ends[text]
            i, low = j, ends[j - 1]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(dim: int = DIM):
    """A vectorised UDF text -> array<double>."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dim, pa.int32()), pa.array(hash_embed(s.to_pylist(), dim).ravel()))

    return run


def _overlap(question: pa.Array, body: pa.Array) -> pa.Array:
    """The share of each lower-case question's distinct tokens that its body holds; null for a null body."""
    asked, q = found_tokens(question)
    held, b = found_tokens(body)
    words = pa.concat_arrays([q, b]).dictionary_encode()
    code, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    wanted = np.unique(asked * n + code[: len(q)])
    sizes = np.bincount(wanted // n, minlength=len(question))
    both = np.bincount(wanted[np.isin(wanted, held * n + code[len(q) :])] // n, minlength=len(question))
    return pa.array(both / np.maximum(1, sizes), mask=(sizes > 0) & body.is_null().to_numpy(zero_copy_only=False))


def overlap_score(question: Column, body: Column) -> Column:
    """The rerank stand-in: the share of the question's distinct tokens that the body holds."""

    @F.arrow_udf("double")
    def run(q: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(_overlap(q.slice(i, j - i), b.slice(i, j - i)) for i, j in stretches(b))])

    return run(F.lower(question), F.lower(body))

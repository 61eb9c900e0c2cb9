"""An n-gram language model in Elias-Fano trie levels, trained and queried on executors.

Level 1 is the sorted sequence of the words' hashes; a word's id is its rank. Level 2 holds each word's
successors' ids, level 3 the successors of each pair of level 2, and so on up to the model's order. A
context's successors are one monotone run; runs are joined into one monotone sequence by adding
(context's place in the level above) x (words), and monotone pointers give each run's start. Sequences
and pointers are Elias-Fano coded: low bits packed, high bits in unary. A successor is looked for inside
its context's run alone, and its place there is the context of the next level. Probabilities and
back-off weights are quantised to 8 bits by level; word counts are kept exact, as the base score needs them.

p(w | c) = max(count - D, 0) / total(c) + backoff(c) * p(w | c without its first word), with absolute
discounting and D = n1 / (n1 + 2 n2) over all n-grams of that length; p(w) is the add-half unigram with one
unknown word. n-grams of three words or more that occur less than least_count times are left out; their
mass goes to backoff(c), so every context's probabilities sum to 1 but for quantisation.

Building: each task counts the n-grams of the full order in what it reads; shorter ones are sums over
these, so one shuffle makes all levels. It sends small sorted tries to shards, by the first word; a
shard's task merges them and another writes the shard's levels to the shared folder. Neither words nor
n-grams ever reach the driver. Scoring: each worker maps the levels' files into memory, so all workers of
a machine share the pages.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, fresh_path, map_to_table, small_batches
from .warc import store
from .wordhash import word_hashes

if TYPE_CHECKING:
    import pyarrow as pa

#: Fixed value: what stands for a document's end among the word hashes.
END = 0xE2D0_F7E8_17A9_5C33
#: Documents for each shard, tokens that a task holds before it sends their counts, tokens that are scored together.
SHARD_DOCS, HELD, ASKED = 4096, 1 << 20, 1 << 20
#: Words of the longest n-grams, and how often those of three words or more occur at least: 1 keeps all.
ORDER, LEAST_COUNT = 3, 1
BINS = 256


def hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def token_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each text): a text's words with A-Z lower-cased, then the end."""
    got = word_hashes(texts)
    end = np.array([END], dtype=np.uint64)
    return np.concatenate([x for g in got for x in (g, end)] or [end[:0]]), np.array([len(g) + 1 for g in got], dtype=np.int64)


# --- Elias-Fano -----------------------------------------------------------------------------------


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """values, each below 2**bits, as a bit string in 64-bit words."""
    out = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    # in two steps, as a shift by 64 is none
    high = words[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
    return (words[word] >> shift | high) & np.uint64((1 << bits) - 1)


def _byte_selects() -> np.ndarray:
    """For each byte and rank the place of the byte's set bit of that rank."""
    out = np.zeros((256, 8), dtype=np.uint64)
    for byte in range(256):
        for rank, at in enumerate(i for i in range(8) if byte >> i & 1):
            out[byte, rank] = at
    return out.ravel()


_SELECT = _byte_selects()
_U = np.arange(256, dtype=np.uint64)
_ODD, _PAIRS, _NIBBLES, _ONES, _HIGH = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))


class EliasFano:
    """A monotone sequence of n values below 2**64. The bits of a high part are found by a sampled directory."""

    def __init__(self, n: int, low_bits: int, first: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.first, self.low, self.high, self.ranks = n, low_bits, first, low, high, ranks
        self.zeros: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        first = int(values[0]) if n else 0
        rest = values.astype(np.uint64) - np.uint64(first)
        top = int(rest[-1]) if n else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = _pack(rest & np.uint64((1 << bits) - 1), bits)
        where = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(where[-1]) if n else 0) // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(high, where >> 6, np.uint64(1) << (where & 63).astype(np.uint64))
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return struct.pack("<QQQQQ", n, bits, first, len(low), len(high)) + low.tobytes() + high.tobytes() + ranks.astype("<i8").tobytes()

    @classmethod
    def at(cls, raw: np.ndarray, start: int) -> tuple[EliasFano, int]:
        """The sequence that starts at this byte of raw, and the byte after it."""
        n, bits, first, nl, nh = struct.unpack("<QQQQQ", raw[start : start + 40].tobytes())
        start += 40
        low = raw[start : start + 8 * nl].view("<u8")
        high = raw[start + 8 * nl : start + 8 * (nl + nh)].view("<u8")
        end = start + 8 * (nl + nh) + 8 * (nh + 1)
        return cls(n, bits, first, low, high, raw[start + 8 * (nl + nh) : end].view("<i8")), end

    @staticmethod
    def _within(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The place of the left-th set bit (from 0) in each word: its byte by running sums of all bytes' counts at once, then a table."""
        left = left.astype(np.uint64)
        c = bits - (bits >> _U[1] & _ODD)
        c = (c & _PAIRS) + (c >> _U[2] & _PAIRS)
        sums = (c + (c >> _U[4]) & _NIBBLES) * _ONES
        # bytes whose running sum is at most left keep their high bit
        byte = np.bitwise_count((left * _ONES | _HIGH) - sums & _HIGH).astype(np.uint64) << _U[3]
        rank = left - (sums << _U[8] >> byte & _U[255])
        return (byte + _SELECT[(bits >> byte & _U[255]) << _U[3] | rank]).astype(np.int64)

    @staticmethod
    def _lowest(bits: np.ndarray) -> np.ndarray:
        """The place of the lowest set bit; 64 for none."""
        return np.bitwise_count(~bits & bits - _U[1]).astype(np.int64)

    def _select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit (from 0) in high."""
        word = np.searchsorted(self.ranks, k, side="right") - 1
        return word * 64 + self._within(self.high[word], k - self.ranks[word])

    def _part(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a high part below h, and up to h: set bits before and after the zero that ends part h - 1."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
        beyond = np.flatnonzero(h > self.zeros[-1])
        k = np.maximum(h - 1, 0)
        k[beyond] = self.zeros[-1] - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        at = word * 64 + self._within(~self.high[word], k - self.zeros[word]) + 1
        at[h == 0] = 0
        below = at - h
        # the part's values are the set bits from there on; most stretches end in the same word
        word = np.minimum(at >> 6, len(self.high) - 1)
        after = ~self.high[word] >> (at & 63).astype(np.uint64)
        upto = below + self._lowest(after)
        far = np.flatnonzero(after == 0)
        while len(far):
            word[far] += 1
            inside = word[far] < len(self.high)
            upto[far[~inside]] = self.n
            far = far[inside]
            more = self._lowest(~self.high[word[far]])
            upto[far] = np.where(word[far] == (at[far] >> 6) + 1, below[far] + 64 - (at[far] & 63), upto[far]) + more
            far = far[more == 64]
        below[beyond] = upto[beyond] = self.n
        return below, np.minimum(upto, self.n, out=upto)

    def pair(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values k and k + 1."""
        at = self._select(k)
        shift = (at & 63).astype(np.uint64)
        after = self.high[at >> 6] >> shift >> _U[1]
        then = at + 1 + self._lowest(after)
        far = np.flatnonzero(after == 0)
        then[far] = self._select(k[far] + 1)
        value = lambda x, k: ((x - k).astype(np.uint64) << np.uint64(self.low_bits) | _unpack(self.low, self.low_bits, k)) + np.uint64(self.first)
        return value(at, k), value(then, k + 1)

    def get(self, k: np.ndarray) -> np.ndarray:
        k = k.astype(np.int64)
        high = (self._select(k) - k).astype(np.uint64)
        return (high << np.uint64(self.low_bits) | _unpack(self.low, self.low_bits, k)) + np.uint64(self.first)

    def find(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in [lo, hi) of each value's successor, hi if there is none; whether that is the value itself).

        The high part gives the few values that share it, so only their low bits are compared.
        """
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        rest = np.maximum(values, np.uint64(self.first)) - np.uint64(self.first)
        low = rest & np.uint64((1 << self.low_bits) - 1)
        high = (rest >> np.uint64(self.low_bits)).astype(np.int64)
        below, upto = self._part(high)
        a = np.clip(below, lo, hi)
        b = np.clip(upto, a, hi)
        same = np.zeros(len(a), dtype=bool)
        open_ = np.flatnonzero(a < b)
        x, y, want = a[open_], b[open_], low[open_]
        while len(open_):
            mid = (x + y) >> 1
            got = _unpack(self.low, self.low_bits, mid)
            less = got < want
            x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
            # what y stands at last decides
            same[open_] = np.where(less, same[open_], got == want)
            left = x < y
            a[open_] = x
            if left.all():
                continue
            open_, x, y, want = open_[left], x[left], y[left], want[left]
        if self.first:
            same &= values >= np.uint64(self.first)
        return a, same


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, table) of log probabilities: at most BINS levels, by quantiles; a level is the mean of what it stands for."""
    distinct = np.unique(values)
    if len(distinct) <= BINS:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct
    edges = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))
    codes = np.searchsorted(edges, values, side="right")
    n = np.bincount(codes, minlength=BINS)
    table = np.bincount(codes, weights=values, minlength=BINS) / np.maximum(n, 1)
    return codes.astype(np.uint8), table


# --- levels ---------------------------------------------------------------------------------------


def _save(folder: str, name: str, parts: list[bytes]) -> str:
    """Write a file under a name of this attempt's own; the committed table of names says which attempts count."""
    name = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, path = store(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p + b"\0" * (-len(p) % 8))
    return name


def _load(uri: str) -> np.ndarray:
    """The file, mapped into memory where the store has local files, else read."""
    fs, path = store(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)  # slices of a memmap cost more
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def _block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts, compressed."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes() + counts.astype("<u4").tobytes(), 1)


def _unblock(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    d = np.ascontiguousarray(b[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64), b[8 * n :].view("<u4").astype(np.int64)


def _merge(blocks: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    got = [_unblock(r, n) for r, n in blocks]
    if not got:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


_BLOCK = "shard int, n int, keys binary"


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """Blocks of sorted keys by shard; shard doesn't fall along the keys."""
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    ends = [*at[1:], len(keys)]
    return pd.DataFrame({"shard": shard[at].astype(np.int32) if len(at) else [], "n": [e - s for s, e in zip(at, ends, strict=False)], "keys": [_block(keys[s:e], counts[s:e]) for s, e in zip(at, ends, strict=False)]}).astype({"shard": "int32", "n": "int32"})


class Words:
    """Level 1 of a model: ids and counts of words, by hash."""

    def __init__(self, files: list[str]):
        self.shards, self.starts, n = [], [], 0
        for f in files:
            raw = _load(f)
            seq, end = EliasFano.at(raw, 0)
            self.shards.append((seq, raw[end:].view("<i8")))
            self.starts.append(n)
            n += seq.n
        self.n = n

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of hashes that lie sorted; id -1 and count 0 for unknown words."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shard = shard_of(hashes, len(self.shards))
        for lo, hi in _runs(shard):
            s = int(shard[lo])
            seq, c = self.shards[s]
            if not seq.n:
                continue
            k, hit = seq.find(hashes[lo:hi], np.zeros(hi - lo), np.full(hi - lo, seq.n))
            at = lo + np.flatnonzero(hit)
            ids[at], counts[at] = k[hit] + self.starts[s], c[k[hit]]
        return ids, counts

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """look_up(), once for each distinct hash."""
        own, _, back = distinct(hashes)
        ids, counts = self.look_up(own)
        return ids[back], counts[back]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of equal values."""
    edge = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)])).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True)) if len(x) else []


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _words_level(train: DataFrame, folder: str, shards: int) -> list[tuple]:
    """Rows (shard, file, words, tokens) of level 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def send() -> pd.DataFrame:
            h, c = np.unique(np.concatenate(held) if held else np.empty(0, dtype=np.uint64), return_counts=True)
            return _sent(h, c, shard_of(h, shards))

        for b in batches:
            held.append(token_hashes(b["text"])[0])
            n += len(held[-1])
            if n > HELD:
                yield send()
                held, n = [], 0
        yield send()

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge(list(zip(rows["keys"], rows["n"], strict=True)))
        name = _save(folder, f"words-{key[0]}", [EliasFano.encode(keys), counts.astype("<i8").tobytes()])
        return pd.DataFrame({"shard": [key[0]], "file": [name], "n": [len(keys)], "total": [counts.sum()]})

    made = train.select("text").mapInPandas(count, _BLOCK).groupBy("shard").applyInPandas(build, "shard int, file string, n long, total long")
    return [(r["shard"], r["file"], r["n"], r["total"]) for r in made.collect()]


class Tries:
    """n-grams of two words and more as levels of distinct prefixes, sorted: pairs, then for each longer length
    how many children a prefix has and the children's last words; counts of the longest."""

    def __init__(self, pairs: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray):
        self.pairs, self.levels, self.counts = pairs, levels, counts

    @classmethod
    def of(cls, pairs: np.ndarray, words: list[np.ndarray], counts: np.ndarray | None = None) -> Tries:
        """Of n-grams, as (first word << 32 | second word) and their further words; with how often each row counts."""
        keys, at = np.unique(pairs, return_inverse=True)
        levels, n = [], len(keys)
        for w in words:
            got, at = np.unique(at.astype(np.uint64) << np.uint64(32) | w, return_inverse=True)
            levels.append((np.bincount((got >> np.uint64(32)).astype(np.int64), minlength=n), (got & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
            n = len(got)
        return cls(keys, levels, np.bincount(at, weights=counts, minlength=n).astype(np.int64))

    def rows(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """What of() makes the same from."""
        pairs, words = self.pairs, []
        for children, w in self.levels:
            pairs, words = np.repeat(pairs, children), [np.repeat(x, children) for x in words]
            words.append(w)
        return pairs, words, self.counts

    def cut(self, lo: int, hi: int) -> Tries:
        """With pairs lo to hi alone."""
        pairs, levels = self.pairs[lo:hi], []
        for children, w in self.levels:
            ends = np.concatenate(([0], np.cumsum(children)))
            levels.append((children[lo:hi], w[ends[lo] : ends[hi]]))
            lo, hi = int(ends[lo]), int(ends[hi])
        return Tries(pairs, levels, self.counts[lo:hi])

    def dump(self) -> bytes:
        def planes(x: np.ndarray, kind: str) -> bytes:
            x = x.astype(kind)
            return struct.pack("<Q", len(x)) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()

        parts = [planes(np.diff(self.pairs, prepend=np.uint64(0)), "<u8")]
        for children, w in self.levels:
            parts += [planes(children, "<u4"), planes(w, "<u4")]
        return zlib.compress(b"".join([*parts, planes(self.counts, "<u4")]), 1)

    @classmethod
    def load(cls, raw: bytes, order: int) -> Tries:
        raw, at = zlib.decompress(raw), 0

        def planes(kind: str) -> np.ndarray:
            nonlocal at
            (n,), size = struct.unpack_from("<Q", raw, at), np.dtype(kind).itemsize
            x = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at + 8)
            at += 8 + n * size
            return np.ascontiguousarray(x.reshape(size, n).T).view(kind).ravel()

        pairs = np.cumsum(planes("<u8"), dtype=np.uint64)
        levels = [(planes("<u4").astype(np.int64), planes("<u4")) for _ in range(order - 2)]
        return cls(pairs, levels, planes("<u4").astype(np.int64))

    @classmethod
    def merge(cls, several: list[Tries]) -> Tries:
        got = [t.rows() for t in several]
        return cls.of(np.concatenate([g[0] for g in got]), [np.concatenate(x) for x in zip(*(g[1] for g in got), strict=True)], np.concatenate([g[2] for g in got]))

    def lengths(self, none: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length from 2: (place of the prefix in the length before, for pairs the first word; last word; count), without those that end in none."""
        counts = [self.counts]
        for children, _ in reversed(self.levels):
            ends = np.concatenate(([0], np.cumsum(children)))
            sums = np.concatenate(([0], np.cumsum(counts[0])))
            counts.insert(0, sums[ends[1:]] - sums[ends[:-1]])
        out = [((self.pairs >> np.uint64(32)).astype(np.int64), self.pairs & np.uint64(0xFFFFFFFF), counts[0])]
        place = np.arange(len(self.pairs))  # of each prefix among those that are left
        for (children, w), n in zip(self.levels, counts[1:], strict=True):
            parent, real = np.repeat(place, children), w != none
            out.append((parent[real], w[real], n[real]))
            place = np.where(real, np.cumsum(real) - 1, -1)
        return out


def windows(w: np.ndarray, sizes: np.ndarray, begin: int, none: int, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first << 32 | second word, further words) of the n-gram whose second word is each token; begin stands before a text, none after it."""
    n, ends = len(w), np.repeat(np.cumsum(sizes), sizes)
    first = np.concatenate((w[:1], w[:-1]))
    first[np.cumsum(sizes) - sizes] = begin
    more = []
    for j in range(1, order - 1):
        at = np.arange(n) + j
        more.append(np.where(at < ends, w[np.minimum(at, n - 1)], np.uint64(none)))
    return first << np.uint64(32) | w, more


def _level(context: np.ndarray, word: np.ndarray, count: np.ndarray, contexts: int, words: int, discount: float, least: int) -> tuple[list[bytes], np.ndarray]:
    """(the parts of a level's file, which n-grams it has)."""
    sums = np.bincount(context, weights=count, minlength=contexts)
    kept = count >= least
    context, word, count = context[kept], word[kept], count[kept]
    types = np.bincount(context, minlength=contexts)
    seen = np.bincount(context, weights=count, minlength=contexts)
    pcode, ptable = quantise(np.log10((count - discount) / sums[context]))
    bcode, btable = quantise(np.log10(np.where(types > 0, (sums - seen + discount * types) / np.maximum(sums, 1), 1.0)))
    pad = lambda t: np.pad(t, (0, BINS - len(t))).astype("<f8").tobytes()
    pointers = EliasFano.encode(np.concatenate(([0], np.cumsum(types))).astype(np.uint64))
    runs = EliasFano.encode(context.astype(np.uint64) * np.uint64(words) + word)
    return [struct.pack("<QQ", len(pcode), len(bcode)) + pointers + runs + pad(ptable) + pad(btable), pcode.tobytes(), bcode.tobytes()], kept


class Level:
    """Successors of a shard's contexts."""

    def __init__(self, raw: np.ndarray, at: int):
        n, m = struct.unpack("<QQ", raw[at : at + 16].tobytes())
        self.pointers, at = EliasFano.at(raw, at + 16)
        self.runs, at = EliasFano.at(raw, at)
        tables = raw[at : at + 16 * BINS].view("<f8")
        at += 16 * BINS
        self.probs, self.backs, self.pcode = 10.0 ** tables[:BINS], 10.0 ** tables[BINS:], raw[at : at + n]
        at += n + (-n % 8)
        self.bcode, self.end = raw[at : at + m], at + m + (-m % 8)

    def score(self, context: np.ndarray, word: np.ndarray, base: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(p(word | context), place of the n-gram or -1), where base has p without the context's first word; words below 0 are unknown, contexts aren't."""
        out, place = base.copy(), np.full(len(word), -1, dtype=np.int64)
        # equal contexts lie together: each has its run looked up once
        new = np.append(True, context[1:] != context[:-1])
        c, of = context[new], np.cumsum(new) - 1
        inside = np.flatnonzero(c + 1 < self.pointers.n)
        lo, hi = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        lo[inside], hi[inside] = self.pointers.pair(c[inside])
        lo, hi = lo[of], hi[of]
        at = np.flatnonzero(hi > lo)
        w, c = word[at], context[at]
        k, hit = self.runs.find((c * words + np.maximum(w, 0)).astype(np.uint64), lo[at], hi[at])
        hit &= w >= 0
        low = base[at] * self.backs[self.bcode[c]]
        low[hit] += self.probs[self.pcode[k[hit]]]
        out[at], place[at[hit]] = low, k[hit]
        return out, place


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, where one of each is, which one each key is); np.unique() would sort stably, which takes longer."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return own[new], order[new], back


class Ngrams:
    """Levels 2 and up, sharded by the first word's id."""

    def __init__(self, files: dict[int, str], per_shard: int, words: int, order: int):
        self.files, self.per_shard, self.words, self.order, self.open = files, per_shard, words, order, {}

    def shard(self, s: int) -> list[Level] | None:
        if s not in self.open:
            f, levels, at = self.files.get(s), [], 0
            raw = _load(f) if f else None
            while raw is not None and len(levels) < self.order - 1:
                levels.append(Level(raw, at))
                at = levels[-1].end
            self.open[s] = levels or None
        return self.open[s]

    def score(self, ids: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """p of each token after those before it in its text; ids below 0 are unknown, base has p(word).

        Each distinct n-gram is looked up once; its context is its place among the distinct ones of the length before.
        """
        starts = np.cumsum(sizes) - sizes
        context = np.concatenate((ids[:1], ids[:-1]))
        context[starts] = self.words
        out, word = base, (ids + 1).astype(np.uint64)
        shards, places = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for level in range(self.order - 1):
            at = np.flatnonzero(context >= 0)
            keys, first, back = distinct(context[at].astype(np.uint64) << np.uint64(32) | word[at])
            c, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
            shard, local = (c // self.per_shard, c % self.per_shard) if level == 0 else (shards[c], places[c])
            got, place = out[at[first]], np.full(len(keys), -1, dtype=np.int64)
            # contexts are sorted by shard
            for lo, hi in _runs(shard):
                if (levels := self.shard(int(shard[lo]))) is not None:
                    got[lo:hi], place[lo:hi] = levels[level].score(local[lo:hi], w[lo:hi], got[lo:hi], self.words)
            out = out.copy()
            out[at] = got[back]
            # a token's n-gram is the context of the next one
            own = np.full(len(ids), -1, dtype=np.int64)
            own[at] = np.where(place[back] >= 0, back, -1)
            context = np.concatenate((own[:1], own[:-1]))
            context[starts] = -1
            shards, places = shard, place
        return out


def _ngram_levels(train: DataFrame, folder: str, words: list[str], total: int, shards: int, order: int, least: int) -> tuple[dict[int, str], int]:
    """(files by shard, first words a shard) of the levels from 2 on. Contexts are word ids; `total` stands for a document's begin and the id after it for what follows the end."""
    spark = train.sparkSession
    per = -(-(total + 1) // shards)
    sent = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = cached("lm", words[0], lambda: Words(sent.value))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def send() -> pd.DataFrame:
            hashes, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            t = Tries.of(*windows(level.of(hashes)[0].astype(np.uint64), sizes, total, total + 1, order))
            shard = (t.pairs >> np.uint64(32)).astype(np.int64) // per
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            return pd.DataFrame({"shard": shard[at], "grams": [t.cut(lo, hi).dump() for lo, hi in zip(at, [*at[1:], len(shard)], strict=True)]}).astype({"shard": "int32"})

        for b in batches:
            hashes, sizes = token_hashes(b["text"])
            if not len(hashes):
                continue
            held.append((hashes, sizes))
            n += len(hashes)
            if n > HELD:
                yield send()
                n = 0
        if held:
            yield send()

    names = [f"{k}{j}" for j in range(2, order + 1) for k in ("once", "twice")]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        shard, held = None, []

        def merged() -> pa.RecordBatch:
            t = Tries.merge([Tries.load(x, order) for x in held])
            held.clear()
            stats = [int((c == k).sum()) for _, _, c in t.lengths(total + 1) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([t.dump()], pa.binary()), *[pa.array([x], pa.int64()) for x in stats]], ["shard", "grams", *names])

        for b in batches:
            for s, raw in zip(b.column("shard").to_pylist(), b.column("grams").to_pylist(), strict=True):
                if shard is not None and s != shard:
                    yield merged()
                shard = s
                held.append(raw)
        if held:
            yield merged()

    sent_ = train.select("text").mapInPandas(count, "shard int, grams binary").repartition(shards, "shard").sortWithinPartitions("shard")
    made = map_to_table(sent_, tally, "shard int, grams binary, " + ", ".join(f"{x} long" for x in names), "ngrams", shards << 12)
    n = made.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).first()
    discounts = [min(0.999, max(0.1, n[f"once{j}"] / (n[f"once{j}"] + 2 * n[f"twice{j}"]))) if n[f"once{j}"] else 0.5 for j in range(2, order + 1)]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, raw in zip(b["shard"], b["grams"], strict=True):
                parts, contexts, place = [], per, None
                for j, (context, word, c) in enumerate(Tries.load(raw, order).lengths(total + 1)):
                    if j == 0:
                        context = context - s * per
                    elif place is not None:
                        # an n-gram that is left out is the context of none
                        context = place[context]
                        word, c, context = word[context >= 0], c[context >= 0], context[context >= 0]
                    made_, kept = _level(context, word, c, contexts, total, discounts[j], least if j else 1)
                    parts += made_
                    contexts, place = int(kept.sum()), np.where(kept, np.cumsum(kept) - 1, -1)
                yield pd.DataFrame({"shard": [s], "file": [_save(folder, f"ngrams-{s}", parts)]}).astype({"shard": "int32"})

    files = made.select("shard", "grams").mapInPandas(build, "shard int, file string")
    return {r["shard"]: r["file"] for r in files.collect()}, per


class Model:
    def __init__(self, words: list[str], n: int, tokens_: int, ngrams: dict[int, str], per: int, order: int):
        self.words, self.n, self.tokens, self.ngrams, self.per, self.order = words, n, tokens_, ngrams, per, order


def train_model(train: DataFrame, folder: str | None = None, order: int = ORDER, least_count: int = LEAST_COUNT) -> Model:
    """The model of train's whole texts; null text counts as empty. Its size grows with the distinct n-grams of up to `order` words.

    n-grams of three words or more that occur less than least_count times are left out of it, but not of its counts.
    """
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = train.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "lm")
    train = train.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = max(4, train.count() // SHARD_DOCS)
    rows = sorted(_words_level(train, folder, shards))
    empty = _save(folder, "words-none", [EliasFano.encode(np.empty(0, dtype=np.uint64))])
    by = {r[0]: r[1] for r in rows}
    words = [by.get(s, empty) for s in range(shards)]
    n, total = sum(r[2] for r in rows), sum(r[3] for r in rows)
    if n >= (1 << 32) - 2:
        raise ValueError("too many distinct words")
    files, per = _ngram_levels(train, folder, words, n, shards, order, least_count) if n else ({}, 1)
    return Model(words, n, total, files, per, order)


def together(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batches (hashes, sizes), joined up to ASKED tokens: every shard is asked once for each, so few tokens at a time would cost more the more shards there are."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        if held and n + len(b[0]) > ASKED:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
        held.append(b)
        n += len(b[0])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but the text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    A text is its words and one end; null text is the end alone. Repeated rows stay; own columns of
    these names are replaced. An untrained model knows nothing: base_score is 0 for its one unknown word.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = model.words[0]

    @F.pandas_udf("struct<n_tokens: long, n_known: long, base_score: double, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        words, grams = cached("lm", key + "/score", lambda: (Words(m.words), Ngrams(m.ngrams, m.per, m.n, m.order)))
        whole = m.tokens + 0.5 * (m.n + 1)
        for hashes, sizes in together(map(token_hashes, batches)):
            ids, counts = words.of(hashes)
            alone = (counts + 0.5) / whole
            starts = np.cumsum(sizes) - sizes
            base, full = np.log10(alone), np.log10(grams.score(ids, sizes, alone))
            known = (counts > 0).astype(np.int64)
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (known, base, full)]
            yield pd.DataFrame({"n_tokens": sizes.astype(np.int64), "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    out = docs.withColumn("__s", run(F.coalesce(F.col("text").cast("string"), F.lit("")))).drop("text", "n_tokens", "n_known", "base_score", "score", "train_tokens")
    return out.select("*", "__s.n_tokens", "__s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "__s.base_score", "__s.score").drop("__s")

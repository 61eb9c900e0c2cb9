"""Repeated passages by suffix arrays: every byte that an earlier equal passage of WIDTH bytes covers is removed.

A window is WIDTH bytes. Equal windows must meet, wherever they are, without shipping each one:
1. Documents are written to blocks of about BLOCK bytes. A window's mark is the least hash of its GRAM-byte grams; equal
   windows have equal marks, and windows in a row mostly share one, so they are one segment of the text. Blocks
   send the marks that they have, 12 bytes each, to the marks' groups.
2. A group tells the blocks which marks occur more than once in all; only their segments can hold equal windows.
3. Blocks send these segments' bytes to the groups of their marks, of equal segments the earliest one. A group does the
   same over blocks, sorts its segments by mark and builds suffix
   arrays of whole marks, about UNIT bytes at a time, by two-stage sorting; of adjacent windows with a common prefix of
   WIDTH bytes all but the earliest repeat. The groups tell the blocks which windows are first.
4. Blocks remove the bytes of the other windows of those segments.
Texts are never shuffled: tasks read blocks from the shared folder. Marks choose only where windows meet; bytes decide.

A mark with more than HOT segments, such as one of a line that a third of all documents have, is split by content: its windows
are dealt by the place of the mark in them (CLASS places at a time) and by a hash of the bytes that all windows of these places hold, and equal
segments are reduced in CROWD groups before they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_to_table, materialize, small_batches
from .wordhash import mix

if TYPE_CHECKING:
    import pyarrow as pa

WIDTH, GRAM = 100, 32
#: Bytes of texts in a block, of marks and of segments in a group, and of segments in one suffix array, about.
BLOCK, MARKS, GROUP, UNIT = 4 << 20, 4 << 20, 4 << 20, 1 << 20
#: Segments of a mark from which it is split, places of the mark in a class, groups that a hot group's equal segments are reduced in.
HOT, CLASS, CROWD = 1 << 15, 10, 16
#: Windows of a segment at most: a text of one repeated byte has one mark.
RUN = 256
#: Bytes that are hashed at once.
PIECE = 1 << 16
_R = 0x9E3779B97F4A7C15
SEGMENT = np.dtype([("key", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("len", "<u4")])
DOC = np.dtype([("null", "u1"), ("id", "<i8"), ("hash", "<i8")])


# --- suffix array ------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """At each place, the end included, the next 8 bytes as a number that sorts as they do; behind the end are zeros."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text) + 1, dtype=np.uint64)
    for i in range(8):
        out[:-1] = out[:-1] << np.uint64(8) | padded[i : i + len(text)]
    return out


def _sorted(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """at sorted by the next `depth` bytes at least: a few bytes a round, each round among the ties of the last one.

    A round sorts one number: the tie's group, then as many of the next bytes as there is room for.
    """
    if not len(at):
        return at
    key = words[at]
    order = np.argsort(key)
    at, key, done = at[order], key[order], 8
    tied = np.arange(len(at))
    while done < depth:
        new = np.append(True, key[1:] != key[:-1])
        open_ = ~(new & np.append(new[1:], True))
        tied, group = tied[open_], np.cumsum(new)[open_]
        if not len(tied):
            break
        group = np.cumsum(np.append(False, group[1:] != group[:-1])).astype(np.uint64)
        fits = (64 - int(group[-1]).bit_length()) // 8
        key = words[np.minimum(at[tied] + done, len(words) - 1)]
        if fits < 8:
            key = group << np.uint64(8 * fits) | key >> np.uint64(64 - 8 * fits)
        order = np.argsort(key)
        at[tied], key, done = at[tied[order]], key[order], done + fits
    return at


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes of text (bytes) in the order of their first `depth` bytes at least, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. The others are induced: a finished bucket of first
    byte c puts, in its order, the suffixes one place before with a greater first byte into these bytes' buckets;
    those with the same first byte follow as chains within the bucket. What ties over `depth` bytes has any order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # a suffix is smaller if its byte is less than the next other one; the last byte's stretch is not
    cut = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    up = np.append(text[cut[:-1]] < text[cut[:-1] + 1], False)
    smaller = np.repeat(up, np.diff(np.append(-1, cut)))
    direct = _sorted(np.flatnonzero(smaller), _words(text), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix is a prefix of nothing else: first of the induced ones of its byte
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        chains = [np.concatenate(induced[c])] if induced[c] else []
        while chains and len(chains[-1]):
            before = chains[-1] - 1
            chains.append(before[(before >= 0) & (text[before] == c)])
        bucket = np.concatenate([*chains, direct[bounds[c] : bounds[c + 1]]])
        before = bucket - 1
        byte = text[before]
        ahead = (before >= 0) & (byte > c)
        before, byte = before[ahead], byte[ahead]
        order = np.argsort(byte, kind="stable")
        before, ends = before[order], np.searchsorted(byte[order], np.arange(257))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            induced[b].append(before[ends[b] : ends[b + 1]])
        out.append(bucket)
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For neighbours in sa whether their first `width` bytes are equal; none may be nearer than `width` to the end."""
    same = np.arange(max(len(sa) - 1, 0))
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        same = same[words[sa[same] + k] == words[sa[same + 1] + k]]
    out = np.zeros(max(len(sa) - 1, 0), dtype=bool)
    out[same] = True
    return out


# --- segments ------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(PIECE + WIDTH, _R, dtype=np.uint64), np.full(PIECE + WIDTH, pow(_R, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all grams of k bytes, piece by piece, so that what it works on stays in the cache."""
    up, down = _powers()
    out = np.empty(max(len(raw) - k + 1, 0), dtype=np.uint64)
    for lo in range(0, len(out), PIECE):
        part = raw[lo : lo + PIECE + k - 1]
        sums = np.append(np.uint64(0), np.cumsum(_values()[part] * up[: len(part)], dtype=np.uint64))
        out[lo : lo + PIECE] = mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1])
    return out


def _least(values: np.ndarray, places: int) -> np.ndarray:
    """The least of each `places` values in a row."""
    out = np.empty(len(values) - places + 1, dtype=values.dtype)
    for lo in range(0, len(out), PIECE):
        least, span = values[lo : lo + PIECE + places - 1], 1
        while span * 2 <= places:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        more = places - span
        out[lo : lo + PIECE] = np.minimum(least[: len(least) - more], least[more:])
    return out


class Segments:
    """The windows of a block's texts, as segments with one mark: key, doc, at (place in the block), n (windows)."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        self.raw, self.ends = raw, np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(raw) - WIDTH + 1
        self.real = np.zeros(max(n, 0), dtype=bool)
        if n <= 0 or not (sizes >= WIDTH).any():
            self.key = self.mark = self.grams = np.zeros(0, dtype=np.uint64)
            self.at = self.n = self.doc = np.zeros(0, dtype=np.int64)
            return
        edge = np.zeros(n + 1, dtype=np.int32)
        whole = sizes >= WIDTH
        np.add.at(edge, self.starts[whole], 1)
        np.add.at(edge, self.ends[whole] - WIDTH + 1, -1)
        self.real = np.cumsum(edge[:n]) > 0
        self.grams = _rolling(raw, GRAM)
        self.mark = _least(self.grams, WIDTH - GRAM + 1)
        self.at, self.n = self._cut(self.mark, self.real)
        self.key = self.mark[self.at]
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    @staticmethod
    def _cut(label: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the stretches of one label among the real places, at most RUN long."""
        new = np.append(True, (label[1:] != label[:-1]) | (real[1:] != real[:-1]))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(label)))
        keep = real[at]
        at, n = at[keep], n[keep]
        parts = -(-n // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, n = np.repeat(at, parts) + k * RUN, np.repeat(n, parts) - k * RUN
        return at, np.minimum(n, RUN)

    def again(self) -> np.ndarray:
        """Which segments have their mark in several places, and so can have equal windows."""
        order = np.argsort(-self.n)
        at, key, ends = self.at[order], self.key[order], -self.n[order]
        hits = np.zeros(len(at), dtype=np.int32)
        for k in range(int(self.n.max(initial=0)) + WIDTH - GRAM):
            live = int(np.searchsorted(ends, WIDTH - GRAM - k, side="left"))
            hits[:live] += self.grams[at[:live] + k] == key[:live]
        out = np.zeros(len(at), dtype=bool)
        out[order] = hits > 1
        return out

    def within(self, chosen: np.ndarray) -> np.ndarray:
        """Which windows are in the chosen segments."""
        edge = np.zeros(len(self.real) + 1, dtype=np.int32)
        np.add.at(edge, self.at[chosen], 1)
        np.add.at(edge, self.at[chosen] + self.n[chosen], -1)
        return np.cumsum(edge[:-1]) > 0

    def split(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, at, n) of the chosen segments, by the place of the mark in a window and what all windows of these places hold."""
        core = WIDTH - CLASS + 1
        hashes = _rolling(self.raw, core)
        here = self.within(chosen)
        at = np.flatnonzero(here)
        # the first gram of the window that has the mark: equal windows have it at one place
        place = np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        for k in range(WIDTH - GRAM + 1):
            hit = self.grams[at[open_] + k] == self.mark[at[open_]]
            place[open_[hit]] = k
            open_ = open_[~hit]
            if not len(open_):
                break
        kind = place // CLASS
        inner = at + place - kind * CLASS
        label = np.zeros(len(self.mark), dtype=np.uint64)
        label[at] = mix(self.mark[at] ^ mix(hashes[inner] + kind.astype(np.uint64)))
        starts, n = self._cut(label, here)
        return label[starts], starts, n


def _gather(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[at[0] : at[0] + size[0]], then the next ones, in one array."""
    ends = np.cumsum(size)
    return raw[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def earliest(segments: np.ndarray, age: np.ndarray, data: bytes) -> np.ndarray:
    """Of segments with the same key and bytes (which follow each other in data) the one with the least (age, at)."""
    ends = np.cumsum(segments["len"], dtype=np.int64).tolist()
    best: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for i, (key, a, at, n, end) in enumerate(zip(segments["key"].tolist(), age.tolist(), segments["at"].tolist(), segments["len"].tolist(), ends, strict=True)):
        x, old = (key, data[end - n : end]), (a, at, i)
        if best.setdefault(x, old) > old:
            best[x] = old
    return np.array(sorted(i for _, _, i in best.values()), dtype=np.int64)


def first_windows(segments: np.ndarray, rank: np.ndarray, data: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of the windows that are the earliest of those equal to them, by rank of the document and place.

    segments: SEGMENT rows whose bytes follow each other in data; windows are compared among segments of one key.
    """
    order = np.argsort(segments["key"], kind="stable")
    size = segments["len"].astype(np.int64)
    begin = np.cumsum(size) - size
    key = segments["key"][order]
    last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else np.zeros(0, dtype=np.int64)
    whole = np.append(0, np.cumsum(size[order] + 1))
    out, lo = [], 0
    while lo < len(order):
        # as many whole keys as fit, one at least
        k = max(np.searchsorted(whole[last], whole[lo] + unit, side="right") - 1, np.searchsorted(last, lo, side="right"))
        hi = int(last[k])
        part = order[lo:hi]
        out.append(_first(part, segments, begin[part], size[part], rank[part], data))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (begin, begin)


def _first(part: np.ndarray, segments: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stops = np.cumsum(size + 1)
    text = np.full(stops[-1], 255, dtype=np.uint8)  # no UTF-8 text has this byte: it ends each segment
    inside = np.ones(len(text), dtype=bool)
    inside[stops - 1] = False
    text[inside] = _gather(data, begin, size)
    words = _words(text)
    sa = suffix_array(text)
    owner = np.repeat(np.arange(len(size)), size + 1)
    left = stops - 1
    sa = sa[left[owner[sa]] - sa >= WIDTH]
    same = common_prefixes(sa, words)
    of = owner[sa]
    inner = sa - (stops - size - 1)[of]
    age = np.lexsort((segments["at"][part][of] + inner, rank[of]))
    place = np.empty(len(age), dtype=np.int64)
    place[age] = np.arange(len(age))
    heads = np.flatnonzero(np.append(True, ~same)) if len(sa) else np.zeros(0, dtype=np.int64)
    chosen = age[np.minimum.reduceat(place, heads)] if len(heads) else heads
    return part[of[chosen]], inner[chosen]


# --- blocks and groups ---------------------------------------------------------------------------------


def _open(folder: str, block: int):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{folder}/{block:016x}.parquet")


def _read_block(folder: str, block: int):
    import pyarrow.parquet as pq

    store, at = _open(folder, block)
    t = pq.read_table(at, filesystem=store)
    texts = t.column("text").to_pylist()
    raws = [x or b"" for x in texts]
    return t, raws, Segments(np.frombuffer(b"".join(raws), dtype=np.uint8), np.array([len(r) for r in raws], dtype=np.int64))


def _by_group(key: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    group = (key % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        yield g, order[ends[g] : ends[g + 1]]


def _write_blocks(folder: str, groups: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import secrets

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            number = secrets.randbits(63)  # each attempt writes blocks of its own; those that count are in its rows
            store, at = _open(folder, number)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            pq.write_table(pa.Table.from_batches(held), at, filesystem=store, compression="zstd")
            seg = _read_block(folder, number)[2]
            key, n = np.unique(np.concatenate([seg.key, seg.key[seg.again()]]), return_counts=True)
            rows = [(g, key[some].tobytes(), n[some].astype("<u4").tobytes()) for g, some in _by_group(key, groups)]
            return pa.RecordBatch.from_arrays(
                [pa.array([-1, *[r[0] for r in rows]], pa.int64()), pa.array([number] * (len(rows) + 1), pa.int64()), pa.array([None, *[r[1] for r in rows]], pa.binary()), pa.array([None, *[r[2] for r in rows]], pa.binary())],
                ["g", "block", "marks", "n"],
            )

        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                begun = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, begun + block - size, side="right")), at if held else at + 1)
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(ends[to - 1]) - begun
                if to < b.num_rows:
                    yield flush()
                    held, size = [], 0
                at = to
        if held:
            yield flush()

    return run


def _repeated(hot: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        """For each block of a group the marks that all blocks together have twice or more, and those that they have too often."""
        import pyarrow as pa

        blocks = t.column("block").to_pylist()
        keys = [np.frombuffer(x, dtype="<u8") for x in t.column("marks").to_pylist()]
        counts = [np.frombuffer(x, dtype="<u4") for x in t.column("n").to_pylist()]
        all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
        out, lo = [], 0
        for block, key, n in zip(blocks, keys, counts, strict=True):
            many = total[lo : lo + len(key)]
            lo += len(key)
            cool, warm = (many > 1) & (many <= hot), many > hot
            out.append((block, key[cool].tobytes(), key[warm].tobytes(), int(n[cool].sum()), int(n[warm].sum())))
        out = [r for r in out if r[3] or r[4]]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["block", "marks", "hot", "n", "n_hot"])

    return run


def _chosen(t: pa.Table, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's segments have repeated marks, and which have hot ones, from the block's rows of _repeated()."""
    known = [np.concatenate([np.frombuffer(x, dtype="<u8") for x in t.column(c).to_pylist() if x] or [np.zeros(0, dtype="<u8")]) for c in ("marks", "hot")]
    return np.isin(seg.key, known[0]), np.isin(seg.key, known[1])


def _send(folder: str, groups: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        """A block's segments with repeated marks, by group: their bytes and whose they are."""
        import pyarrow as pa

        block = t.column("block")[0].as_py()
        docs, _, seg = _read_block(folder, block)
        cool, hot = _chosen(t, seg)
        rows: list[tuple] = []
        for parts, crowded in (((seg.key[cool], seg.at[cool], seg.n[cool]), False), (seg.split(np.flatnonzero(hot)) if hot.any() else None, True)):
            if parts is None or not len(parts[0]):
                continue
            key, at, n = parts
            made = np.zeros(len(key), dtype=SEGMENT)
            made["key"], made["doc"], made["at"], made["len"] = key, np.searchsorted(seg.ends, at, side="right"), at, n + WIDTH - 1
            for g, some in _by_group(key, groups):
                rows.append(_pack(g, block, docs, made[some], seg.raw, crowded))
        return _rows(rows)

    return run


COLUMNS = ("g", "block", "crowded", "segments", "docs", "bytes")
SENT = "g long, block long, crowded boolean, segments binary, docs binary, bytes binary"


def _rows(rows: list[tuple]) -> pa.Table:
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(COLUMNS))


def _pack(g: int, block: int, docs: pa.Table, made: np.ndarray, raw: np.ndarray, crowded: bool) -> tuple:
    used, made["doc"] = np.unique(made["doc"], return_inverse=True)
    table = np.zeros(len(used), dtype=DOC)
    some = docs.take(used)
    ids = some.column("doc_id")
    table["null"] = ids.is_null().to_numpy()
    table["id"] = ids.fill_null(0).to_numpy()
    table["hash"] = some.column("hash").to_numpy()
    age = np.empty(len(table), dtype=np.int64)
    age[np.lexsort((used, table["hash"], table["id"], table["null"]))] = np.arange(len(table))
    size = made["len"].astype(np.int64)
    # of equal segments of a block only the earliest is sent
    made = made[earliest(made, age[made["doc"]], _gather(raw, made["at"].astype(np.int64), size).tobytes())]
    return g, block, crowded, made.tobytes(), table.tobytes(), _gather(raw, made["at"].astype(np.int64), made["len"].astype(np.int64)).tobytes()


def _load(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(segments, their row, rank of the document over blocks, bytes, blocks of the rows) of the rows of a group."""
    segments = [np.frombuffer(x, dtype=SEGMENT) for x in t.column("segments").to_pylist()]
    docs = [np.frombuffer(x, dtype=DOC) for x in t.column("docs").to_pylist()]
    blocks = t.column("block").to_numpy()
    flat = np.concatenate(docs)
    of = np.repeat(blocks, [len(d) for d in docs])
    begin = np.cumsum([0, *[len(d) for d in docs]])
    order = np.lexsort((of, flat["hash"], flat["id"], flat["null"]))
    rank = np.empty(len(order), dtype=np.int64)
    new = np.append(True, (flat[order][1:] != flat[order][:-1]) | (of[order][1:] != of[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
    rank[order] = np.cumsum(new)
    row = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    every = np.concatenate(segments)
    return every, row, rank[begin[row] + every["doc"]], b"".join(t.column("bytes").to_pylist()), blocks


def _reduce(t: pa.Table) -> pa.Table:
    """Rows of a crowded group with the earliest of each segment only."""
    every, row, rank, data, blocks = _load(t)
    size = every["len"].astype(np.int64)
    kept = earliest(every, rank, data)
    docs = t.column("docs").to_pylist()
    out = []
    for k in np.unique(row[kept]).tolist():
        some = kept[row[kept] == k]
        out.append((t.column("g")[k].as_py(), blocks[k], True, every[some].tobytes(), docs[k], _gather(np.frombuffer(data, dtype=np.uint8), np.cumsum(size)[some] - size[some], size[some]).tobytes()))
    return _rows(out)


def _firsts(unit: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        """For each block the stretches [start, end) of windows in the group's segments that are the earliest of their kind."""
        import pyarrow as pa

        every, row, rank, data, blocks = _load(t)
        # copies have most of their segments whole: only the earliest of equal ones can hold first windows
        kept = earliest(every, rank, data)
        size = every["len"].astype(np.int64)
        data = _gather(np.frombuffer(data, dtype=np.uint8), np.cumsum(size)[kept] - size[kept], size[kept])
        which, inner = first_windows(every[kept], rank[kept], data, unit)
        which = kept[which]
        block, at = blocks[row[which]], every["at"][which].astype(np.int64) + inner
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        out = []
        for k in np.unique(block).tolist():
            a = at[block == k]
            new = np.append(True, np.diff(a) > 1)
            start = a[new]
            end = a[np.append(new[1:], True)] + 1
            out.append((k, np.stack([start, end], axis=1).astype("<i8").tobytes()))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["block", "first"])

    return run


def _removed(folder: str) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        """A block's documents with what is left of them, from the marks that repeat and the windows that are first."""
        import pyarrow as pa

        docs, raws, seg = _read_block(folder, t.column("block")[0].as_py())
        window = seg.within(np.logical_or(*_chosen(t, seg)))
        for x in t.column("first").to_pylist():
            if x:
                for a, b in np.frombuffer(x, dtype="<i8").reshape(-1, 2).tolist():
                    window[a:b] = False
        edge = np.zeros(len(seg.raw) + 1, dtype=np.int64)
        at = np.flatnonzero(window)
        edge[at] += 1
        edge[at + WIDTH] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        out: dict[str, list] = {"n_removed": [], "spans": [], "kept": []}
        for raw, lo, hi in zip(raws, seg.starts.tolist(), seg.ends.tolist(), strict=True):
            c = covered[lo:hi]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
            out["n_removed"].append(int(c.sum()))
            out["spans"].append([{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()])
            out["kept"].append(np.frombuffer(raw, dtype=np.uint8)[~c].tobytes() if len(turn) else raw)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            [docs.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], kind), pa.array(out["kept"], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", block: int = BLOCK, unit: int = UNIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of the removed runs, in bytes) and the kept bytes of each row.

    A byte is removed if a string of WIDTH bytes that covers it starts earlier too: in a smaller doc_id, or earlier in
    the same document. Texts are UTF-8; what is left of one can begin or end within a character. Null texts are empty; texts of fewer bytes
    lose nothing. Null doc_ids come last. Rows of one doc_id are documents in the order of their texts' hashes, and of equal rows, which
    stay rows, one is the first. Other columns are ignored. No row, no result. doc_id must be a whole number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a segment is a mark and 39 bytes on, of which 12 are sent
    groups = max(1, total // 3 // MARKS)
    folder = fresh_path(spark, "blocks")
    sent = map_to_table(rows, _write_blocks(folder, groups, block), "g long, block long, marks binary, n binary", "marks")
    tasks = max(1, min(1 << 14, int(total // block) + 1))
    marks = sent.where("g >= 0").repartition(groups, "g").groupBy("g").applyInArrow(_repeated(hot), "block long, marks binary, hot binary, n long, n_hot long")
    marks = materialize(marks, "repeated")
    load = marks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_hot"), F.lit(0)).alias("hot")).first()
    per = max(1, (load["n"] + load["hot"]) * (WIDTH + 64) // GROUP)
    segments = marks.repartition(tasks, "block").groupBy("block").applyInArrow(_send(folder, per), SENT)
    if load["hot"]:
        segments = materialize(segments, "segments")
        crowd = segments.where("crowded").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(CROWD)))
        reduced = crowd.repartition(per * CROWD, "g", "part").groupBy("g", "part").applyInArrow(lambda t: _reduce(t.drop(["part"])), SENT)
        segments = segments.where("not crowded").unionByName(reduced)
    first = materialize(segments.repartition(per, "g").groupBy("g").applyInArrow(_firsts(unit), "block long, first binary"), "first")
    told = sent.where("g < 0").select("block").unionByName(marks.select("block", "marks", "hot"), True).unionByName(first, True)
    spans = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return told.repartition(tasks, "block").groupBy("block").applyInArrow(_removed(folder), spans)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
f AS (SELECT s, min(doc_id * 4294967296 + i) AS first FROM w GROUP BY s),
x AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE doc_id * 4294967296 + i > first),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM x) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

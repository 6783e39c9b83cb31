"""Removal of repeated byte strings, keeping the first: longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus, that is, if the longest
previous factor of some suffix before it is at least LENGTH. A suffix array of the whole corpus would be shuffled many
times over, so suffixes first meet by content: each window of LENGTH bytes has a minimizer, the least hash of its K-byte
strings, and equal windows have equal ones, however far apart they are.

1. Documents are packed into compressed blocks of bounded size and written once. A document whose whole text an earlier
   one has is removed whole and sends nothing more: its windows are all in that one. Texts are equal by SHA-256.
2. Each block sends 32 bits of its minimizers' hashes, with counts, to buckets; buckets answer which occur more than
   once. That two differ but agree in bucket and bits only sends contexts in vain.
3. Blocks send, for these alone, the bytes of the windows around them. What repeats inside a block is settled there, so
   a passage that a third of all documents have is sent once for each block. Windows around a very frequent minimizer
   are sent one by one to buckets of their own content, so no bucket depends on one minimizer; with many blocks these
   are settled in groups of blocks first, and only the first of each group goes on.
4. In a bucket, equal contexts are settled by comparing their bytes. The rest get a suffix array to depth LENGTH by
   prefix doubling of ranks. In suffix order the previous and the next smaller position are found, the longer common
   prefix with these two is the longest previous factor (to LENGTH), and where it is LENGTH the window has a match.
5. The matched ranges go back to their blocks, which remove them.

Hashes of windows only bring candidates together: equal windows always have the same minimizer, as it depends on their
bytes alone, and every match inside texts rests on compared bytes or ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Rolling, integer_id, materialize, mix, row_blocks, ship, slices, utf8_view

LENGTH, K = 100, 32
BLOCK = 4 << 20
#: Bytes of a block that one vectorised step works on.
STEP = 2 << 20
#: Occurrences from which a minimizer's windows are dealt by their own content.
HOT = 2000
#: Blocks whose very frequent windows are settled together, and bytes of text for a bucket.
GROUP, BUCKET_BYTES = 4096, 8 << 20
#: Bits of a place in a block; the minimizer is the least by the other bits of its hash, then the first.
PLACE = U64(32)
LAST = 2**63 - 1  # the id that null stands for


def pack(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def unpack(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def minimizers(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K, skip: np.ndarray | None = None):
    """(hash, occurrences, first window, last window) of each run of windows with one minimizer, and the rolling hashes.

    Windows never cross texts; those of texts in ``skip`` are left out. A run may hold several occurrences of its minimizer, as in a periodic text; so a long
    stretch of one period is one run.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    long = size >= length if skip is None else (size >= length) & ~skip
    if not long.any():
        return np.zeros(0, U64), none, none, none, Rolling(data[:0])
    roll = Rolling(data)
    h = roll.windows(k)
    v = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=U64)
    width, span = 1, length - k + 1
    while 2 * width <= span:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[:-1][long] + size[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(v)] > 0)
    if not len(start):
        return np.zeros(0, U64), none, none, none, roll
    at = (v[start] & ((U64(1) << PLACE) - U64(1))).astype(np.int64)
    key = h[at]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)))
    moved = np.concatenate(([0], (at[1:] != at[:-1]) & ~new[1:])).astype(np.int64)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return key[first], 1 + np.add.reduceat(moved, first), start[first], start[last], roll


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, joined."""
    total = np.cumsum(size)
    if not len(total):
        return data[:0]
    return data[np.repeat(start - (total - size), size) + np.arange(total[-1])]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at ``a`` and ``b`` are equal."""
    out, i = np.ones(len(a), bool), 0
    total = np.cumsum(size)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        differ = gather(data, a[i:j], size[i:j]) != gather(data, b[i:j], size[i:j])
        begin = np.cumsum(size[i:j]) - size[i:j]
        out[i:j] = ~np.logical_or.reduceat(differ, begin)
        i = j
    return out


def runs(windows: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges (begin, end) that sorted window starts cover, as rows of int32."""
    if not len(windows):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(windows) > length)
    begin = windows[np.concatenate(([0], cut + 1))]
    end = windows[np.concatenate((cut, [len(windows) - 1]))] + length
    return np.stack([begin, end], 1).astype(np.int32)


def smaller_before(x: np.ndarray) -> np.ndarray:
    """Of each value the place of the nearest smaller one before it, or -1, by jumping over those that are not."""
    n = len(x)
    out = np.arange(-1, n - 1)
    todo = np.arange(n)
    while len(todo):
        to = out[todo]
        todo = todo[(to >= 0) & (x[np.maximum(to, 0)] >= x[todo])]
        out[todo] = out[out[todo]]
    return out


class Suffixes:
    """Ranks of the suffixes of some bytes by their first 8, 16, 32, 64 bytes, for comparing them to depth LENGTH."""

    def __init__(self, data: np.ndarray, length: int):
        self.length, x, width = length, np.concatenate((data, np.zeros(128, np.uint8))).astype(U64), 1
        while width < 8:
            x = (x[: len(x) - width] << U64(8 * width)) | x[width:]
            width *= 2
        self.words, self.ranks = x, {}
        rank = np.unique(x, return_inverse=True)[1].astype(np.uint32)
        while True:
            self.ranks[width] = rank
            if 2 * width > length:
                break
            m = len(rank) - width
            rank = np.unique((rank[:m].astype(U64) << U64(32)) | rank[width:], return_inverse=True)[1].astype(np.uint32)
            width *= 2
        self.width = width

    def depth(self, at: np.ndarray) -> np.ndarray:
        """The rank of each suffix by its first LENGTH bytes."""
        r = self.ranks[self.width]
        return (r[at].astype(U64) << U64(32)) | r[at + self.length - self.width]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes have in common, LENGTH at most."""
        n = np.zeros(len(a), np.int64)
        for w in sorted(self.ranks, reverse=True):
            while True:  # a width may fit several times
                fits = np.flatnonzero(n + w <= self.length)
                fits = fits[self.ranks[w][a[fits] + n[fits]] == self.ranks[w][b[fits] + n[fits]]]
                n[fits] += w
                if not len(fits) or 2 * w <= self.length:
                    break
        differ = self.words[a + n] ^ self.words[b + n]
        for k in range(8):  # leading bytes of the word that are equal
            n += (differ >> U64(56 - 8 * k)) == 0
        return np.minimum(n, self.length)


def previous_factors(suffixes: Suffixes, at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The longest previous factor, LENGTH at most, of each suffix ``at``, whose position is (document, start).

    In suffix order the earlier suffix with the longest common prefix is the nearest one before or after that has a
    smaller position. Suffixes at one position are no matches of each other.
    """
    by_place = np.lexsort((start, doc))
    d, s = doc[by_place], start[by_place]
    place = np.empty(len(at), np.int64)
    place[by_place] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (s[1:] != s[:-1]))).astype(np.int64)) if len(at) else 0
    order = np.lexsort((place, suffixes.depth(at)))
    a, x = at[order], place[order]
    lpf = np.zeros(len(at), np.int64)
    before, after = smaller_before(x), len(x) - 1 - smaller_before(x[::-1])[::-1]
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < len(x)))
        lpf[has] = np.maximum(lpf[has], suffixes.common(a[has], a[near[has]]))
    out = np.empty(len(at), np.int64)
    out[order] = lpf
    return out


class Contexts:
    """Windows around minimizers: key, hash of the bytes, document, start in it, windows, block's place, occurrences.

    The bytes of each are at ``begin`` of ``data``, one after the other unless places are given.
    """

    HEAD = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<u4"), ("at", "<i4"), ("w", "<u4")])

    def __init__(self, head: np.ndarray, data: np.ndarray, length: int, begin: np.ndarray | None = None):
        self.head, self.data, self.length = head, data, length
        self.size = head["n"].astype(np.int64) + length - 1
        self.begin = np.cumsum(self.size) - self.size if begin is None else begin

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by (key, hash, size, document, start), the row that each equals first, and which of them are later than it."""
        h = self.head
        order = np.lexsort((h["start"], h["doc"], h["n"], h["hash"], h["key"]))
        k, p = order[1:], order[:-1]
        alike = (h["key"][k] == h["key"][p]) & (h["hash"][k] == h["hash"][p]) & (h["n"][k] == h["n"][p])
        at = np.flatnonzero(alike)
        ok = same_bytes(self.data, self.begin[k[at]], self.begin[p[at]], self.size[k[at]])
        same = np.zeros(len(order), bool)  # equal to the row before in this order
        same[at[ok] + 1] = True
        first = np.flatnonzero(~same)
        lead = order[first[np.cumsum(~same) - 1]] if len(order) else order
        later = same & ((h["doc"][order] != h["doc"][lead]) | (h["start"][order] != h["start"][lead]))
        return order, lead, later

    def earlier(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of each window of ``rows`` whose longest previous factor among these is LENGTH."""
        size = self.size[rows]
        n = self.head["n"][rows].astype(np.int64)
        begin = np.cumsum(size) - size
        which = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        suffixes = Suffixes(gather(self.data, self.begin[rows], size), self.length)
        lpf = previous_factors(suffixes, begin[which] + inside, self.head["doc"][rows][which], self.head["start"][rows].astype(np.int64)[which] + inside)
        late = np.flatnonzero(lpf >= self.length)
        return rows[which[late]], inside[late]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., n values for each row."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _texts(data: np.ndarray, off: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, list[dict]]:
    """Begin and end of texts of which the block has an equal one of a smaller id, and digest and place of the others.

    Shorter texts than ``length`` lose nothing and are in neither.
    """
    long = np.flatnonzero(np.diff(off) >= length)
    digests = [hashlib.sha256(data[off[i] : off[i + 1]]).digest() for i in long]
    least: dict[bytes, int] = {}
    for i, d in zip(ids[long].tolist(), digests, strict=True):
        least[d] = min(least.get(d, i), i)
    copied, firsts = [], []
    for i, d in zip(long.tolist(), digests, strict=True):
        begin, end, own = int(off[i]), int(off[i + 1]), int(ids[i])
        if own > least[d]:
            copied.append((begin, end))
        else:
            firsts.append({"digest": d, "id": own, "span": (begin << 32) | end})
    return np.array(copied, np.int32).reshape(-1, 2), firsts


_BLOCK = "block long, ids binary, nulls binary, off binary, data binary, copied binary, size long, firsts array<struct<digest: binary, id: long, span: long>>"
_FIRSTS = pa.list_(pa.struct([("digest", pa.binary()), ("id", pa.int64()), ("span", pa.int64())]))


def _blocks(block: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", block):
            data, off = utf8_view(b.column(1))
            ids = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype("<i8")
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
            copied, firsts = _texts(data, off, ids, length)
            held = (ids.tobytes(), nulls.tobytes(), off.astype("<i8").tobytes(), pack(data.tobytes()), copied.tobytes())
            columns = [pa.array([(part << 32) | n], pa.int64()), *(pa.array([x], pa.binary()) for x in held), pa.array([len(data)], pa.int64()), pa.array([firsts], _FIRSTS)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "nulls", "off", "data", "copied", "size", "firsts"])
            n += 1

    return run


def _load(b: pa.RecordBatch, i: int):
    """Ids, offsets and bytes of a block, and begin and end of its texts that are copies of earlier ones."""
    f = lambda name, kind: np.frombuffer(b.column(b.schema.get_field_index(name))[i].as_buffer(), kind)
    far = np.array(b.column(b.schema.get_field_index("copies"))[i].as_py() or [], np.int64)
    copies = np.concatenate((f("copied", "<i4").reshape(-1, 2), np.stack([far >> 32, far & (2**32 - 1)], 1).astype(np.int32)))
    return f("ids", "<i8"), f("off", "<i8"), np.frombuffer(unpack(f("data", np.uint8)), np.uint8), copies


def _steps(data: np.ndarray, off: np.ndarray, copies: np.ndarray, length: int, k: int, step: int):
    """Where each part of a block begins, and the minimizers of its texts that are no copies."""
    skip = np.zeros(len(off) - 1, bool)
    skip[np.searchsorted(off, copies[:, 0], side="right") - 1] = True
    for i, j in row_blocks(off, step):
        yield off[i], minimizers(data[off[i] : off[j]], off[i : j + 1] - off[i], length, k, skip[i:j])


def _places(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each minimizer, and 32 bits of its hash below."""
    return ((mix(h) % U64(buckets)) << U64(32)) | (h & U64(2**32 - 1))


def _deal(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Rows of each bucket that has any."""
    bucket = (mix(hashes) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cut) if len(p)]


def _send(buckets: int, length: int, k: int, step: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, off, data, copies = _load(b, i)
                found = [m[:2] for _, m in _steps(data, off, copies, length, k, step)]
                h, which = np.unique(_places(np.concatenate([np.zeros(0, U64), *(x for x, _ in found)]), buckets), return_inverse=True)
                n = np.minimum(np.bincount(which, np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)]), len(h)), 2**31).astype("<u4")
                bucket, low = (h >> U64(32)).astype(np.int32), h.astype("<u4")
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                held = [low[p:q].tobytes() + n[p:q].tobytes() for p, q in zip(first, np.append(first, len(h))[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([b.column(0)[i].as_py()] * len(first), pa.int64()), pa.array(held, pa.binary())], ["bucket", "block", "held"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The other columns' values of all rows of one key, the first ``width`` columns, after another; rows come sorted by it."""
    now, held = None, []
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[:width] != now:
                if held:
                    yield now, held
                now, held = x[:width], []
            held.append(x[width:])
    if held:
        yield now, held


def _answer(hot: int):
    """Which minimizers occur more than once, for each block: bucket, hashes, and whether they are very frequent."""

    def run(batches):
        for (bucket,), rows in _by_key(batches, 1):
            count = [len(held) // 8 for _, held in rows]
            h = np.concatenate([np.frombuffer(x, "<u4", m) for (_, x), m in zip(rows, count, strict=True)])
            n = np.concatenate([np.frombuffer(x, "<u4", m, 4 * m) for (_, x), m in zip(rows, count, strict=True)]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            head = np.concatenate(([True], np.diff(h[order]) != 0))
            total = np.zeros(len(h), np.int64)
            total[order] = np.add.reduceat(n[order], np.flatnonzero(head))[np.cumsum(head) - 1]
            cut = np.cumsum(count)
            out = []
            for (block, _), i, j in zip(rows, cut - count, cut, strict=True):
                keep = total[i:j] > 1
                if keep.any():
                    out.append((block, np.array([bucket], "<u4").tobytes() + h[i:j][keep].tobytes() + (total[i:j][keep] >= hot).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["block", "held"])

    return run


def _packed(head: np.ndarray, data: np.ndarray) -> bytes:
    return pack(b"".join(head[name].tobytes() for name in head.dtype.names) + data.tobytes() + np.int64(len(head)).tobytes())


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unpack(packed)
    head, at = np.empty(int(np.frombuffer(x, "<i8", 1, len(x) - 8)[0]), Contexts.HEAD), 0
    for name in head.dtype.names:
        head[name] = np.frombuffer(x, head.dtype[name], len(head), at)
        at += head[name].nbytes
    return head, np.frombuffer(x, np.uint8, len(x) - 8 - at, at)


_SENT = ["bucket", "salt", "block", "contexts", "spans"]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _SENT)


def _contexts(buckets: int, salts: int, length: int, k: int, step: int):
    def run(batches):
        for b in batches:
            answers = b.column(b.schema.get_field_index("held"))
            for i in range(b.num_rows):
                held = answers[i].as_py()
                if not held:
                    continue
                ids, off, data, copies = _load(b, i)
                block = b.column(0)[i].as_py()
                size = [(len(x) - 4) // 5 for x in held]
                known = np.concatenate([(np.frombuffer(x, "<u4", 1).astype(U64) << U64(32)) | np.frombuffer(x, "<u4", m, 4) for x, m in zip(held, size, strict=True)])
                warm = np.concatenate([np.frombuffer(x, bool, m, 4 + 4 * m) for x, m in zip(held, size, strict=True)])
                order = np.argsort(known)
                known, warm = known[order], warm[order]
                parts = []
                for base, (h, w, lo, hi, roll) in _steps(data, off, copies, length, k, step):
                    place = _places(h, buckets)
                    slot = np.minimum(np.searchsorted(known, place), len(known) - 1)
                    keep = known[slot] == place
                    h, w, lo, hi, hot = h[keep], w[keep], lo[keep], hi[keep], warm[slot[keep]]
                    # very frequent ones: each window by itself, under its own hash; of equal ones of a text the first
                    single, cold = spread(lo[hot], hi[hot] - lo[hot] + 1), ~hot
                    parts.append((h[cold], w[cold], base + lo[cold], base + hi[cold], roll.of(lo[cold], hi[cold] + length), base + single, roll.of(single, single + length)))
                h, w, lo, hi, alike, single, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
                text = np.searchsorted(off, single, side="right") - 1
                order = np.lexsort((single, whole, text))
                x, y = order[1:], order[:-1]
                at = np.flatnonzero((text[x] == text[y]) & (whole[x] == whole[y]))
                at = x[at[same_bytes(data, single[x[at]], single[y[at]], np.full(len(at), length))]]
                gone = [single[at]]
                left = np.ones(len(single), bool)
                left[at] = False
                single, whole = single[left], whole[left]
                begin, end = np.concatenate((lo, single)), np.concatenate((hi, single))
                doc = np.searchsorted(off, begin, side="right") - 1
                head = np.zeros(len(begin), Contexts.HEAD)
                head["key"], head["hash"] = np.concatenate((h, whole)), np.concatenate((alike, whole))
                head["doc"], head["start"], head["n"], head["at"], head["w"] = ids[doc], begin - off[doc], end - begin + 1, begin, 1
                n_cold = len(h)
                head["w"][:n_cold] = np.minimum(w, 2)
                c = Contexts(head, data, length, begin)
                order, _, later = c.settle()
                dropped = order[later]
                gone.append(spread(begin[dropped], head["n"][dropped].astype(np.int64)))
                spans = runs(np.unique(np.concatenate(gone)), length)
                stay = np.sort(order[~later])
                # rows that have the same place as an equal one (a repeated id) stay, to be settled with the others
                rows = [(int(block % buckets), -1, block, b"", spans.tobytes())] if len(spans) else []
                salt = int(mix(np.array([block], U64))[0] % U64(salts)) if salts > 1 else -1
                for p, s in ((stay[stay < n_cold], -1), (stay[stay >= n_cold], salt)):
                    for bucket, q in _deal(head["key"][p], buckets):
                        q = p[q]
                        rows.append((bucket, s, block, _packed(head[q], gather(data, begin[q], c.size[q])), b""))
                yield _sent(rows)

    return run


def _match(length: int, most: int = 8 << 20):
    """Spans of each block by buckets; of a bucket of very frequent windows (salt 0 and up) also the first of each kind."""

    def run(batches):
        for (bucket, salt), rows in _by_key(batches, 2):
            out = [(bucket, -1, block, b"", spans) for block, _, spans in rows if spans]
            rows = [(block, *_unpacked(x)) for block, x, _ in rows if x]
            if rows:
                blocks, count = [block for block, _, _ in rows], [len(x) for _, x, _ in rows]
                head, data = np.concatenate([x for _, x, _ in rows]), np.concatenate([x for _, _, x in rows])
                del rows
                owner = np.repeat(np.arange(len(blocks)), count)
                c = Contexts(head, data, length)
                order, lead, later = c.settle()
                gone = order[later]
                n = head["n"][gone].astype(np.int64)
                row, win = [np.repeat(gone, n)], [spread(np.zeros(len(n), np.int64), n)]
                # of equal contexts one; of keys those with several occurrences
                rep = order[lead == order]
                key = head["key"][rep]
                group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
                rep = rep[np.bincount(group, head["w"][rep])[group] > 1]
                for part in _cut(head["key"][rep], c.size[rep], most):
                    r, w = c.earlier(rep[part])
                    row.append(r)
                    win.append(w)
                row, win = np.concatenate(row), np.concatenate(win)
                # rows at the place of the one that stood for them (of a repeated id) have its matches
                twin = ~later & (lead != order)
                twin, of = order[twin], lead[twin]
                if len(twin):
                    by = np.argsort(row, kind="stable")
                    a, z = np.searchsorted(row[by], of), np.searchsorted(row[by], of, side="right")
                    row, win = np.concatenate((row, np.repeat(twin, z - a))), np.concatenate((win, win[by][spread(a, z - a)]))
                at, own = head["at"][row] + win, owner[row]
                order = np.lexsort((at, own))
                at, own = at[order], own[order]
                cut = np.searchsorted(own, np.arange(len(blocks) + 1))
                for i, block in enumerate(blocks):
                    if cut[i + 1] > cut[i]:
                        out.append((bucket, -1, block, b"", runs(at[cut[i] : cut[i + 1]], length).tobytes()))
                if salt >= 0:
                    first = np.ones(len(head), bool)
                    first[row] = False
                    for i, block in enumerate(blocks):
                        q = np.flatnonzero(first & (owner == i))
                        if len(q):
                            out.append((bucket, -1, block, _packed(head[q], gather(data, c.begin[q], c.size[q])), b""))
            yield _sent(out)

    return run


def _cut(key: np.ndarray, size: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of sorted keys of about ``most`` bytes; a key is never split."""
    i = 0
    total = np.cumsum(size)
    while i < len(key):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
        j = len(key) if j >= len(key) else max(int(np.searchsorted(key, key[j], side="left")), int(np.searchsorted(key, key[i], side="right")))
        yield slice(i, j)
        i = j


def _remove(keep_text: bool, step: int):
    def run(batches):
        for b in batches:
            spans = b.column(b.schema.get_field_index("spans"))
            nulls = b.column(b.schema.get_field_index("nulls"))
            for i in range(b.num_rows):
                ids, off, data, copies = _load(b, i)
                null = np.frombuffer(nulls[i].as_py(), bool)
                s = np.concatenate([copies, *(np.frombuffer(x, "<i4").reshape(-1, 2) for x in spans[i].as_py() or [])])
                for p, q in row_blocks(off, step):  # a span may go on in the next text
                    own = s[(s[:, 1] > off[p]) & (s[:, 0] < off[q])].clip(off[p], off[q]) - off[p]
                    yield _kept(ids[p:q], null[p:q], off[p : q + 1] - off[p], data[off[p] : off[q]], own, keep_text)

    return run


def _kept(ids: np.ndarray, null: np.ndarray, off: np.ndarray, data: np.ndarray, s: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1], -1)
    gone = np.cumsum(edge)[: len(data)] > 0
    first = gone & np.concatenate(([True], ~gone[:-1])) if len(data) else gone
    first[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
    total, begins = (np.concatenate(([0], np.cumsum(x))) for x in (gone, first))
    kept = data[~gone].tobytes()
    left = off - total[off]
    texts = [kept[p:q] for p, q in zip(left[:-1], left[1:], strict=True)]
    out = [pa.array(ids, mask=null), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(begins[off])), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
    return pa.RecordBatch.from_arrays([*out, *([pa.array(texts, pa.binary())] if keep_text else [])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT, block: int = BLOCK, group: int = GROUP, keep_text: bool = True, step: int = STEP) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep_text``, the kept bytes.

    Ids are integers; null is after all others. Null text is empty. Rows with one id are at one place: a string at the
    same start of such rows is not a copy of itself, so repeated rows have equal results. Texts shorter than ``length``
    stay whole. Very long and periodic texts are treated whole; a stretch of one period is sent once, not per window.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    integer_id(docs, id_col)
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(block, length), _BLOCK), "repeat-blocks")
    n_blocks, n_bytes = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets, salts = max(2 * partitions, n_bytes // BUCKET_BYTES), 1 + n_blocks // group
    # of a digest each block has sent the least id alone, so a group has a row a block, or more if ids are repeated
    firsts = blocks.select("block", F.explode("firsts").alias("f")).select("block", "f.*")
    copies = firsts.withColumn("least", F.min("id").over(Window.partitionBy("digest"))).where("id > least").groupBy("block").agg(F.collect_list("span").alias("copies"))
    # all joins of the blocks are left joins of these columns, so Spark shuffles the blocks once and uses that again
    blocks = blocks.drop("size", "firsts")
    known = blocks.join(copies, "block", "left")
    fields = ("block", "ids", "nulls", "off", "data", "copied", "copies")
    sent = known.select(*fields).mapInArrow(_send(buckets, length, k, step), "bucket int, block long, held binary")
    answers = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(hot), "block long, held binary")
    asked = known.join(answers.groupBy("block").agg(F.collect_list("held").alias("held")), "block", "left")
    kinds = "bucket int, salt int, block long, contexts binary, spans binary"
    met = asked.select(*fields, "held").mapInArrow(_contexts(buckets, salts, length, k, step), kinds)

    def match(x: DataFrame) -> DataFrame:
        return x.repartition(partitions, "bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_match(length), kinds)

    spans = match(met)
    if salts > 1:  # the first of each group of blocks meet
        level = materialize(spans, "repeat-level")
        spans = level.where("length(spans) > 0").unionByName(match(level.where("length(contexts) > 0")))
    spans = spans.select("block", "spans")
    done = known.join(spans.groupBy("block").agg(F.collect_list("spans").alias("spans")), "block", "left")
    out = done.select(*fields, "spans").mapInArrow(_remove(keep_text, step), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("id", id_col)

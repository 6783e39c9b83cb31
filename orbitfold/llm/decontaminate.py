"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

The tokens of the join are shingles of five words (fewer in an item that is shorter). Each window of an item, ten
consecutive words, must be contained whole, so the necessary prefix of its shingles in order of rarity is one shingle:
the rarest, by counts over all documents. A first pass counts the benchmark's shingles in the documents, the second
joins every document's shingles with those prefixes, applies the positional bound (the window starts as many words
before as the shingle stands in it) and the length bound (it fits into the document), and verifies all words of the
window exactly. The index of prefixes is broadcast in parts of bounded size; a larger benchmark takes more passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _LOWER, Rolling, first_in_row, materialize, mix, safe_names, ship, slices, utf8_view, words

#: Words in a window and in a shingle; windows in one broadcast index (under 200 bytes of memory each).
WINDOW, SHINGLE, INDEX_WINDOWS = 10, 5, 400_000
#: Passes in one job, as each holds its index in a worker of its own; then the rows are written and read again.
CHAIN = 4


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they are all of one row."""
    n = len(hashes)
    if n < k:
        return np.zeros(n, U64), np.zeros(n, bool)
    out, ok = np.zeros(n, U64), np.zeros(n, bool)
    h = np.full(n - k + 1, U64(k))
    for j in range(k):
        h = mix(h * U64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    out[: n - k + 1] = h
    ok[: n - k + 1] = rows[k - 1 :] == rows[: n - k + 1]
    return out, ok


def windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (item, size, width, hashes, text) of each distinct window of each item: word hashes, words joined by a space."""
    for b in slices(batches, "text"):
        data, off = utf8_view(b.column(1))
        rows, start, end, h = words(data, off)
        low = _LOWER[data]
        first, ids = first_in_row(rows, b.num_rows), b.column(0)
        out = {"item": [], "width": [], "hashes": [], "text": []}
        for k in range(b.num_rows):
            n = first[k + 1] - first[k]
            size = min(n, window)
            own = set()
            for i in range(first[k], first[k + 1] - size + 1) if n else ():
                text = b" ".join(low[s:e].tobytes() for s, e in zip(start[i : i + size], end[i : i + size], strict=True))
                if text not in own:
                    own.add(text)
                    out["item"].append(ids[k].as_py())
                    out["width"].append(min(size, shingle))
                    out["hashes"].append(h[i : i + size].astype(np.int64).tolist())
                    out["text"].append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["width"], pa.int32()), pa.array(out["hashes"], pa.list_(pa.int64())), pa.array(out["text"], pa.binary())], [*out])


def _prefix_hash(hashes: list[list[int]], width: int) -> list[np.ndarray]:
    flat = np.array([x for h in hashes for x in h], np.int64).astype(U64)
    rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    sh, ok = shingles(rows, flat, width)
    first = first_in_row(rows, len(hashes))
    return [sh[i:j][ok[i:j]] for i, j in zip(first[:-1], first[1:], strict=True)]


class Index:
    """Windows by the hash of their rarest shingle."""

    def __init__(self, items: list[str], width: np.ndarray, hashes: list[list[int]], text: list[bytes], rarity: dict[int, int]):
        self.items, self.text = items, text
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.width = np.unique(width).tolist()
        key, offset = np.zeros(len(items), U64), np.zeros(len(items), np.int64)
        for w in self.width:
            rows = np.flatnonzero(width == w)
            for r, sh in zip(rows, _prefix_hash([hashes[r] for r in rows], w), strict=True):
                best = min(range(len(sh)), key=lambda j, sh=sh: (rarity.get(int(sh[j]), 0), int(sh[j])))
                key[r], offset[r] = sh[best], best
        self.order = np.lexsort((key, width))
        self.key, self.offset, self.by_width = key[self.order], offset[self.order], {w: (np.searchsorted(width[self.order], w), np.searchsorted(width[self.order], w, side="right")) for w in self.width}

    def find(self, data: np.ndarray, off: np.ndarray):
        """(row of the text, first word, window) of every occurrence, with the words (rows, first of each row)."""
        rows, start, end, h = words(data, off)
        first = first_in_row(rows, len(off) - 1)
        low, found = _LOWER[data], []
        for w in self.width:
            a, b = self.by_width[w]
            key = self.key[a:b]
            sh, ok = shingles(rows, h, w)
            left = np.searchsorted(key, sh)
            hit = np.flatnonzero(ok & (key[np.minimum(left, len(key) - 1)] == sh))
            left, right = left[hit], np.searchsorted(key, sh[hit], side="right")
            many = right - left
            at, slot = np.repeat(hit, many), np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            win = self.order[a:b][slot]
            begin = at - self.offset[a:b][slot]
            fits = (begin >= first[rows[at]]) & (begin + self.size[win] <= first[rows[at] + 1])  # position and length
            for i, k, v in zip(begin[fits].tolist(), rows[at[fits]].tolist(), win[fits].tolist(), strict=True):
                n = int(self.size[v])
                if b" ".join([low[s:e].tobytes() for s, e in zip(start[i : i + n], end[i : i + n], strict=True)]) == self.text[v]:
                    found.append((k, i, v))
        return found, rows, first


def _count(keys):
    """A pass that counts the benchmark's shingles in the documents."""

    def run(batches):
        per = {w: np.array(sorted(k), U64) for w, k in keys.value.items()}
        total = {w: np.zeros(len(k), np.int64) for w, k in per.items()}
        for b in slices(batches, "text"):
            rows, _, _, h = words(*utf8_view(b.column(0)))
            for w, k in per.items():
                sh, ok = shingles(rows, h, w)
                sh = sh[ok]
                at = np.minimum(np.searchsorted(k, sh), len(k) - 1)
                total[w] += np.bincount(at[k[at] == sh], minlength=len(k))
        for w, k in per.items():
            seen = total[w] > 0
            yield pa.RecordBatch.from_arrays([pa.array(k[seen].astype(np.int64)), pa.array(total[w][seen])], ["shingle", "n"])

    return run


def _probe(index, last):
    """A pass that adds its hits to those of each row; the last leaves the texts out."""

    def run(batches):
        ix = index.value
        for b in slices(batches, "text"):
            data, off = utf8_view(b.column(1))
            found, _, first = ix.find(data, off)
            spans, items = [set(map(tuple, x)) for x in b.column(3).to_pylist()], [set(x) for x in b.column(4).to_pylist()]
            for k, i, v in found:
                spans[k].add((i - int(first[k]), int(ix.size[v])))
                items[k].add(ix.items[v])
            pair = pa.list_(pa.list_(pa.int32()))
            text = {} if last else {"text": b.column(1)}
            yield pa.RecordBatch.from_arrays([b.column(0), *text.values(), pa.array(np.diff(first).astype(np.int64)), pa.array([sorted(x) for x in spans], pair), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["id", *text, "n_words", "spans", "items"])

    return run


def indexes(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, shingle: int, index_windows: int) -> Iterator:
    """Broadcast indexes of at most ``index_windows`` windows each; shingles are ordered by their counts in ``rows``."""
    sc = rows.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(lambda x: windows(x, window, shingle), "item string, width int, hashes array<long>, text binary")
    for held in _parts(items, index_windows):
        keys: dict[int, set[int]] = {}
        for w in {r["width"] for r in held}:
            keys[w] = {int(x) for sh in _prefix_hash([r["hashes"] for r in held if r["width"] == w], w) for x in sh}
        counted = rows.select("text").mapInArrow(_count(sc.broadcast(keys)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        rarity = {r["shingle"] & (2**64 - 1): r["n"] for r in counted.collect()}  # at most the shingles of this part of the benchmark
        yield sc.broadcast(Index([r["item"] for r in held], np.array([r["width"] for r in held]), [r["hashes"] for r in held], [bytes(r["text"]) for r in held], rarity))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """The documents without any window of the benchmark, all columns as they were; nothing is shuffled.

    Null, empty and wordless texts stay, and repeated rows and rows with a null id are rows like any others. An empty
    benchmark leaves all, an empty table gives an empty result; very long texts are searched whole.
    """
    ship(docs.sparkSession)
    rows, out, text = docs.select(F.col(text_col).alias("text")), safe_names(docs), f"c{docs.columns.index(text_col)}"
    for k, index in enumerate(indexes(rows, benchmark, item_id, item_text, window, shingle, index_windows)):

        def run(batches, index=index):
            for b in slices(batches, text):
                found = index.value.find(*utf8_view(b.column(b.schema.get_field_index(text))))[0]
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, _, _ in found]] = False
                yield b.filter(pa.array(keep))

        if k and k % CHAIN == 0:
            out = materialize(out, "clean")
        out = out.mapInArrow(run, out.schema)
    return out.toDF(*docs.columns)


def _finish(batches):
    for b in batches:
        n_hit, n_items, sha = [], [], []
        for spans, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            end = total = 0
            for i, n in sorted(map(tuple, spans or [])):
                total += max(0, i + n - max(i, end))
                end = max(end, i + n)
            own = sorted(set(items or []))
            n_hit.append(total)
            n_items.append(len(own))
            sha.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), b.column(2), b.column(3)], ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word, words), items.

    Words, windows and hits as in the module's text. Null and empty texts have no words, items without words no window;
    an item of fewer words than a window is one window; equal items each count; a null item id is named ``null``.
    Repeated rows and rows with a null id each give a row, whatever the number of passes. With an empty benchmark nothing
    is hit. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    passes = [*indexes(rows, benchmark, item_id, item_text, window, shingle, index_windows)]
    if not passes:
        passes.append(spark.sparkContext.broadcast(Index([], np.zeros(0, np.int64), [], [], {})))
    out = rows.selectExpr("id", "text", "0L AS n_words", "CAST(array() AS array<array<int>>) AS spans", "CAST(array() AS array<string>) AS items")
    for k, index in enumerate(passes):
        if k and k % CHAIN == 0:
            out = materialize(out, "contamination")
        last = k == len(passes) - 1
        out = out.mapInArrow(_probe(index, last), f"id {kind}, {'' if last else 'text string, '}n_words long, spans array<array<int>>, items array<string>")
    done = out.mapInArrow(_finish, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>, items array<string>")
    return done.withColumnRenamed("id", id_col)


def _parts(items: DataFrame, most: int) -> Iterator[list]:
    """The windows in lists of at most ``most``, each fetched when it is needed."""
    held: list = []
    for r in items.toLocalIterator():
        held.append(r)
        if len(held) >= most:
            yield held
            held = []
    if held:
        yield held

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a block lie in flat numpy symbol arrays. Each round looks up the rank of every adjacent pair,
takes the least rank in each word (a segmented minimum), merges all its leftmost non-overlapping occurrences at once
and compacts; words without a pair leave. That equals the library's one-merge-at-a-time queue as long as a merge never
makes a pair that ranks before the merge itself. The pieces of the vocabulary for which it can are found when the
model is loaded; of those a round merges only the leftmost in each word, and long words that have several are done by
an exact queue.
Words start at each run of the space symbol: no piece has that symbol after another, so no merge crosses.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ship, slices

SPACE = "▁"
NONE = np.int32(2**31 - 1)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct words that a worker remembers before it starts anew; bounds its memory.
MOST_WORDS = 400_000
#: Bytes of text encoded at once: distinct words repeat more in larger blocks.
ENCODE_BYTES = 2 << 20
#: Symbols from which a word with several risky merges goes to the queue, whose cost grows with its length alone.
LONG = 64


class PairTable:
    """(left, right) -> value for arrays, a hash table of numpy arrays with short probes."""

    def __init__(self, left, right, *values):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(key) * 8).bit_length())
        self.keys = np.full((1 << self.bits) + 64, 2**64 - 1, np.uint64)
        self.values = [np.full(len(self.keys), NONE, np.int32) for _ in values]
        self.probes, rest = 0, np.arange(len(key))
        while len(rest):
            slot = self._slot(key[rest]) + self.probes
            if self.probes == 63:
                raise ValueError("too many collisions")
            slot, first = np.unique(slot, return_index=True)
            free = self.keys[slot] == np.uint64(2**64 - 1)
            put, at = rest[first[free]], slot[free]
            self.keys[at] = key[put]
            for v, given in zip(self.values, values, strict=True):
                v[at] = given[put]
            rest = np.setdiff1d(rest, put, assume_unique=True)
            self.probes += 1

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """The slot of each pair, or the last slot, whose values are NONE."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        out[hit] = slot[hit]
        rest = np.flatnonzero(~hit & (self.keys[slot] != np.uint64(2**64 - 1)))
        for p in range(1, self.probes):
            if not len(rest):
                break
            at = slot[rest] + p
            ok = self.keys[at] == key[rest]
            out[rest[ok]] = at[ok]
            rest = rest[~ok & (self.keys[at] != np.uint64(2**64 - 1))]
        return out


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces and m.trainer_spec.byte_fallback) or m.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation")
        self.size, self.bos, self.eos, self.unk = len(m.pieces), m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.unk_id
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 5)}
        score = {p.piece: p.score for p in m.pieces if p.type in (1, 5)}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space symbol after another")
        self.byte_id = np.full(256, self.unk, np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        symbols = dict(normal)
        for p in list(normal):
            for c in p:
                symbols.setdefault(c, len(symbols) + self.size)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = [(symbols[p[:k]], symbols[p[k:]], i, rank_of[score[p]]) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        left, right, made, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.pairs = PairTable(left, right, made.astype(np.int32), rank.astype(np.int32))
        self.merge = {(a, b): (r, i) for a, b, i, r in rows}
        # ranks whose piece is part of a piece that ranks no later
        self.unsafe = np.zeros(len(rank_of) + 1, bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and part in score and p[:k] in symbols and p[k:] in symbols and rank_of[score[p]] <= rank_of[score[part]]:
                        self.unsafe[rank_of[score[part]]] = True
        # for decoding: the bytes of each id
        text = [b"" if p.type == 3 else m.trainer_spec.unk_surface.encode() if p.type == 2 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.text = text
        self.length = np.array([len(t) for t in text], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.control = np.array([p.type == 3 for p in m.pieces])
        self.spaced = np.array([p.type in (1, 5) and p.piece.startswith(SPACE) for p in m.pieces])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.size < 1 << 16 else np.int32), 0
        self.at = np.zeros(1 << 12, np.int64)

    # ------------------------------------------------------------ encoding

    def _queue(self, sym: list[int]) -> list[int]:
        """Merges of one word, one at a time: best score first, leftmost among equals."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap, live = [], [True] * n

        def push(i):
            j = after[i]
            if j >= 0 and (x := self.merge.get((sym[i], sym[j]))):
                heapq.heappush(heap, (x[0], i, j, sym[i], sym[j], x[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if not live[i] or not live[j] or after[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [i for i in range(n) if live[i]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words together, and len(words) + 1 offsets into them."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym, word, pos = self.char[code], np.repeat(np.arange(len(words), dtype=np.int32), size), np.arange(len(code))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # symbols and their character positions
        def look(at):
            """Ranks and products of the pairs that start at ``at``."""
            l, r = sym[at], sym[at + 1]
            slot = self.pairs.find(l, r)
            ok = (l >= 0) & (r >= 0) & (word[at] == word[at + 1])
            rank[at], made[at] = np.where(ok, self.pairs.values[1][slot], NONE), self.pairs.values[0][slot]

        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        look(np.arange(len(sym) - 1))
        while len(sym):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, begin)
            over = least == NONE
            spread = np.diff(np.append(begin, len(sym)))
            if over.any():  # compaction: words without a pair leave
                gone = np.repeat(over, spread)
                done.append((sym[gone], pos[gone]))
                stays = ~gone
                sym, word, pos, rank, made = sym[stays], word[stays], pos[stays], rank[stays], made[stays]
                least, spread = least[~over], spread[~over]
                begin = np.cumsum(spread) - spread
                if not len(sym):
                    break
            stays = np.ones(len(sym), bool)
            chosen = rank == np.repeat(least, spread)
            risky = self.unsafe[least]
            if risky.any():  # the leftmost alone, in a word that has several
                several = risky & (np.add.reduceat(chosen, begin, dtype=np.int64) > 1)
                if several.any():
                    at = np.flatnonzero(chosen & np.repeat(several, spread))
                    chosen[at[1:][word[at[1:]] == word[at[:-1]]]] = False
                    for k in np.flatnonzero(several & (spread > LONG)):
                        i, j = begin[k], begin[k] + spread[k]
                        own = sym[i:j].tolist()
                        keep = self._queue(own)
                        done.append((np.array([own[x] for x in keep], np.int32), pos[i:j][keep]))
                        stays[i:j] = chosen[i:j] = False
            # of overlapping occurrences every second one, from the left
            at = np.flatnonzero(chosen)
            head = np.concatenate(([True], np.diff(at) != 1))
            if not head.all():
                run = at[head][np.cumsum(head) - 1]
                at = at[(at - run) % 2 == 0]
            sym[at] = made[at]
            stays[at + 1] = False
            rank[at] = NONE
            new = np.cumsum(stays)[at] - 1
            sym, word, pos, rank, made = sym[stays], word[stays], pos[stays], rank[stays], made[stays]
            if len(sym):
                look(new[new < len(sym) - 1])
                new = new[new > 0]
                look(new - 1)
        sym = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)
        pos = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(pos, kind="stable")
        sym, pos = sym[order], pos[order]
        bounds = np.concatenate(([0], np.cumsum(size)))
        first = np.searchsorted(pos, bounds)
        # characters outside the vocabulary become bytes
        out = (sym < 0) | (sym >= self.size)
        if out.any():
            cp = code[pos[out]]
            raw = np.frombuffer("".join(map(chr, cp.tolist())).encode(), np.uint8)
            count = np.ones(len(sym), np.int64)
            count[out] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
            ids = np.repeat(sym, count)
            ids[np.repeat(out, count)] = self.byte_id[raw]
            first = np.concatenate(([0], np.cumsum(count)))[first]
        else:
            ids = sym
        return ids, first

    def _learn(self, words: list[str]) -> None:
        ids, first = self.encode_words([SPACE + w for w in words])
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(words) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(words) + 1] = first + self.used
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _index(self, words: list[str]) -> np.ndarray:
        get = self.known.get
        found = [*map(get, words)]
        if None in found:
            self._learn([*{w for w, i in zip(words, found, strict=True) if i is None}])
            found = [*map(get, words)]
        return np.array(found, np.int64)

    def encode(self, texts: list[str], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and len(texts) + 1 offsets; with begin and end ids if ``ends``."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        column = pa.array(texts, pa.large_string())
        odd = [k for k, t in enumerate(texts) if "  " in t or SPACE in t or t[:1] == " "]
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            column = pc.if_else(pa.array(mask), "", column)
        parts = pc.split_pattern(column, " ")
        coded = parts.flatten().dictionary_encode()
        index = self._index(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        count = np.concatenate(([0], np.cumsum(np.where([bool(t) for t in texts], np.diff(parts.offsets.to_numpy()), 0))))
        if len(index) != count[-1] or odd:  # empty texts have no word; texts with runs of spaces are split by pattern
            at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            own = {k: [w[1:] for w in _WORD.findall(SPACE + texts[k].replace(" ", SPACE))] for k in odd}
            ids = self._index([w for ws in own.values() for w in ws])
            split, n = {}, 0
            for k, ws in own.items():
                split[k] = ids[n : n + len(ws)]
                n += len(ws)
            every = [split[k] if k in split else index[at[k] : at[k + 1]] if t else index[:0] for k, t in enumerate(texts)]
            count = np.concatenate(([0], np.cumsum([len(x) for x in every])))
            index = np.concatenate(every)
        begin, size = self.at[index], self.at[index + 1] - self.at[index]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])].astype(np.int32)
        off = total[count]
        if ends:
            n = np.arange(len(texts) + 1) * 2
            out = np.empty(len(ids) + 2 * len(texts), np.int32)
            out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(texts)) + 1, np.diff(off))] = ids
            off = off + n
            out[off[:-1]], out[off[1:] - 1] = self.bos, self.eos
            ids = out
        return ids, off

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces and bytes joined, the first piece without its space symbol."""
        size = self.length[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = self.bytes[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        real = np.flatnonzero(~self.control[ids])
        first = np.searchsorted(real, off[:-1])
        out = []
        for k in range(len(off) - 1):
            b = raw[total[off[k]] : total[off[k + 1]]]
            if first[k] < len(real) and (i := real[first[k]]) < off[k + 1] and self.spaced[ids[i]]:
                b = b[1:]
            out.append(b)
        return out


def valid_utf8(b: bytes) -> bytes:
    """Each byte that is not part of a character becomes U+FFFD, as the library decodes byte pieces."""
    try:
        b.decode()
        return b
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(b):
            try:
                out.append(b[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [b[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out).encode()


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _pass(cols: list[str], text_col: str, path: str | None, want: str, ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or default_path())
        for b in slices(batches, text_col, ENCODE_BYTES):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            ids, off = m.encode(texts, ends)
            out = [b.column(b.schema.get_field_index(c)) for c in cols]
            names = [*cols]
            if want != "digests":
                out.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            if want != "ids":
                little = ids.astype("<u4").tobytes()
                out += [
                    pa.array(np.diff(off)),
                    pa.array([hashlib.sha256(little[4 * i : 4 * j]).hexdigest() for i, j in zip(off[:-1], off[1:], strict=True)]),
                    pa.array([hashlib.sha256(valid_utf8(x)).hexdigest() for x in m.decode(ids, off)]),
                ]
                names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _schema(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*cols).schema)


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, ends: bool = True) -> DataFrame:
    """Rows (id, ids): the ids of every whole text. Null and empty texts have the begin and end ids alone."""
    ship(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(_pass([id_col], text_col, path, "ids", ends), _schema(df, [id_col]) + "ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Rows (id, text) from rows of ids; null ids give an empty text."""
    ship(df.sparkSession)

    def run(batches):
        m = model(path or default_path())
        for b in batches:
            lists = b.column(1).to_pylist()
            off = np.concatenate(([0], np.cumsum([len(x or []) for x in lists])))
            ids = np.array([i for x in lists for i in (x or [])], np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= m.size):
                raise ValueError("an id outside the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([valid_utf8(t).decode() for t in m.decode(ids, off)])], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, _schema(df, [id_col]) + "text string")


def round_trip(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (and the ids): encoded with begin and end ids, then decoded.

    Null text counts as empty; repeated rows each give a row; other columns are ignored; an empty table gives an empty
    result; very long texts are encoded whole.
    """
    ship(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(_pass([id_col], text_col, path, "both" if keep_ids else "digests", True), _schema(df, [id_col]) + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Exact token counts at every prefix of a text, for byte-level BPE, by prefix dynamic programming.

For each prefix of a pre-token there is one last token that can follow the last token of the shorter prefix (a pair of
neighbours is possible if encoding their joined bytes gives just these two), so count[i] = count[i - length] + 1. The
table of a text has the count of every prefix, and answers truncation and budget questions without encoding again. Two
rules of the splitting pattern depend on what follows, and are applied to prefixes: white space at the end of a text is
one pre-token, and an unfinished contraction is an apostrophe and a letter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship, slices

#: Entries that a worker remembers (pre-tokens, pairs) before it starts anew; bounds its memory.
MOST_WORDS, MOST_PAIRS = 600_000, 600_000
#: Bytes of text counted at once: distinct words repeat more in larger blocks.
COUNT_BYTES = 6 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind: itself if printable, else from U+0100 on."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


class PrefixCounter:
    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["dropout"]:
            raise ValueError("only byte-level BPE with the standard splitting pattern")
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])}
        self.id = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.id.items()}
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((bytes(back[c] for c in a), bytes(back[c] for c in b)), r)
        self.made = {a + b: (r, (a, b)) for (a, b), r in reversed(self.rank.items())}
        if any(r <= self.made[t][0] for p, r in self.rank.items() for t in p if t in self.made):
            raise ValueError("a merge comes before one that makes its part")
        self.right: dict[bytes, list] = {}
        self.left: dict[bytes, list] = {}
        self.longest = max(map(len, self.id))
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # every token that ends at a position, longest first, comes from an automaton over bytes (as characters)
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            self.kind[[ord(c) for c in regex.findall(pattern, every)]] = k
        self.total: dict[str, int] = {}
        self.n_pairs, self.pairs = 0, [{} for _ in range(max(self.bytes) + 1)]

    def _spine(self, t: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens at one end of ``t`` while it is being made, each with the rank of the merge that takes it in."""
        out, taken = [], 1 << 30
        while True:
            out.append((t, taken))
            if t not in self.made:
                return out
            taken, parts = self.made[t]
            t = parts[side]

    def _fits(self, i: int, j: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives just these: no merge across the border comes before those inside.

        Of equal ranks the leftmost goes first, so a merge across the border wins over one further right.
        """
        a, b, rank, ok = self.bytes[i], self.bytes[j], self.rank, True
        right = self.right.get(a) or self.right.setdefault(a, self._spine(a, 1))
        left = self.left.get(b) or self.left.setdefault(b, self._spine(b, 0))
        for x, before in right:
            for y, by in left:
                r = rank.get((x, y))
                if r is not None and r < before and r <= by:
                    ok = False
        if self.n_pairs > MOST_PAIRS:
            self.n_pairs, self.pairs = 0, [{} for _ in self.pairs]
        self.n_pairs += 1
        self.pairs[i][j] = ok
        return ok

    def prefixes(self, b: bytes) -> list[int]:
        """Token counts of b[:0], b[:1], .. b as one pre-token."""
        count, last, done, pairs = [0], [-1], 0, self.pairs
        for end, (t, size) in self.automaton.iter(b.decode("latin-1")):
            if end >= done:
                j = end + 1 - size
                if j:
                    ok = pairs[last[j]].get(t)
                    if ok is None:
                        ok = self._fits(last[j], t)
                        pairs = self.pairs
                    if not ok:
                        continue
                count.append(count[j] + 1)
                last.append(t)
                done = end + 1
        if done < len(b):
            raise ValueError("no token ends here")
        return count

    def n_tokens(self, word: str) -> int:
        n = self.total.get(word)
        if n is None:
            if len(self.total) > MOST_WORDS:
                self.total.clear()
            n = self.total[word] = self.prefixes(word.encode())[-1]
        return n

    def starts(self, cp: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of joined texts start; ``doc`` holds the starts of the texts. The splitting pattern, vectorised."""
        n = len(cp)
        kind = self.kind[cp]
        first = np.zeros(n + 1, bool)
        first[doc] = first[n] = True
        begin = first[:n] | np.concatenate(([True], kind[1:] != kind[:-1]))
        start = begin.copy()
        # the last white space before a text's next word stands alone, or goes with that word if it is a space
        next_begins = np.append(begin[1:], True)
        last = np.flatnonzero((kind == SPACE) & next_begins & ~first[1:])
        start[last] = True
        start[last[cp[last] == 32] + 1] = False
        # contractions: a lone apostrophe that nothing precedes in its pre-token
        at = np.flatnonzero((cp == 39) & begin & start & next_begins & ~first[1:])
        at = at[kind[at + 1] == LETTER]
        if len(at):
            c, second = cp[at + 1], np.minimum(at + 2, n - 1)
            one = np.isin(c, np.array([ord(x) for x in "stmd"]))
            d = np.where((at + 2 < n) & ~begin[second], cp[second], 0)
            two = ((c == ord("r")) & (d == ord("e"))) | ((c == ord("v")) & (d == ord("e"))) | ((c == ord("l")) & (d == ord("l")))
            for hit, size in ((at[one], 2), (at[two], 3)):
                start[hit + 1] = False
                after = hit + size
                after = after[after < n]
                start[after[~begin[after]]] = True
        return np.flatnonzero(start)

    def count_block(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text; distinct pre-tokens are found by Arrow and counted once."""
        out = np.zeros(len(texts), np.int64)
        special = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        for k in special:
            out[k] = self.count(texts[k])
        rows = np.setdiff1d(np.flatnonzero([bool(t) for t in texts]), special)
        if not len(rows):
            return out
        joined = "".join(texts[k] for k in rows)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        doc = np.concatenate(([0], np.cumsum([len(texts[k]) for k in rows])[:-1]))
        start = self.starts(cp, doc)
        at = np.concatenate(([0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))))[np.append(start, len(cp))]
        words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined.encode())])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        counts = np.array([*map(self.n_tokens, distinct)], np.int64)[coded.indices.to_numpy()]
        out[rows] = np.add.reduceat(counts, np.searchsorted(start, doc))
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Texts between special strings, and these."""
        at = 0
        if self.cut:
            for m in self.cut.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.cut and any(s in text for s in self.special):
            return sum(1 if special else sum(map(self.n_tokens, self.split.findall(part))) for part, special in self.parts(text))
        return sum(map(self.n_tokens, self.split.findall(text)))

    def table(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], .. text, each as if the text ended there (len(text) + 1 values)."""
        parts, out, base = [*self.parts(text)], [0], 0
        for k in range(0, len(parts), 2):
            part, special = parts[k][0], parts[k + 1][0] if k + 1 < len(parts) else None
            out += self._ordinary(part + (special[:-1] if special else ""), base)  # until it is complete it is ordinary text
            if special:
                base += sum(map(self.n_tokens, self.split.findall(part))) + 1
                out.append(base)
        return np.array(out, np.int64)

    def _ordinary(self, text: str, base: int) -> list[int]:
        """Counts, plus ``base``, of text[:1] .. text without special strings."""
        out, run = [], None  # run: the white space pre-token that directly precedes, and the count before it
        for w in self.split.findall(text):
            counts, k = self.prefixes(w.encode()), 0
            for n, c in enumerate(w, 1):
                k += len(c.encode())
                if run and w[:n].isspace():
                    out.append(run[1] + self.n_tokens(run[0] + w[:n]))
                elif n == 2 and w in ("'re", "'ve", "'ll"):
                    out.append(base + self.n_tokens("'") + self.n_tokens(w[1]))
                else:
                    out.append(base + counts[k])
            run = (w, base) if w.isspace() else None
            base += counts[-1]
        return out


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _schema(df: DataFrame, col: str) -> str:
    return f"`{col}` {df.schema[col].dataType.simpleString()}, "


def _texts(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column(1).to_pylist()]


def count_tokens(df: DataFrame, limit: int = 512, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every whole text.

    Null and empty texts have no tokens; special strings inside a text count as one token, as the library has it by
    default. Repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    ship(df.sparkSession)

    def run(batches):
        c = counter(path or default_path())
        for b in slices(batches, df_text, COUNT_BYTES):
            texts = _texts(b)
            n = c.count_block(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    df_text = "__text"
    rows = df.select(id_col, df[text_col].alias(df_text))
    return rows.mapInArrow(run, _schema(df, id_col) + "n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Rows (id, prefix_tokens): the token count of every prefix, by code point, from the empty one to the whole text."""
    ship(df.sparkSession)

    def run(batches):
        c = counter(path or default_path())
        for b in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.table(t).tolist() for t in _texts(b)], pa.list_(pa.int32()))], [id_col, "prefix_tokens"])

    return df.select(id_col, df[text_col].alias("__text")).mapInArrow(run, _schema(df, id_col) + "prefix_tokens array<int>")


def truncate(df: DataFrame, budget: int, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Rows (id, text, n_tokens): the longest prefix of each text that has at most ``budget`` tokens, read off its table."""
    ship(df.sparkSession)

    def run(batches):
        c = counter(path or default_path())
        for b in slices(batches, "__text"):
            kept, n = [], []
            for t in _texts(b):
                table = c.table(t)
                i = int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0
                kept.append(t[:i])
                n.append(int(table[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64())], [id_col, "text", "n_tokens"])

    return df.select(id_col, df[text_col].alias("__text")).mapInArrow(run, _schema(df, id_col) + "text string, n_tokens long")

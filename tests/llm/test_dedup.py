"""Exact dedup, repeat removal and the Jaccard join against brute force, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitfold.llm import exact_dedup, jaccard, repeats

LAST = 2**63 - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def texts(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumn("kept", F.lit(1)).withColumn("id", F.lit(2)).withColumn("block", F.lit(3)).withColumn("a`b.c", F.lit(4)) if extra else df


# ---------------------------------------------------------------- exact

EXACT = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\v\f\r"), (7, "x"), (7, "x"), (None, "y"), (8, "y"), (9, "A b"), (10, "a b"), (11, "z" * 50_000)]


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for m, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        taken = False
        for i, t in own:
            kept = not taken and (i, len(t)) == (best[0], len(best[1]))
            taken |= kept
            out.append((i, best[0], len(own), kept, hashlib.sha256(m.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """With a hash of one bit nearly all groups collide, and are told apart by their bytes."""
    hash_of = (lambda m: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(m), F.lit(2))), 2, "0"))) if weak else exact_dedup.content_hash
    got = exact_dedup.exact_dedup(texts(spark, EXACT, extra=True), hash_of=hash_of).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(EXACT)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_drop_copies(spark, weak):
    hash_of = (lambda m: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(m), F.lit(2))), 2, "0"))) if weak else exact_dedup.content_hash
    left = exact_dedup.drop_copies(texts(spark, EXACT, extra=True), hash_of=hash_of)
    assert left.columns == ["doc_id", "text", "kept", "id", "block", "a`b.c"]
    want = collections.Counter((r[0]) for r in brute_exact(EXACT) if r[3])
    assert collections.Counter(r["doc_id"] for r in left.collect()) == want
    assert exact_dedup.exact_dedup(texts(spark, EXACT).limit(0)).count() == 0


# ---------------------------------------------------------------- repeated strings


def brute_repeats(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[b[p : p + length]] = i
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def brute_factors(texts, places, windows, length):
    """By comparing every window with every other: the longest common prefix with one at a smaller place."""
    out = []
    for i, a in enumerate(windows):
        best = 0
        for j, b in enumerate(windows):
            if places[j] < places[i]:
                n = next((k for k in range(length) if texts[a + k] != texts[b + k]), length)
                best = max(best, n)
        out.append(best)
    return out


def test_previous_factors_equal_brute_force():
    r = random.Random(3)
    for length in (100, 16, 40):
        for alphabet in (b"ab", b"abcdefgh", b"a"):
            t = bytes(r.choice(alphabet) for _ in range(220)) + b"abab" * 40
            at = np.arange(len(t) - length)
            doc = np.array([r.randint(0, 3) for _ in at])
            doc[10:20] = doc[30:40]
            start = np.array([r.randint(0, 30) for _ in at])
            got = repeats.previous_factors(repeats.Suffixes(np.frombuffer(t, np.uint8), length), at, doc, start)
            assert got.tolist() == brute_factors(t, [*zip(doc.tolist(), start.tolist(), strict=True)], at.tolist(), length)


def test_smaller_positions():
    r = random.Random(4)
    for n in (0, 1, 2, 50, 400):
        x = np.array([r.randint(0, n) for _ in range(n)], np.int64)
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(n)]
        assert repeats.smaller_before(x).tolist() == want


def test_periodic_texts_are_one_run():
    for unit in (b"a", b"abc", b"x" * 30 + b"y"):
        t = np.frombuffer(unit * (400_000 // len(unit)), np.uint8)
        key, n, lo, hi, _ = repeats.minimizers(t, np.array([0, len(t)]))
        assert len(key) <= len(unit) and n.sum() > 1000 and (hi - lo + 1).sum() == len(t) - 99


def test_megabytes_of_one_letter(spark):
    rows = [(1, "a" * 3_000_000), (2, "a" * 150), (3, "b" + "a" * 99)]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.remove_repeats(texts(spark, rows), keep_text=False).collect()}
    assert got == {1: (2_999_999, 1), 2: (150, 1), 3: (0, 0)}


def test_repeated_ids_with_other_neighbours(spark):
    """Rows of one id are alike also where only a part of them is elsewhere."""
    r = random.Random(2)
    t = "".join(r.choice("abcdefgh ") for _ in range(600))
    rows = [(0, "z" * 50 + t[200:400]), (1, t), (1, t), (None, t[100:300]), (None, t[100:300])]
    for block in (1 << 20, 500):
        got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_removed"]) for x in repeats.remove_repeats(texts(spark, rows), block=block, keep_text=False).collect())
        assert got == [(-1, 200), (-1, 200), (0, 0), (1, 200), (1, 200)]


@pytest.mark.parametrize("hot,block,group", [(2000, 1 << 20, 4096), (3, 3000, 4096), (3, 1000, 4)])
def test_repeats(spark, hot, block, group):
    r = random.Random(hot)
    u = "".join(r.choice("abcd efg\n") for _ in range(3000))
    kinds = [lambda: "", lambda: None, lambda: u[r.randint(0, 2000) :][: r.randint(0, 400)], lambda: "a" * r.randint(90, 300), lambda: "".join(r.choice("ab é") for _ in range(r.randint(0, 300))) + u[: r.randint(80, 140)], lambda: u[:130] * 3]
    rows = [(k, r.choice(kinds)()) for k in range(150)] + [(None, u[:500]), (LAST - 1, u * 5)]
    got = repeats.remove_repeats(texts(spark, rows, extra=True), hot=hot, block=block, group=group).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == brute_repeats(rows, 100)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] for x in got)


def test_copies_of_whole_texts_send_no_contexts(spark):
    """Of shifted copies of a table only the first sends its minimizers; a block in parts gives the same as one whole."""
    r = random.Random(5)
    t = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(50, 900))) for _ in range(30)]
    rows = [(100 * k + i, x) for k in range(4) for i, x in enumerate(t)] + [(999, t[3][:60] + t[7][:200] + t[7]), (None, t[5]), (None, t[5][1:])]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows])], ["id", "text"])
    data, off = repeats.utf8_view(batch.column(1))
    copied, firsts = repeats._texts(data, off, np.array([repeats.LAST if x[0] is None else x[0] for x in rows]), 100)
    long = sum(len(x) >= 100 for x in t)
    assert len(firsts) == long + 1 + (len(t[5]) > 100) and len(copied) == 3 * long + (len(t[5]) >= 100)
    for block, step in ((1 << 20, 1000), (3000, 700)):
        got = repeats.remove_repeats(texts(spark, rows[:-1]), block=block, step=step, keep_text=False).collect()
        assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == brute_repeats(rows[:-1], 100)


def test_spans_that_go_on_in_the_next_text(spark):
    """Removed ranges of texts side by side touch; parts of a block are cut between these texts."""
    r = random.Random(6)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(0, a + "-" + b), (1, a), (2, b), (3, ""), (4, b[:250] + "x" * 50)]
    for step in (1 << 20, 300):
        got = repeats.remove_repeats(texts(spark, rows).coalesce(1), hot=2, step=step).collect()
        assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == brute_repeats(rows, 100)


def test_repeats_of_one_id(spark):
    """Rows with one id are at one place: no copies of themselves; an empty table gives none."""
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh ") for _ in range(300))
    got = repeats.remove_repeats(texts(spark, [(1, t), (1, t), (2, t)]), keep_text=False).collect()
    assert sorted((x["doc_id"], x["n_removed"]) for x in got) == [(1, 0), (1, 0), (2, 300)]
    assert repeats.remove_repeats(texts(spark, [(1, "")]).limit(0)).count() == 0


# ---------------------------------------------------------------- near copies


def brute_near(rows):
    def shingles(t):
        w = words(t)
        return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets, by = [shingles(t) for _, t in rows], collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    up, links = [*range(len(rows))], [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in by[g]).items():
            if j != i and n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                up[top(i)] = top(j)
    members = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[top(i)].append(LAST if d is None else d)
    return sorted(((LAST if d is None else d), min(members[top(i)]), len(members[top(i)]), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [1024, 7])
def test_jaccard(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 500)}" for _ in range(60)) for _ in range(6)]

    def near():
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randint(0, 59)] = f"x{r.randint(0, 99)}"
        return " ".join(w)

    kinds = [near, near, lambda: "", lambda: None, lambda: "a b c", lambda: "?!", lambda: r.choice(base).upper()]
    rows = [(k, r.choice(kinds)()) for k in range(160)] + [(None, base[0]), (5, base[0]), (5, base[0]), (7, None), (161, "long " * 30_000)]
    got = jaccard.jaccard_join(texts(spark, rows, extra=True)).collect()
    last = lambda x: LAST if x is None else x
    assert sorted((last(x["doc_id"]), last(x["class_id"]), x["class_size"], x["n_links"]) for x in got) == brute_near(rows)


def test_near_copies_leave_one(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(4, t), (2, t + " x"), (9, "y " + t), (1, "other words that nobody else has here"), (None, None), (3, None)]
    left = jaccard.drop_near_copies(texts(spark, rows, extra=True))
    assert sorted(map(repr, (x["doc_id"] for x in left.collect()))) == ["1", "2", "3", "None"]
    assert left.columns == ["doc_id", "text", "kept", "id", "block", "a`b.c"]
    assert jaccard.jaccard_join(left.limit(0)).count() == 0


def test_near_copies_are_rows_not_ids(spark):
    """A null or repeated id beside a linked one takes no unrelated row with it, and each class leaves just one row."""
    t = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcd"]
    other = [f"{c} words that nobody else has here" for c in "abcd"]
    rows = [(1, t[0]), (None, t[0]), (None, other[0])] + [(11, t[1]), (12, t[1]), (12, other[1])]
    rows += [(21, t[2]), (21, t[2]), (21, t[2] + " x"), (21, other[2]), (21, None), (21, None)] + [(None, t[3]), (None, t[3]), (None, ""), (None, "")]
    left = [(1, "a"), (None, other[0]), (11, "b"), (12, other[1]), (21, "c"), (21, other[2]), (21, None), (21, None), (None, "d"), (None, ""), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.drop_near_copies(texts(spark, rows, extra=True)).collect()]
    # which of two sets of one id stays is settled by their keys
    got = [(i, x[0] if x and x.removesuffix(" x") in t else x) for i, x in got]
    assert sorted(got, key=repr) == sorted(left, key=repr)


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for run in (jaccard.jaccard_join, jaccard.drop_near_copies):
        with pytest.raises(TypeError):
            run(df)


def test_recall_near_the_threshold():
    """20,000 pairs of sets with a similarity of 0.8 to 0.82: share a band and are not pruned, against the exact join (all of them)."""
    r = np.random.default_rng(11)
    missed = total = 0
    for _ in range(20):
        n = int(r.integers(20, 200))
        both = int(np.ceil(0.8 * 2 * n / 1.8))  # of two sets of n this many in common give 0.8
        h = r.integers(0, 2**64, (1000, 2 * n - both), dtype=np.uint64)
        a, b = h[:, :n], h[:, n - both :]
        exact = both / (2 * n - both)
        assert 0.8 <= exact < 0.87
        off = np.arange(1001) * n
        x, y = (jaccard.signatures(np.sort(v, 1).reshape(-1), off) for v in (a, b))
        met = (x.reshape(1000, jaccard.BANDS, jaccard.ROWS) == y.reshape(1000, jaccard.BANDS, jaccard.ROWS)).all(2).any(1)
        same = (x.astype(np.uint8) == y.astype(np.uint8)).cumsum(1)
        kept = met & np.all([same[:, n - 1] >= m for n, m in jaccard.least_matches()], axis=0)
        missed += 1000 - int(kept.sum())
        total += 1000
    assert missed <= 2 and total == 20_000


def test_pruning_is_monotone():
    needed = jaccard.least_matches()
    assert [n for n, _ in needed] == [24, 48, 72, 96]
    assert all(0 < m < 0.8 * n for n, m in needed)

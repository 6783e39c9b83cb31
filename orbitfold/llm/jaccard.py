"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of five-word shingles form one node. Nodes that share a band of MinHash values meet in
buckets; there the values (one byte of each) are compared some at a time, and a pair is dropped when the posterior
probability that its similarity reaches the threshold falls below a tolerance. What survives puts nodes into candidate
groups; only documents of these send their whole shingle sets, and every pair inside a group is verified exactly.
Buckets and groups beyond a size, in nodes or in bytes, are split into pairs of chunks, so no task grows with them; pairs
are never rows: a task gives each node's links as a number, and an edge to the least node that it is connected with.

At a similarity of exactly 0.8 a pair shares no band with probability (1 - 0.8**4)**24 = 3e-6, and is pruned with about
the tolerance; both fall quickly above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import U64, columns, discard, first_in_row, free_name, integer_id, likely, materialize, mix, safe_names, ship, slices, utf8_view, words
from .components import components
from .decontaminate import shingles

N_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-6
#: Nodes in a chunk of a bucket or group, and bytes of shingles in a chunk of a group.
CHUNK, CHUNK_BYTES = 1024, 16 << 20
LAST = 2**63 - 1  # the id that null stands for
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(rows: np.ndarray, hashes: np.ndarray, n_rows: int, k: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and n_rows + 1 offsets; a text of fewer words is one shingle."""
    sh, ok = shingles(rows, hashes, k)
    r, h = rows[ok], sh[ok]
    first = first_in_row(rows, n_rows)
    count = np.diff(first)
    for w in range(1, k):  # short texts
        short = np.flatnonzero(count == w)
        if len(short):
            x, _ = shingles(rows, hashes, w)
            r, h = np.concatenate((r, short)), np.concatenate((h, x[first[short]]))
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    r, h = r[new], h[new]
    return h, first_in_row(r, n_rows)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values of each text, rows of uint32; texts without shingles have arbitrary ones."""
    out = np.zeros((len(off) - 1, len(_SEEDS)), np.uint32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        for k, seed in enumerate(_SEEDS):
            v = ((h ^ (seed >> U64(7))) * seed) >> U64(32)
            out[some, k] = np.minimum.reduceat(v, off[some]).astype(np.uint32)
    return out


def set_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128 bits that equal sets have in common."""
    total = [np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(s))))) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    return np.stack([mix((t[off[1:]] - t[off[:-1]]) + np.diff(off).astype(U64)) for t in total], 1)


def _sign(text: str, names: list[str]):
    """The columns that come, the text only if it is among ``names``, then set key, MinHash values, their low bytes, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            data, off = utf8_view(b.column(b.schema.get_field_index(text)))
            rows, _, _, hashes = words(data, off)
            h, at = shingle_sets(rows, hashes, b.num_rows)
            n, key = np.diff(at), set_keys(h, at)
            sig = signatures(h, at)
            found = [pa.array([x.tobytes() if s else None for x, s in zip(values, n > 0, strict=True)], pa.binary()) for values in (key, sig, sig.astype(np.uint8))]
            carried = [b.column(i) for i, c in enumerate(b.schema.names) if c in names]
            yield pa.RecordBatch.from_arrays([*carried, *found, pa.array(n.astype(np.int64))], names)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, BANDS, ROWS).astype(U64)
            h = np.broadcast_to(np.arange(BANDS, dtype=U64), (b.num_rows, BANDS)).copy()
            for k in range(ROWS):
                h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, :, k])
            node = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).astype(np.int64)), node], ["band", "node"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold) is below ``tolerance``.

    The prior of the similarity is uniform; one-byte values of different minima match once in 256.
    """
    j = (np.arange(2000) + 0.5) / 2000
    p = j + (1 - j) / 256
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - np.max(m * np.log(p) + (n - m) * np.log1p(-p)))
            if like[j >= threshold].sum() / like.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that incremental comparison does not drop."""
    x, y, done = None, None, 0
    for n, m in needed:
        if x is None:
            hits = np.zeros((len(a), len(b)), np.int16)
            for k in range(done, n):
                hits += a[:, k, None] == b[None, :, k]
            x, y = np.nonzero(hits >= m)
            hits = hits[x, y]
        else:
            hits = hits + (a[x, done:n] == b[y, done:n]).sum(1)
            keep = hits >= m
            x, y, hits = x[keep], y[keep], hits[keep]
        done = n
    return x, y


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for edges between 0 .. n - 1."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def chunked(df: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """A row for each pair of chunks (ci <= cj) that a member of a large group takes part in; one row (0, 0) in a small one.

    ``size`` is the number of members of the group that ``key`` names.
    """
    n = F.ceil(F.col(size) / F.lit(CHUNK)).cast("int")
    mine = F.pmod(F.xxhash64(node), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(F.col("_mine"), j).alias("ci"), F.greatest(F.col("_mine"), j).alias("cj")))
    return df.withColumn("_mine", mine).withColumn("_p", F.explode(pairs)).select(*df.columns, "_mine", F.col("_p.ci").alias("ci"), F.col("_p.cj").alias("cj"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal (first, ci, cj), the first three columns, and their other columns."""
    now, held = None, []
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[:3] != now:
                if held:
                    yield now, [*map(list, zip(*held, strict=True))]
                now, held = x[:3], []
            held.append(x[3:])
    if held:
        yield now, [*map(list, zip(*held, strict=True))]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the least that it survives with, directly or through others in this pair of chunks."""
    needed = least_matches()
    out: list[tuple[bytes, bytes]] = []
    for (_, ci, cj), (mine, node, sig) in _groups(batches):
        order = sorted(range(len(node)), key=node.__getitem__)
        node, mine = [node[i] for i in order], np.array([mine[i] for i in order])
        s = np.frombuffer(b"".join(sig[i] for i in order), np.uint8).reshape(len(node), -1)
        a, b = (np.flatnonzero(mine == c) for c in (ci, cj))
        if len(a) and len(b):
            x, y = surviving(s[a], s[b], needed)
            label = roots(len(node), a[x], b[y])
            out += [(node[i], node[k]) for i, k in enumerate(label.tolist()) if i != k]
        if len(out) > 5000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _edges(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data, off = utf8_view(b.column(4))
        rows, _, _, hashes = words(data, off)
        h, at = shingle_sets(rows, hashes, b.num_rows)
        own = pa.array([x.tobytes() == y for x, y in zip(set_keys(h, at), b.column(1).to_pylist(), strict=True)])  # a repeated id has other texts
        out = [*b.columns[:4], pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["grp", "node", "size", "c", "set"]).filter(own)


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``, by products of presence matrices."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    which, col = which[keep], column[inverse[keep]]
    out = np.zeros((len(a), len(b)), np.float32)
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    order = np.argsort(col, kind="stable")
    which, col = which[order], col[order]
    for c in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [c, c + 4096])
        w, k = which[i:j], col[i:j] - c
        m = [np.zeros((len(x), 4096), np.float32) for x in (a, b)]
        for mat, place in zip(m, (place_a, place_b), strict=True):
            ok = place[w] >= 0
            mat[place[w[ok]], k[ok]] = 1
        out += m[0] @ m[1].T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, ci, cj), (mine, node, size, raw) in _groups(batches):
            order = sorted({x: i for i, x in enumerate(node)}.values(), key=node.__getitem__)  # rows of a repeated id once
            node, mine, size = [node[i] for i in order], np.array([mine[i] for i in order]), np.array([size[i] for i in order])
            sets = [np.frombuffer(raw[i], U64) for i in order]
            n = np.array([len(s) for s in sets], np.float64)
            a, b = (np.flatnonzero(mine == c) for c in (ci, cj))
            if not len(a) or not len(b):
                continue
            both = common_counts(sets, a, b).astype(np.float64)
            link = both >= threshold * (n[a][:, None] + n[b][None, :] - both) - 1e-9
            if ci == cj:
                np.fill_diagonal(link, False)
            links = np.zeros(len(node), np.int64)
            links[a] += (link * size[b][None, :]).sum(1)
            if ci != cj:
                links[b] += (link * size[a][:, None]).sum(0)
            x, y = np.nonzero(link)
            label = roots(len(node), a[x], b[y])
            out += [(node[i], node[k], int(links[i])) for i, k in enumerate(label.tolist()) if links[i]]
            if len(out) > 5000:
                yield _linked(out)
                out = []
        if out:
            yield _linked(out)

    return run


def _linked(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["a", "b", "links"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, class_id, class_size, n_links.

    Linked are documents whose sets of five-word shingles (words as in decontamination; a text of fewer words is one
    shingle) have a Jaccard similarity of ``threshold`` (0.8 or more) at least; n_links counts them, copies included. A
    class is a connected group, named by its least id. Texts without words, null ones too, have no links and are a
    class each. Ids are integers; a null id comes last and stays null. Repeated rows are copies of each other. Other
    columns are ignored; an empty table gives an empty result.
    """
    if threshold < THRESHOLD:
        raise ValueError("bands and pruning are set up for similarities of 0.8 or more")
    integer_id(docs, id_col)
    rows = docs.select(_with_id(id_col), F.col(text_col).cast("string").alias("text"))
    signed = _signed(rows, "text", ["id"], ["node", "sig", "low", "n"])
    answer = _classes(signed, rows, threshold)
    out = signed.select("id", "node").join(answer, "node", "left")
    null = lambda c: F.when(c != LAST, c)
    count = lambda c, least: F.coalesce(c, F.lit(least)).cast("long").alias(c)
    return out.select(null(F.col("id")).alias(id_col), null(F.coalesce("keep_id", "id")).alias("class_id"), count("class_size", 1), count("n_links", 0))


def _with_id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id")


def _signed(rows: DataFrame, text: str, carried: list[str], added: list[str]) -> DataFrame:
    """The carried columns, then set key, MinHash values, their low bytes and the number of shingles, as a written table."""
    ship(rows.sparkSession)
    kinds = [BinaryType(), BinaryType(), BinaryType(), LongType()]
    safe, place = safe_names(rows), {c: f"c{i}" for i, c in enumerate(rows.columns)}
    fields = [*(safe.schema[place[c]] for c in carried), *(StructField(n, t) for n, t in zip(added, kinds, strict=True))]
    return materialize(safe.mapInArrow(_sign(place[text], [f.name for f in fields]), StructType(fields)).toDF(*carried, *added), "jaccard-signed")


def _classes(signed: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(node, keep_id, keep_node, class_size, n_links) of ``signed`` (id, node, sig, low, n), texts from ``rows`` (id, text).

    The first of a class is the one with the least id, then the least set key.
    """
    spark = signed.sparkSession
    firsts = (F.first(c).alias(c) for c in ("sig", "low", "n"))
    nodes = materialize(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), *firsts), "jaccard-nodes")
    bands = nodes.select("node", "sig").mapInArrow(_bands, "band long, node binary")
    several = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-buckets")
    met = materialize(likely(bands, "band", several).join(several, "band"), "jaccard-met")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = chunked(met.join(nodes.select("node", F.col("low").alias("sig")), "node"), "band", "c", "node")
    dealt = pairs.repartition(partitions, "band", "ci", "cj").sortWithinPartitions("band", "ci", "cj")
    edges = dealt.select("band", "ci", "cj", "_mine", "node", "sig").mapInArrow(_candidates, "a binary, b binary").distinct()
    groups = materialize(components(edges).join(nodes.select("node", "id", "size", "n"), "node"), "jaccard-groups")
    discard(several)
    discard(met)
    heavy = F.ceil(F.sum("n") * (8.0 * CHUNK / CHUNK_BYTES))  # a group of long texts counts as one of more nodes
    sized = materialize(groups.join(groups.groupBy("root").agg(F.greatest(F.count(F.lit(1)), heavy).alias("c")), "root"), "jaccard-sized")
    sets = first_texts(rows, sized).mapInArrow(_sets, "grp binary, node binary, size long, c long, set binary")
    pairs = chunked(sets, "grp", "c", "node")
    dealt = pairs.repartition(partitions, "grp", "ci", "cj").sortWithinPartitions("grp", "ci", "cj")
    linked = materialize(dealt.select("grp", "ci", "cj", "_mine", "node", "size", "set").mapInArrow(_verify(threshold), "a binary, b binary, links long"), "jaccard-links")
    classes = components(linked.where("a <> b").select("a", "b"))
    links = linked.groupBy("a").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "id", "size").join(classes, "node", "left").join(links, F.col("node") == F.col("a"), "left")
    named = named.select("node", "id", "size", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    whole = named.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least"), F.sum("size").alias("class_size"))
    found = named.join(whole, "root")
    found = found.select("node", F.col("least.id").alias("keep_id"), F.col("least.node").alias("keep_node"), "class_size", (F.col("links") + F.col("size") - 1).alias("n_links"))
    answer = materialize(found, "jaccard-answer")
    for t in (nodes, groups, sized, linked):
        discard(t)
    return answer


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows without links, and of each class one row, that with the least id; all columns as they were.

    Rows are told apart by id and set of shingles: rows of one id, or of none, with unrelated texts all stay. Of rows
    with the same id and set the one whose text comes first stays. Null, empty and wordless texts stay; an empty table
    gives an empty result. Of very long texts nothing is cut.
    """
    integer_id(docs, id_col)
    added = free_name(docs, "near_node", "near_sig", "near_low", "near_n", "near_rank", "near_keep_id", "near_keep_node")
    node, _, _, _, rank, keep_id, keep_node = added
    signed = _signed(docs, text_col, docs.columns, added[:4])
    rows = signed.select(_with_id(id_col), F.col(text_col).cast("string").alias("text"))
    answer = _classes(signed.select(_with_id(id_col), *(F.col(c).alias(n) for c, n in zip(added, ("node", "sig", "low", "n"), strict=False))), rows, threshold)
    several = answer.where("class_size > 1").select(F.col("node").alias(node), F.col("keep_id").alias(keep_id), F.col("keep_node").alias(keep_node))
    alone = likely(signed, node, several, others=True)
    rest = likely(signed, node, several).join(several, node, "left")
    stays = F.col(keep_id).isNull() | ((_with_id(id_col) == F.col(keep_id)) & (F.col(node) == F.col(keep_node)))
    one = F.row_number().over(Window.partitionBy(node).orderBy(text_col))
    rest = rest.where(stays).withColumn(rank, one).where(F.col(rank) == 1)
    return alone.select(*columns(docs.columns)).unionByName(rest.select(*columns(docs.columns)))


def first_texts(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(grp, node, size, c, text): texts of the rows that have the least id of a node in ``sized``."""
    want = sized.select(F.col("root").alias("grp"), "node", "id", "size", "c")
    return likely(rows, "id", want).join(want, "id").select("grp", "node", "size", "c", "text")

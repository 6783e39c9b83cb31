"""Exact dedup, native: 128-bit content hashes, smallest stable id, byte comparison inside groups.

Only DataFrame functions run here. Each text is hashed once; hashes, sizes and ids, not texts, are grouped by hash, which
counts the group and picks the row that stays. The texts of groups of several rows, brought out by a bitmap of bounded
size, are then compared: the least and the greatest text of a hash are equal unless it has a collision, and map-side
combining sends two texts per key and task, so a hot text costs no more than another. Groups with a collision, if any,
are split by their whole text. Rows find their group by hash, where Spark splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, free_name, likely, materialize

#: The characters of [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _found(rows: DataFrame, hash_of) -> DataFrame:
    """(i, size, m, k) of rows (i, t): code points, normalised text and its hash."""
    size = F.char_length(F.coalesce(F.col("t"), F.lit("")))
    return rows.select("i", size.alias("size"), normalised(F.col("t")).alias("m")).withColumn("k", hash_of(F.col("m")))


def _signed(found: DataFrame) -> DataFrame:
    return materialize(found.select("i", "size", "k", F.sha2("m", 256).alias("sha")), "exact-signed")


def _groups(found: DataFrame, signed: DataFrame) -> DataFrame:
    """(k, sha, c, keep, n) of the groups of several rows: hash, rows, the id and the size of the row that stays.

    ``sha`` is null unless the hash has a collision; then each of its texts is a row, those of one document too.
    """
    best = F.min(F.struct((-F.col("size")).alias("n"), F.col("i").isNull().alias("z"), F.col("i").alias("i"))).alias("best")
    count = F.count(F.lit(1)).alias("c")
    kept = [F.col("c"), F.col("best.i").alias("keep"), (-F.col("best.n")).alias("n")]
    several = signed.groupBy("k").agg(count, best).where("c > 1")
    groups = materialize(several.select("k", F.lit(None).cast("string").alias("sha"), *kept), "exact-groups")
    compared = likely(found.select("k", "m"), "k", groups).groupBy("k").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    mixed = materialize(compared.where("a <> b").select("k"), "exact-mixed")
    if mixed.isEmpty():
        return groups
    split = signed.join(mixed, "k", "left_semi").groupBy("k", "sha").agg(count, best).select("k", "sha", *kept)
    return materialize(groups.join(mixed, "k", "left_anti").unionByName(split), "exact-split")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Of texts equal after deleting white space, the one with the most code points, then the smallest id, stays. Null
    text counts as empty; a null id sorts last; of repeated rows with that id and length just one is kept. An empty
    table gives an empty result; other columns are ignored; very long texts are hashed and compared whole. ``hash_of``
    may be weaker in tests: collisions are split.
    """
    found = _found(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), hash_of)
    signed = _signed(found)
    groups = _groups(found, signed).select(F.col("k").alias("gk"), F.col("sha").alias("gsha"), "c", "keep", "n")
    # before the join, so that nothing above it needs the rows of a key together and skewed partitions can be split
    first = F.row_number().over(Window.partitionBy("i", "sha", "size").orderBy(F.lit(1))) == 1
    rows = signed.withColumn("first", first)
    out = rows.join(groups, (F.col("k") == F.col("gk")) & (F.col("gsha").isNull() | (F.col("sha") == F.col("gsha"))), "left")
    lone = F.col("c").isNull()
    return out.select(
        F.col("i").alias(id_col),
        F.when(lone, F.col("i")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce(F.col("c"), F.lit(1)).cast("long").alias("group_size"),
        ((lone | (F.col("i").eqNullSafe(F.col("keep")) & (F.col("size") == F.col("n")))) & F.col("first")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """The documents that stay, with all their columns: the row of each group that ``exact_dedup`` keeps.

    Identical rows (same id, same text) stay once; of rows of one id whose texts differ in white space alone, the one
    that comes first stays. Documents that no other equals are not shuffled. Nulls, empty tables and long texts as there.
    """
    found = _found(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), hash_of)
    k, size, sha, gk, gsha, c, keep, n, rank = free_name(docs, "k", "size", "sha", "gk", "gsha", "c", "keep", "n", "rank")
    groups = _groups(found, _signed(found)).select(*(F.col(a).alias(b) for a, b in zip(("k", "sha", "c", "keep", "n"), (gk, gsha, c, keep, n), strict=True)))
    norm = normalised(F.col(text_col))
    rows = docs.withColumns({k: hash_of(norm), size: F.char_length(F.coalesce(F.col(text_col), F.lit("")))})
    keys = groups.select(F.col(gk).alias(k))
    alone = likely(rows, k, keys, others=True)
    rest = likely(rows, k, keys).withColumn(sha, F.sha2(norm, 256))
    rest = rest.join(groups, (F.col(k) == F.col(gk)) & (F.col(gsha).isNull() | (F.col(sha) == F.col(gsha))), "left")
    rest = rest.where(F.col(c).isNull() | (F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(size) == F.col(n))))
    one = F.row_number().over(Window.partitionBy(k, sha).orderBy(text_col))
    rest = rest.withColumn(rank, one).where(F.col(rank) == 1)
    return alone.select(*columns(docs.columns)).unionByName(rest.select(*columns(docs.columns)))

"""What several training-data operators share: shared-folder tables, Arrow text views and block hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised numpy step works on; bounds the memory of a Python worker.
BLOCK_BYTES = 512 << 10

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="orbitfold-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext.getCheckpointDir()
    return at


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not taken yet, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/orbitfold/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    return path


def file_path(path: str) -> str | None:
    """The path as Python opens it, if the shared folder is in a file system that is mounted everywhere; else None."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` has written, once all that reads it is written too."""
    sc = df.sparkSession.sparkContext
    _delete(sc._jvm, sc._jsc.hadoopConfiguration(), df._written_at)


def columns(names: list[str]) -> list:
    """Columns by name, whatever characters the names have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def safe_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., as functions over Arrow batches take no names with dots or backticks."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def integer_id(df: DataFrame, name: str) -> None:
    """A clear error where ids are no integers."""
    if df.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"column {name} must hold integers, not {df.schema[name].dataType.simpleString()}")


def likely(left: DataFrame, key: str, keys: DataFrame, bits: int = 26, others: bool = False) -> DataFrame:
    """The rows of ``left`` whose ``key`` may be in the column of that name of ``keys``; a few others stay too.

    A bitmap of 2**bits places, at most 2**(bits - 6) rows of two numbers (16 MB at the default), is broadcast, so its
    size is bounded whatever the data. It thins out what an exact join then shuffles; if it is full, it drops nothing.
    A null key is in no table. With ``others``, exactly the rows that are left out otherwise.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(__place % 64 as int))")
    maps = keys.select(place.alias("__place")).select((F.col("__place") / 64).cast("long").alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__m"))
    mine = left.withColumn("__place", place).withColumn("__word", (F.col("__place") / 64).cast("long")).withColumn("__bit", bit)
    on = F.col(key).isNotNull() & (F.col("__word") == F.col("__w")) & (F.col("__m").bitwiseAND(F.col("__bit")) != 0)
    return mine.join(F.broadcast(maps), on, "left_anti" if others else "left_semi").select(*columns(left.columns))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that start elsewhere than in the repository."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(os.path.realpath(p) == os.path.realpath(root) for p in known if p) or getattr(spark.sparkContext, "_orbitfold", None):
        return
    import zipfile

    at = os.path.join(tempfile.mkdtemp(prefix="orbitfold-code-"), "orbitfold.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "orbitfold")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    spark.sparkContext.addPyFile(at)
    spark.sparkContext._orbitfold = True


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        n = w
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


# ---------------------------------------------------------------- Arrow text


def utf8_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; one row may be longer, and is then alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def slices(batches: Iterator[pa.RecordBatch], col: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts in ``col`` of each have about ``most`` bytes."""
    for b in batches:
        if b.num_rows:
            _, off = utf8_view(b.column(b.schema.get_field_index(col)))
            for i, j in row_blocks(off, most):
                yield b.slice(i, j - i)


# ---------------------------------------------------------------- hashing


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U64(pow(base, k, 1 << 64))
        k += m
    return out[:n]


class Rolling:
    """Polynomial hashes, modulo 2**64 and then mixed, of any substrings of one block of values."""

    _pow = powers(1 << 16)
    _inv = powers(1 << 16, _BASE_INV)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling._pow) < n + 1:
            Rolling._pow, Rolling._inv = powers(2 * n), powers(2 * n, _BASE_INV)
        v = values.astype(U64) + U64(1)
        v *= Rolling._pow[:n]
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum(v, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling._inv[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Of each window of ``k`` values, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * Rolling._inv[:n]) if n > 0 else np.zeros(0, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


# ---------------------------------------------------------------- words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased (A-Z) UTF-8 texts.

    Returns the row of each word, its start and end byte, and a 64-bit hash of its bytes. No word crosses a row.
    """
    low = _LOWER[data]
    w = _IS_WORD[low]
    n = len(w)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(w & (np.concatenate(([True], ~w[:-1])) | cut[:n]))
    ends = np.flatnonzero(w & (np.concatenate((~w[1:], [True])) | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, ends, Rolling(low).of(starts, ends)


def first_in_row(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets into a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))

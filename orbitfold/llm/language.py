"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: k(x, y) is the number of letter n-grams (n = 1..4, hashed to
``BINS`` bins) that both texts have, over the root of k(x, x) k(y, y). Landmarks from the training sample give the
Nyström features, and one-versus-rest kernel ridge regression on them gives a score for each language. Texts are scored
in batches: presence matrix x landmarks x weights. Only labelled rows outside the held-out third are ever trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import columns, free_name, safe_names, ship, slices, utf8_view

#: n-gram lengths, bins, training texts for each language (a bounded sample), ridge.
GRAMS, BINS, PER_LANG, RIDGE = (1, 2, 3, 4), 8192, 400, 1e-2
#: Landmarks in all, and of each language at least.
LANDMARKS, PER_LABEL = 192, 8
UNKNOWN = "und"
#: A text whose best decision value leads the mean of the others by less is rejected by the pipeline. Values of texts in
#: a language are near 1 and those of the others near -1, however many languages there are.
LEAST_LEAD = 0.12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII that is no letter becomes a space; bytes of other characters stay, so n-grams see UTF-8.
_TEXT = np.where((_LOWER >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)), _LOWER, 32).astype(np.uint8)


def presence(data: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row for each text, 1 in the bin of each n-gram that it has; n-grams of white space and across texts do not count."""
    n_rows = len(off) - 1
    out = np.zeros((n_rows, bins), np.float32)
    n = len(data)
    if n == 0:
        return out
    t = _TEXT[data]
    row = np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(off))
    end = off[1:][row]
    pos = np.arange(n)
    h = np.zeros(n, np.uint32)
    doubled = np.zeros(n, bool)
    doubled[1:] = (t[1:] == 32) & (t[:-1] == 32)
    flat = out.reshape(-1)
    base = row.astype(np.int64) * bins
    for k in range(1, max(GRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + t[k - 1 :].astype(np.uint32) + np.uint32(k)
        if k in GRAMS:
            ok = (pos[:m] + k <= end[:m]) & ~((k == 1) & (t[:m] == 32)) & ~doubled[:m] & ~doubled[k - 1 :]
            x = h * np.uint32(0x9E3779B1)
            flat[base[:m][ok] + (x[ok] >> np.uint32(19)) % bins] = 1
    return out


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])


class Model:
    """Nyström features on landmarks, and ridge weights of each language against the rest."""

    def __init__(self, x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(labels))
        x = x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1e-9)
        pick, per = [], max(PER_LABEL, landmarks // max(1, len(self.langs)))
        y = np.array([self.langs.index(v) for v in labels])
        for c in range(len(self.langs)):
            pick += np.flatnonzero(y == c)[:per].tolist()
        z = x[pick]
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        half = vectors[:, keep] / np.sqrt(values[keep])  # (landmark kernel) ** -1/2
        self.z = np.ascontiguousarray(z.T)
        phi = np.hstack([(x @ self.z) @ half, np.ones((len(x), 1))])
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = len(y) / (len(self.langs) * np.bincount(y, minlength=len(self.langs)))[y]  # languages count alike
        a = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
        self.w = np.linalg.solve(a, phi.T @ (target * weight[:, None]))
        self.head, self.bias = (half @ self.w[:-1]).astype(np.float32), self.w[-1].astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One-versus-rest decision values of presence rows."""
        norm = np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1e-9)
        return ((x @ self.z) / norm) @ self.head + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, a score in 0..1 (the share of the best decision value, softened) and its lead, of each text.

        The lead is that of the best decision value over the mean of the others, or over -1 if there is one language.
        """
        s = np.vstack([self.scores(presence(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in _groups(off)]) if len(off) > 1 else np.zeros((0, len(self.langs)))
        e = np.exp(4 * (s - s.max(1, keepdims=True)))
        top, n = s.max(1), len(self.langs)
        lead = top - ((s.sum(1) - top) / (n - 1) if n > 1 else -1.0)
        return s.argmax(1), (e.max(1) / e.sum(1)).astype(np.float64), lead.astype(np.float64)


def _groups(off: np.ndarray, rows: int = 256) -> Iterator[tuple[int, int]]:
    return ((i, min(i + rows, len(off) - 1)) for i in range(0, len(off) - 1, rows))


def held_out(id_col) -> object:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        data, off = utf8_view(b.column(1))
        for i, j in _groups(off):
            bits = np.packbits(presence(data[off[i] : off[j]], off[i : j + 1] - off[i]) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in bits], pa.binary())], ["l", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """A model from at most ``per_lang`` labelled rows of each language, outside the held-out third; None without such rows.

    The sample is the rows with the least hash of their id, so it does not depend on partitioning; a threshold from the
    counts of the languages is applied before anything is shuffled. Every label is learned, from whole texts: these are
    turned into presence rows of BINS bits where they are, so a kilobyte for each comes to the driver.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(~held_out(F.col("i")) & F.col("l").isNotNull())
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each language
    if not counts:
        return None
    h = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("sample")), F.lit(1 << 30))
    # about twice the rows that are wanted, then the least hashes of these
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, int((1 << 30) * min(1.0, 2 * per_lang / n)))))
    some = rows.withColumn("h", h).where(F.col("h") < F.try_element_at(share, F.col("l"))).where(F.col("t").rlike(r"\p{L}")).select("l", "h", "t")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    sample = some.withColumn("k", rank).where(F.col("k") <= per_lang).select("l", "t")
    found = sorted((r["l"], bytes(r["x"])) for r in sample.mapInArrow(_presence_rows, "l string, x binary").collect())
    if not found:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(len(found), -1), axis=1)[:, :BINS].astype(np.float32)
    return Model(x, [v for v, _ in found])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then held_out, lang_pred, score, lead (with leading underscores where ``docs`` has such names)."""
    spark = docs.sparkSession
    ship(spark)
    out, pred, sure, lead = free_name(docs, "held_out", "lang_pred", "score", "lead")
    sent = spark.sparkContext.broadcast(model)  # rows of BINS floats: LANDMARKS, or PER_LABEL a language; and the weights
    rows = docs.withColumn(out, held_out(F.col(id_col)))
    safe, text = safe_names(rows), f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, text):
            col = b.column(b.schema.get_field_index(text))
            some = has_letter(col.to_pylist())
            if m is None:
                lang, score, ahead = np.full(b.num_rows, None, object), np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                best, score, ahead = m.predict(*utf8_view(col))
                lang = np.array(m.langs, object)[best]
            lang[~some], score[~some] = UNKNOWN, 0.0
            lang = np.where(np.equal(lang, None), UNKNOWN, lang)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(ahead)], [*b.schema.names, pred, sure, lead])

    added = [StructField(pred, StringType()), StructField(sure, DoubleType()), StructField(lead, DoubleType())]
    return safe.mapInArrow(run, StructType([*safe.schema, *added])).toDF(*rows.columns, pred, sure, lead)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_LEAD) -> DataFrame:
    """The documents with a language, all columns as they were: not ``und``, and a lead of ``least`` or more.

    Null, empty and letterless texts go, and all rows if there is nothing to learn from. Repeated rows and null ids are
    rows like any others; an empty table gives an empty result; very long texts are scored whole.
    """
    some = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    _, pred, _, lead = free_name(docs, "held_out", "lang_pred", "score", "lead")
    return some.where((F.col(pred) != UNKNOWN) & (F.col(lead) >= least)).select(*columns(docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, held_out, lang_pred, score.

    Null text and text without letters is ``und`` with score 0; so is all text if there is nothing to learn from. A null
    id counts as not held out. Repeated rows each give a row; other columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col))
    return predict(rows.select(id_col, text_col), fit(rows, id_col, text_col, lang_col), id_col, text_col).select(id_col, "held_out", "lang_pred", "score")

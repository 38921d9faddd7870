"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters are hashed into a fixed number of features. Document frequencies come from all training
documents. The weights are fitted by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of
labelled documents, part of which is left out to set the temperature that calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import U64, byte_slices, lean, mix, row_key

FEATURE_BITS, ORDERS = 16, (1, 2, 3)
#: Labelled documents that the weights are fitted on: per language, and at most in all.
SAMPLE, SAMPLE_ALL = 1000, 500_000
#: Weights of a model. With more than 256 languages n-grams share more features, so that every language is learnt.
CELLS = 1 << 24
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 1e-5, 1e-6
PART = 128 << 10


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows (one per lead byte) and the offsets of the rows among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    a, b, c, d = wide[at], wide[at + 1] & 0x3F, wide[at + 2] & 0x3F, wide[at + 3] & 0x3F
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    return point, np.searchsorted(at, offsets)


def fold_table() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 for anything that is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0]) if low else c
    return out


class Letters:
    """The letter table, made once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def fold(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = fold_table()
        return cls.table[points]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and row of every n-gram of letters (runs of other characters count as one gap), and each row's letters."""
    points, at = code_points(data, offsets)
    letter = Letters.fold(points)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    letters = np.bincount(row[letter > 0], minlength=len(offsets) - 1)
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (row[1:] != row[:-1])
    letter, row = letter[keep].astype(U64), row[keep]
    ids, rows = [], []
    for order in ORDERS:
        n = len(letter) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, U64)
        for i in range(order):
            key = (key << U64(20)) ^ letter[i:n + i] if order == 3 else (key << U64(21)) | letter[i:n + i]
        own = (row[:n] == row[order - 1:]) & ((letter[:n] > 0) | (letter[order - 1:] > 0))
        ids.append((mix(key[own] + U64(order)) >> U64(64 - bits)).astype(np.int64))
        rows.append(row[:n][own])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(ids or empty), np.concatenate(rows or empty), letters


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and how many texts there are; partial sums per task, bounded by the feature count."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(0), PART):
                ids, rows, _ = features(data, offsets, bits)
                total += np.bincount(np.unique(rows << bits | ids) & ((1 << bits) - 1), minlength=len(total))
                n += hi - lo
        held = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.append(total[held[:-1]], n))], ["feature", "df"])

    found = docs.select("text").mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow().to_pandas()
    out, n = np.zeros(1 << bits), 0
    for feature, df in zip(found["feature"], found["df"]):
        if feature < 0:
            n = int(df)
        else:
            out[feature] = df
    return out, n


class Model:
    """Languages, idf-weighted coefficients per feature and language, intercepts and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights = np.zeros((len(idf), len(languages)), np.float32)
        self.bias = np.zeros(len(languages))
        self.temperature = 1.0

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Rows, features and values of the unit TF-IDF vectors of texts, and each text's letters."""
        bits = len(self.idf).bit_length() - 1
        ids, rows, letters = features(data, offsets, bits)
        key, count = np.unique(rows << bits | ids, return_counts=True)
        row, feature = key >> bits, key & (len(self.idf) - 1)
        value = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(letters)))
        return row, feature, value / np.maximum(norm[row], 1e-9), letters

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, value * self.weights[feature, k], minlength=n) for k in range(len(self.languages))], 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """FTRL-proximal over single documents: ``vectors`` holds (features, values)."""
        width = len(self.languages)
        z, n = np.zeros((len(self.idf) + 1, width)), np.zeros((len(self.idf) + 1, width))

        def solved(at: np.ndarray) -> np.ndarray:
            own = z[at]
            return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

        held_out = np.arange(len(labels)) % 5 == 4
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(np.flatnonzero(~held_out)):
                at, x = np.append(vectors[i][0], len(self.idf)), np.append(vectors[i][1], 1.0)
                w = solved(at)
                p = x @ w
                p = np.exp(p - p.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = x[:, None] * p
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
        every = solved(np.arange(len(self.idf) + 1))
        self.weights, self.bias = every[:-1].astype(np.float32), every[-1]
        self.calibrate([v for v, h in zip(vectors, held_out) if h], labels[held_out])

    def calibrate(self, vectors: list, labels: np.ndarray) -> None:
        """The temperature that makes the left-out part most likely, by golden-section search on its logarithm."""
        if not len(labels):
            return
        logits = np.stack([x @ self.weights[f] for f, x in vectors]) + self.bias

        def loss(log_t: float) -> float:
            x = logits / np.exp(log_t)
            return float((np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[np.arange(len(labels)), labels]).mean())

        low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def train(docs: DataFrame) -> Model:
    """A model of the labelled ``docs`` (doc_id, text, lang). Frequencies cover all of them; see SAMPLE for the fit."""
    counts = docs.groupBy("lang").count().collect()  # one row a language
    languages = sorted(r["lang"] for r in counts)
    bits = max(4, min(FEATURE_BITS, (CELLS // max(1, len(languages))).bit_length() - 1))
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, len(languages))))
    df, n = document_frequencies(docs, bits)
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1)
    if not languages:
        return model
    # about twice the sample's keys of each language by their hash, so that ranking them is small work
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 20, (2 * each << 20) // r["count"] + 64)) for r in counts], "lang string, share long")
    keys = row_key(docs).select("lang", "rk").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("rk"), F.lit(1 << 20)) < F.col("share")).dropDuplicates(["lang", "rk"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("rk"), F.lit(1 << 20)), "rk"))
    chosen = keys.withColumn("place", place).where(F.col("place") <= each).select("lang", "rk")
    sample = row_key(docs).join(F.broadcast(chosen), ["lang", "rk"], "left_semi")  # at most SAMPLE_ALL keys
    sample = sample.dropDuplicates(["lang", "rk"])

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), PART):
                row, feature, value, letters = model.vectors(data, offsets)
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], ["lang", "rk", "feature", "value"])

    rows = sample.select("lang", "text", "rk").mapInArrow(vectors, "lang string, rk long, feature array<int>, value array<float>").toArrow().to_pandas()
    rows = rows[[len(x) > 0 for x in rows["feature"]]].sort_values("rk", ignore_index=True)
    place_of = {x: i for i, x in enumerate(languages)}
    model.fit([(np.asarray(f, np.int64), np.asarray(v, float)) for f, v in zip(rows["feature"], rows["value"])], rows["lang"].map(place_of).to_numpy(np.int64))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text itself only if asked for), plus lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**16 features by the languages

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            rest = [i for i, name in enumerate(batch.schema.names) if keep_text or name != text_col]
            for lo, hi, data, offsets in byte_slices(text, PART):
                row, feature, value, letters = own.vectors(data, offsets)
                if own.languages:
                    p = own.probabilities(own.logits(row, feature, value, hi - lo))
                    best = p.argmax(1)
                    known = letters > 0
                    name = np.where(known, np.array(own.languages, object)[best], "und")
                    score = np.where(known, p.max(1), 0.0)
                else:
                    name, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                columns = [batch.column(i).slice(lo, hi - lo) for i in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(name, pa.string()), pa.array(score)], [*[batch.schema.names[i] for i in rest], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != text_col)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from the text and non-null language of rows that are not held out and predicts every row from its text
    alone. ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null, has no letter, or
    nothing could be learned; ties go to the first language in order. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out") & F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"))
    return predict(docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")), model)

"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer when its smallest inner s-mer stands at its first or last place. That depends on the k-mer
alone, so the same passage yields the same anchors in any document. Texts are matched by position: two neighbouring
anchors and their distance are one link, and likeness is the share of links that two texts have in common, counted over all
anchors of both. The printed fingerprint holds the anchors of smallest hash (a bottom sketch) and a digest of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchspark.llm.common import U64, byte_slices, eight_bytes, lean, mix, texts

K, S = 16, 8
#: Anchors printed in a fingerprint.
KEPT = 64
#: Rows per range of ids, and ranges at most (a driver-side list of that many ids).
RANGE_ROWS, MAX_RANGES = 1024, 4096
LEAST = -(1 << 63)


def syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte position, row and 64-bit hash of every closed syncmer of each row; a row shorter than K bytes is one anchor."""
    n = len(data) - K + 1
    size = np.diff(offsets)
    at = np.zeros(0, np.int64)
    if n > 0:
        packed = eight_bytes(data)
        rank = mix(packed)
        inner = K - S + 1
        low, span = rank, 1
        while span < inner:
            step = min(span, inner - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        at = np.flatnonzero((low == rank[:n]) | (low == rank[inner - 1:inner - 1 + n]))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + K <= offsets[row + 1]
    at, row = at[inside], row[inside]
    value = mix(mix(packed[at]) + packed[at + 8]) if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((size > 0) & (size < K))
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(data[offsets[i]:offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short]
        at, row, value = np.append(at, offsets[short]), np.append(row, short), np.append(value, np.array(whole, U64))
    return at - offsets[row], row, value


def anchors(data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """The printed fingerprint and the sorted links of each row.

    A link is hashed from two neighbouring anchors and their distance; a text with a single anchor has that as its only
    link. A passage that two texts share gives both all links inside it, wherever it stands.
    """
    at, row, value = syncmers(data, offsets)
    order = np.lexsort((at, row))
    at, row, value = at[order], row[order], value[order]
    joined = row[1:] == row[:-1]
    link = mix(value[:-1] + mix(value[1:] ^ mix((at[1:] - at[:-1]).astype(U64))))[joined] if len(at) else value
    owner = row[:-1][joined] if len(at) else row
    alone = np.flatnonzero(np.bincount(row, minlength=len(offsets) - 1)[row] == 1) if len(at) else row
    link, owner = np.append(link, value[alone]), np.append(owner, row[alone])
    order = np.lexsort((link, owner))
    link, cut = link[order], np.searchsorted(owner[order], np.arange(len(offsets)))
    key = np.unique(row.astype(U64) << U64(32) | value >> U64(32))
    first = np.searchsorted(key, np.arange(len(offsets), dtype=U64) << U64(32))
    low = (key & U64(0xFFFFFFFF)).astype(">u4")
    out = []
    for i in range(len(offsets) - 1):
        own = link[cut[i]:cut[i + 1]]
        digest = hashlib.blake2b(own.astype(">u8").tobytes(), digest_size=8).hexdigest() if len(own) else ""
        out.append((digest + low[first[i]:min(first[i + 1], first[i] + KEPT)].tobytes().hex(), own))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Links in both over links in either, repeats counted; two texts without links are alike."""
    if not len(a) and not len(b):
        return 1.0
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[:len(a)], minlength=len(keys)), np.bincount(at[len(a):], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as rows ``bucket, guest, doc_id, text``: ranges of ids, each followed by the first row of the next.

    Cut ids come from approximate quantiles; of each range only the smallest id is known to the driver.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("k"))
    rows = keyed.count()
    ranges = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    cuts = sorted(set(keyed.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    cuts = np.array([int(c) for c in cuts], np.int64)

    @pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    heads = sorted((r["bucket"], r["head"]) for r in keyed.groupBy(bucket_of("k").alias("bucket")).agg(F.min("k").alias("head")).collect())
    first = np.array([h for _, h in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)

    @pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        own = np.searchsorted(cuts, ids, "right")
        at = np.minimum(np.searchsorted(first, ids), max(0, len(first) - 1))
        return pd.Series([[2 * o] if first[a] != i else [2 * o, 2 * int(before[a]) + 1] for o, a, i in zip(own.tolist(), at.tolist(), ids.tolist())])

    placed = docs.withColumn("place", F.explode(places(F.coalesce("doc_id", F.lit(LEAST)))))
    placed = placed.select(F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2).alias("guest"), "doc_id", "text")
    return placed.repartition(max(1, ranges // 4), "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one that follows by (id, text), null ids first; after the last comes the first. The edited text
    replaces the last half of the code points by the first as many, or all, of the next text. Null texts are empty; an
    empty text has an empty fingerprint, like only another empty one. Repeated rows follow each other. Other columns are
    ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                ids, guests, own = part.column(2).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
                rows = list(zip(ids, guests, own, anchors(data, offsets)))
                rows = ([held] if held else []) + rows
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                held = rows[-1]
                edited = [a[2][:len(a[2]) - len(a[2]) // 2] + b[2][:len(a[2]) // 2] for a, b in pairs]
                prints = [s for _, _, d, o in byte_slices(pa.array(edited, pa.string())) for s in anchors(d, o)]
                out = [
                    (a[0], len(a[2]), hashlib.sha256(e.encode()).hexdigest(), a[3][0], p[0], likeness(a[3][1], p[1]), likeness(a[3][1], b[3][1]))
                    for (a, b), e, p in zip(pairs, edited, prints)
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    return with_next(texts(df, id_col, text_col)).mapInArrow(run, schema)

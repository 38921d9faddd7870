"""Exact duplicates by counting quotient filters.

Each partition builds one static counting quotient filter of its fingerprints, cut into ranges of the leading bits. The
filters of a range merge by their sorted remainders and lose nothing, so a fingerprint's count after the merge is exact.
Fingerprints counted more than once send their texts to a byte comparison (a grouping by the whole text); all other
documents are known to be single without moving their text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import U64, ascii_lower, lean, sized, texts
from matchspark.session import cut_lineage

#: Fingerprints that a range holds at most on average, which bounds the group that merges it.
RANGE_ROWS = 1 << 17


class CountingQuotientFilter:
    """A static counting quotient filter over the low ``bits`` bits of its keys.

    A key splits into a quotient, named by a set bit of ``occupied``, and a remainder, kept in a slot of that quotient's
    run. Runs are sorted; ``run_end`` marks their last slots. A key held more than once is followed by a slot with its
    count, marked in ``counter``.
    """

    HEAD = struct.Struct("<IBBB")

    @classmethod
    def pack(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
        """Bytes of the filter of sorted distinct ``keys`` (uint64) and their ``counts``."""
        q = min(bits, 24, int(len(keys)).bit_length())
        r = bits - q
        quotient = (keys >> U64(r)).astype(np.int64) if q else np.zeros(len(keys), np.int64)
        remainder = keys & U64((1 << r) - 1)
        many = counts > 1
        slot = np.arange(len(keys)) + np.concatenate([[0], np.cumsum(many)[:-1]]) if len(keys) else np.zeros(0, np.int64)
        n = len(keys) + int(many.sum())
        slots, counter, run_end = np.zeros(n, U64), np.zeros(n, bool), np.zeros(n, bool)
        slots[slot] = remainder
        slots[slot[many] + 1] = counts[many].astype(U64)
        counter[slot[many] + 1] = True
        if n:
            last = np.append(quotient[1:] != quotient[:-1], True)
            run_end[slot[last] + many[last]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        width = max(1, (int(slots.max()).bit_length() + 7) // 8) if n else 1
        body = slots.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
        return cls.HEAD.pack(n, q, bits, width) + b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, counter)) + body

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys and counts that ``pack`` was given."""
        n, q, bits, width = cls.HEAD.unpack_from(raw)
        at, flags = cls.HEAD.size, []
        for size in (1 << q, n, n):
            flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        occupied, run_end, counter = flags
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        slots = wide.view("<u8").reshape(n).astype(U64)
        run = np.cumsum(np.append(0, run_end[:-1])) if n else np.zeros(0, np.int64)
        keys = (np.flatnonzero(occupied)[run].astype(U64) << U64(bits - q)) | slots if n else slots
        own = ~counter
        counts = np.ones(int(own.sum()), np.int64)
        held = np.flatnonzero(counter)
        counts[np.cumsum(own)[held] - 1] = slots[held].astype(np.int64)
        return keys[own], counts

    @classmethod
    def merge(cls, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and summed counts of several filters over the same range."""
        parts = [cls.unpack(x) for x in filters]
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column ``fp``) that ``prints`` holds more than once, with their exact count."""
    lead = max(4, (rows // RANGE_ROWS).bit_length() + 4)
    bits = 64 - lead

    @lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not held:
            return
        keys, counts = np.unique(np.concatenate(held).astype(np.int64).view(U64), return_counts=True)
        block = (keys >> U64(bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        low = keys & U64((1 << bits) - 1)
        packed = [CountingQuotientFilter.pack(low[a:b], counts[a:b], bits) for a, b in zip(first, np.append(first[1:], len(keys)))]
        yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(packed, pa.binary())], ["block", "filter"])

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low, counts = CountingQuotientFilter.merge(list(group["filter"]))
        many = counts > 1
        return pd.DataFrame({"fp": (low[many] | U64(int(key[0]) << bits)).view(np.int64), "copies": counts[many]})

    filters = prints.select("fp").mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInPandas(merged, "fp long, copies long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and fp (the fingerprint of the lower-cased text).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays; a row
    written more than once counts each time and one of it stays. A null text is empty, and empty texts equal each
    other; a null id loses to any other. Other columns are ignored. An empty table gives an empty result.
    """
    docs = texts(df, id_col, text_col).withColumn("text", ascii_lower(F.col("text"))).withColumn("fp", F.xxhash64("text"))
    base = cut_lineage(docs.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256")))
    rows = base.count()
    repeated = cut_lineage(repeated_fingerprints(base, rows))
    n = repeated.count()
    candidates = docs.join(sized(repeated.select("fp"), n, 16), "fp", "left_semi")
    groups = (
        candidates.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    own = F.col("group_size").isNull()
    out = base.join(sized(groups, n, 120), ["fp", "text_sha256"], "left").select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(own, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"), "text_sha256", "fp",
    )
    copy = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0)))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (copy == 1)).alias("kept"), "text_sha256", "fp")

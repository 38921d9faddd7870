"""Importance resampling of documents towards a target distribution.

Words and runs of words are hashed to buckets by CRC-32. The counts of all documents and of the target give each bucket a
gain; a document's weight is the sum of its features' gains, taken from one array. Gumbel noise from a hash of the id turns
weights into a draw without replacement of the k highest scores. The k-th key is found by a distributed quickselect: random
pivot keys cut the open range, every task counts its rows on both sides of each pivot and equal to it, and the range that
holds the k-th key stays open. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import U64, byte_slices, lower_bytes, mix, signed, texts
from matchspark.session import cut_lineage

#: ASCII bytes that end a word, once A-Z are lower-cased: all but digits and a-z.
ENDS = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: Words of more bytes are hashed one by one.
LONG = 64
#: Words whose features are held at a time.
CHUNK = 1 << 18
#: Pivots of a round of the selection.
PIVOTS = 16
#: Rows with a null id come after all others.
LAST = (1 << 63) - 1


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 step table, and for n = 0 .. LONG + 1 the tables that append n zero bytes to a checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    shift = np.empty((LONG + 2, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 2):
        shift[n] = step[shift[n - 1] & 255] ^ (shift[n - 1] >> 8)
    return step, shift


STEP, SHIFT = crc_tables()


def appended(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """``crc`` moved on by ``zeros`` bytes (at most LONG + 1), so that XOR with a suffix's checksum gives that of the whole."""
    return SHIFT[zeros, 0, crc & 255] ^ SHIFT[zeros, 1, (crc >> 8) & 255] ^ SHIFT[zeros, 2, (crc >> 16) & 255] ^ SHIFT[zeros, 3, crc >> 24]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of lower-cased ``data``."""
    solid = ~ENDS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    size = end - start
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i]:end[i]])
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    active = np.searchsorted(-size[short], -np.arange(LONG + 1), "left")  # words longer than j
    state, at = np.full(len(short), 0xFFFFFFFF, np.uint32), start[short]
    for j in range(int(size[short[0]]) if len(short) else 0):
        n = active[j]
        state[:n] = STEP[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out[short] = ~state
    return out


def extended(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Checksums of the runs behind ``crc`` after one space and the word at ``start`` (whose checksum with the space is ``tail``)."""
    size = end - start
    out = appended(crc, np.minimum(size, LONG) + 1) ^ tail
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i]:end[i]], zlib.crc32(b" ", int(crc[i])))
    return out


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Rows in slices: first row, end row, words of each row, and (row in the slice, bucket) of the features piece by piece."""
    space = np.uint32(zlib.crc32(b" "))
    for lo, hi, raw, offsets in byte_slices(column):
        data = lower_bytes(raw)
        start, end, row = words_of(data, offsets)

        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(start), CHUNK):
                b = min(len(start), a + CHUNK + longest - 1)  # a piece also holds the words that its last features need
                s, e, r = start[a:b], end[a:b], row[a:b]
                one = word_checksums(data, s, e)
                tail = appended(np.full(len(s), space), np.minimum(e - s, LONG)) ^ one
                run, own = one, min(CHUNK, len(s))
                yield r[:own], (run[:own] % buckets).astype(np.int64)
                for n in range(1, longest):
                    if len(s) <= n:
                        break
                    run = extended(run[:-1], data, s[n:], e[n:], tail[n:])
                    inside = (r[:-n] == r[n:])[:own]
                    yield r[:-n][:own][inside], (run[:own][inside] % buckets).astype(np.int64)

        yield lo, hi, np.bincount(row, minlength=hi - lo), pieces()


def bucket_counts(df: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; the driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, pieces in features(batch.column(0), longest, buckets):
                for _, bucket in pieces:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "copies"])

    out = np.zeros(buckets, np.int64)
    for r in df.select("text").mapInArrow(count, "bucket long, copies long").groupBy("bucket").agg(F.sum("copies").alias("copies")).collect():
        out[r.bucket] = r.copies
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of the smoothed bucket shares, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``df`` (doc_id, text)."""
    held = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            for lo, hi, words, pieces in features(batch.column(1), longest, len(gain)):
                weight = np.zeros(hi - lo, np.int64)
                for row, bucket in pieces:
                    if len(row):  # rows ascend
                        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        weight[row[first]] += np.add.reduceat(gain[bucket], first)
                n = sum(np.maximum(words - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return df.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise of a document, rounded down, from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


KEY = ("score", "place", "n_features")


def ahead(cols, key: tuple[int, int, int], equal: bool = False):
    """Whether the key of columns or arrays ``cols`` comes before ``key`` (or is equal to it): score down, id up, features up."""
    (a, b, c), (x, y, z) = cols, key
    last = c <= z if equal else c < z
    return (a > x) | ((a == x) & ((b < y) | ((b == y) & last)))


def kth_key(rows: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th of the keys (score, place, n_features) of ``rows``, counted from 1, repeated keys counted each time.

    Every round scans the open range once; the driver gets at most ``2 * PIVOTS + 1`` counts and ``PIVOTS`` keys. With
    PIVOTS random pivots the range shrinks about PIVOTS-fold a round, and every round removes its pivots from the range.
    """
    above = below = None  # keys around the open range
    pivots: list[tuple[int, int, int]] = []
    for turn in range(200):
        salt, held = U64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1), list(pivots)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, best = np.zeros(2 * len(held) + 1, np.int64), np.zeros((0, 5), np.int64)
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                slot = np.zeros(batch.num_rows, np.int64)
                for p in held:
                    slot += (~ahead(cols, p)).astype(np.int64) + ~ahead(cols, p, equal=True)
                counts += np.bincount(slot, minlength=len(counts))
                luck = signed(mix(mix(mix(cols[0].astype(U64) ^ salt) ^ cols[1].astype(U64)) ^ cols[2].astype(U64)))
                best = np.concatenate([best, np.stack([slot, luck, *cols], 1)])
                best = best[np.lexsort((best[:, 1], best[:, 0]))]
                first = np.searchsorted(best[:, 0], best[:, 0], "left")
                best = best[np.arange(len(best)) - first < PIVOTS]
            there = np.flatnonzero(counts)
            none = np.zeros(len(there), np.int64)
            out = np.concatenate([np.stack([there, none, none, none, none, counts[there]], 1), np.hstack([best, np.zeros((len(best), 1), np.int64)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(6)], ["slot", "luck", *KEY, "copies"])

        span = rows.select(*KEY)
        cols = [F.col(c) for c in KEY]
        if above:
            span = span.where(~ahead(cols, above, equal=True))
        if below:
            span = span.where(ahead(cols, below))
        found = cut_lineage(span.mapInArrow(part, "slot long, luck long, score long, place long, n_features long, copies long"))
        counts = sorted((r.slot, r.n) for r in found.groupBy("slot").agg(F.sum("copies").alias("n")).where("n > 0").collect())
        before = 0
        for slot, n in counts:
            if before + n >= k:
                break
            before += n
        k -= before
        if slot % 2:
            return held[slot // 2]
        above, below = (held[slot // 2 - 1] if slot else above), (held[slot // 2] if slot // 2 < len(held) else below)
        picks = found.where((F.col("slot") == slot) & (F.col("copies") == 0)).orderBy("luck").limit(PIVOTS)
        pivots = sorted({(r.score, r.place, r.n_features) for r in picks.collect()}, key=lambda p: (-p[0], p[1], p[2]))
    raise RuntimeError("the selection did not end")


def ranked(winners: DataFrame, k: int) -> DataFrame:
    """``winners`` with their rank by key; ranks above ``k`` (rows equal to the k-th) are null.

    The sort deals out ranges of keys; each row's number within its range and the sizes of the ranges before give the rank.
    """
    parts = winners.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col("score").desc(), F.col("place"), F.col("n_features")]
    placed = cut_lineage(winners.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id()))
    block, within = F.shiftrightunsigned("mark", 33), F.col("mark").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for b, n in sorted((r.block, r.n) for r in placed.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()):  # one row a range
        starts.append((b, before))
        before += n
    at = F.broadcast(winners.sparkSession.createDataFrame(starts, "block long, before long"))
    out = placed.withColumn("block", block).join(at, "block").withColumn("rank", F.col("before") + within + 1)
    return out.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("mark", "block", "before")


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 3, buckets: int = 10000,
    percent: int = 5, least_words: int = 20, seed: int = 42,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (all long), and n_words.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters; features are runs of 1 to ``longest`` words.
    Of the N rows with at least ``least_words`` words, the ``percent * N // 100`` highest scores get ranks 1, 2, ...; ties
    go to the smaller id, then to fewer features. A row written more than once counts and may be drawn each time. A null
    text is empty (weight 0), in ``target`` too; a null id is hashed as the word "null" and loses ties. Other columns are
    ignored. An empty table gives an empty result; an empty target gives gains from smoothing alone.
    """
    rows = texts(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, longest, buckets), bucket_counts(wanted, longest, buckets))
    place = F.coalesce("doc_id", F.lit(LAST))
    scored = cut_lineage(weighed(rows, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("place", place))
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    won = (F.col("n_words") >= least_words) & ahead([F.col(c) for c in KEY], kth_key(able, k), equal=True)
    rest = scored.where(~won).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(won), k).select(out).unionByName(rest.select(out))

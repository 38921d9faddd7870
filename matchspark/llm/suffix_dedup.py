"""Removal of repeated passages by suffix arrays.

A byte goes if a string of LENGTH bytes around it also starts anywhere else. Strings that are equal hold equal anchors
(the smallest hash among their GRAM-byte pieces) at equal places, so every string belongs to one anchor, and the strings
of one anchor that follow each other form a segment. Segments that are equal as a whole are repeated as a whole. Where an
anchor stands in several different segments, one of each goes to a suffix array: suffixes smaller than their successors
are sorted directly, the rest is induced by bucket scans, and neighbours with a common prefix of LENGTH mark repeats.

Suffix arrays are built over groups of anchors of bounded size. The segments of an anchor that stands in very many (a
line that half of all documents hold) are dealt out over several arrays; what each array found, and the strings that are
single in it, are then compared across arrays by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from matchspark.llm.common import U64, byte_slices, eight_bytes, lean, lean_group, mix, packed_texts, release, row_key, signed, span_hashes, texts, unpack_text
from matchspark.session import cut_lineage

LENGTH, GRAM = 200, 32
SPREAD = LENGTH - GRAM + 1
MULTIPLIERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
PART = 1 << 19
#: Different segments of an anchor up to which one array takes them all, and bytes per suffix array on average.
HOT_SEGMENTS, ARRAY_BYTES = 1024, 512 << 10
#: Strings compared across arrays at a time, on average.
BUCKET_STRINGS = 500_000
#: A byte that UTF-8 never holds.
SEPARATOR = 0xFF


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, number of strings, anchor hash and content hash of every segment."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    gram = data.astype(U64) + U64(1)
    for i, m in enumerate(MULTIPLIERS):
        gram = gram[:-(1 << i)] * U64(m) + gram[1 << i:]
    low = (mix(gram) & ~U64(0xFFFFFFFF)) | np.arange(len(gram), dtype=U64)
    span = 1
    while span < SPREAD:
        step = min(span, SPREAD - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(low)]
    at = np.flatnonzero(np.arange(len(low)) + LENGTH <= offsets[row + 1])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    row, low = row[at], low[at]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    anchor = mix(gram[(low[first] & U64(0xFFFFFFFF)).astype(np.int64)] ^ U64(0x5851F42D4C957F2D))
    return row[first], start - offsets[row[first]], count, signed(anchor), signed(span_hashes(data, start, start + count - 1 + LENGTH))


def sorted_suffixes(at: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes that start there, compared by ``depth`` bytes, eight at a time."""
    key = packed[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied = np.append(False, key[1:] == key[:-1])
    for step in range(8, depth, 8):
        member = tied.copy()
        member[:-1] |= tied[1:]
        place = np.flatnonzero(member)
        if not len(place):
            break
        group = np.cumsum(~tied[place])
        key = packed[at[place] + step]
        order = np.lexsort((key, group))
        at[place], key, group = at[place][order], key[order], group[order]
        tied[place] = np.append(False, (key[1:] == key[:-1]) & (group[1:] == group[:-1]))
    return at


def suffix_array(data: np.ndarray, packed: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes in order (by ``depth`` bytes at least), by two-stage sorting."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    step = np.append(np.sign(data[1:].astype(np.int16) - data[:-1]), -1)
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    rising = step[nearest] > 0
    direct = sorted_suffixes(np.flatnonzero(rising), packed, depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = waiting[c]
        level = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts = [level]
        while len(level):
            level = level[level > 0] - 1
            level = level[data[level] == c]
            parts.append(level)
        parts.append(direct[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        letter = data[before]
        before, letter = before[letter > c], letter[letter > c]
        if len(before):
            order = np.argsort(letter, kind="stable")
            before, letter = before[order], letter[order]
            cut = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            for part in np.split(before, cut):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, packed: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the next in order, in whole steps of eight bytes up to ``depth``."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for step in range(0, depth, 8):
        alive = alive[packed[a[alive] + step] == packed[b[alive] + step]]
        if not len(alive):
            break
        out[alive] = step + 8
    return out


def repeated_starts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Part and offset of every string of LENGTH bytes that starts at more than one place in ``parts``."""
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), np.uint8)
    packed = eight_bytes(np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)]))
    order = suffix_array(data, packed)
    shared = np.flatnonzero(common_prefixes(order, packed) >= LENGTH)
    found = np.zeros(len(data), bool)
    found[order[shared]] = found[order[shared + 1]] = True
    at = np.flatnonzero(found)
    part = np.searchsorted(begin, at, "right") - 1
    inside = at - begin[part] + LENGTH <= size[part]
    return part[inside], (at - begin[part])[inside]


def segment_table(docs: DataFrame) -> DataFrame:
    """Rows ``doc, loc, anchor, segment`` of every segment, and one row per document with doc, doc_id and rk.

    ``doc`` numbers the rows of this one evaluation; ``loc`` is the start times 256 plus the number of strings.
    """
    names = ["doc", "doc_id", "rk", "loc", "anchor", "segment"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), PART):
                ids = number + np.arange(hi - lo)
                number += hi - lo
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), none, none, none], names)
                row, start, count, anchor, content = segments(data, offsets)
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), none, none, pa.array(start << 8 | count), pa.array(anchor), pa.array(content)], names)

    return docs.select("doc_id", "text", "rk").mapInArrow(run, ", ".join(f"{n} long" for n in names))


PIECES = pa.schema([("array", pa.int64()), ("doc", pa.int64()), ("loc", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("raw", pa.binary())])


@lean
def member_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``packed, doc, need``: the bytes of each needed segment."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for packed, doc, need in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = unpack_text(packed)
            for m in need:
                begin = m["loc"] >> 8
                out.append((m["array"], doc, m["loc"], m["n"], m["hot"], raw[begin:begin + (m["loc"] & 255) - 1 + LENGTH]))
                size += len(out[-1][5])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECES.types)], schema=PIECES)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECES.types)], schema=PIECES)


FOUND = "doc long, begin long, end long, bucket long, strings binary"
STRING = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("n", "<i8"), ("doc", "<i8"), ("begin", "<i8")])


def sorted_repeats(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Repeated strings of the segments of one suffix array, as far as they occur once as a whole: doc, begin, end.

    Of hot anchors also every string by its hashes, packed by bucket: those found once, and one of each of the others with n = 2.
    """
    raw = list(group["raw"])
    part, at = repeated_starts(raw)
    single = group["n"].to_numpy() == 1
    base, doc = group["loc"].to_numpy(np.int64) >> 8, group["doc"].to_numpy(np.int64)
    p, x = part[single[part]], at[single[part]]
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (x[1:] != x[:-1] + 1))) if len(p) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    spans = pd.DataFrame({"doc": doc[p[first]], "begin": base[p[first]] + x[first], "end": base[p[first]] + x[last] + LENGTH, "bucket": None, "strings": None})
    hot = group["hot"].to_numpy(bool)
    if not hot.any():
        return spans
    size = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(size) - size
    count = np.where(hot, size - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(raw)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = begin[owner] + offset
    repeated = np.zeros(len(data) + 1, bool)
    repeated[begin[part] + at] = True
    once = single[owner] & ~repeated[start]
    strings = np.zeros(len(start), STRING)
    strings["h1"] = signed(span_hashes(data, start, start + LENGTH))
    strings["h2"] = signed(span_hashes(np.ascontiguousarray(data[::-1]), len(data) - start - LENGTH, len(data) - start))
    strings["n"], strings["doc"], strings["begin"] = np.where(once, 1, 2), doc[owner], base[owner] + offset
    often = strings[~once]
    strings = np.concatenate([strings[once], often[np.unique(often[["h1", "h2"]], return_index=True)[1]]])
    bucket = strings["h1"] % buckets
    order = np.argsort(bucket, kind="stable")
    strings, bucket = strings[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    packed = [x.tobytes() for x in np.split(strings, cut[1:])] if len(bucket) else []
    return pd.concat([spans, pd.DataFrame({"doc": None, "begin": None, "end": None, "bucket": bucket[cut], "strings": packed})])


def across_arrays(group: pd.DataFrame) -> pd.DataFrame:
    """Strings of one bucket that their own array holds once and another array holds too."""
    strings = np.concatenate([np.frombuffer(x, STRING) for x in group["strings"]])
    _, at = np.unique(strings[["h1", "h2"]], return_inverse=True)
    own = strings[(strings["n"] == 1) & (np.bincount(at, strings["n"])[at] > 1)]
    return pd.DataFrame({"doc": own["doc"], "begin": own["begin"], "end": own["begin"] + LENGTH})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, rk and spans (array of begin, end in bytes, not merged) of every document of ``docs`` (doc_id, text, rk) with repeats."""
    table = cut_lineage(segment_table(docs))
    own = table.where(F.col("anchor").isNull()).select("doc", "doc_id", "rk")
    found = table.where(F.col("anchor").isNotNull()).select("doc", "loc", "anchor", "segment")
    anchors = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"))
    found = cut_lineage(found.join(anchors, "anchor"))
    pairs = cut_lineage(found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min_by("loc", "doc").alias("loc")))
    whole = pairs.where("n > 1").select("anchor", "segment")
    begin = F.shiftright("loc", 8)
    spans = found.join(whole, ["anchor", "segment"], "left_semi").select("doc", begin.alias("begin"), (begin + F.col("loc").bitwiseAND(255) - 1 + LENGTH).alias("end"))
    kinds = pairs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    members = cut_lineage(pairs.join(kinds, "anchor").select("anchor", "doc", "loc", "n", "kinds"))
    arrays = max(1, members.count() * 300 // ARRAY_BYTES)
    share = F.pmod(F.xxhash64("doc", "loc"), F.ceil(F.col("kinds") / HOT_SEGMENTS))  # 0 for all segments of most anchors
    place = F.pmod(F.xxhash64("anchor", share), F.lit(arrays)).alias("array")
    need = members.groupBy("doc").agg(F.collect_list(F.struct("loc", "n", (F.col("kinds") > HOT_SEGMENTS).alias("hot"), place)).alias("need"))  # a document's own segments
    need = need.join(own, "doc").select("doc", F.col("doc_id").alias("id"), F.col("rk").alias("key"), "need")
    joined = packed_texts(docs).join(need, (F.col("rk") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("packed", "doc", "need")
    pieces = joined.mapInArrow(member_pieces, "array long, doc long, loc long, n long, hot boolean, raw binary")
    buckets = 16 + members.where(F.col("kinds") > HOT_SEGMENTS).count() * 100 // BUCKET_STRINGS
    result = cut_lineage(pieces.groupBy("array").applyInPandas(lean_group(lambda g: sorted_repeats(g, buckets)), FOUND))
    across = result.where(F.col("strings").isNotNull()).select("bucket", "strings").groupBy("bucket").applyInPandas(lean_group(across_arrays), "doc long, begin long, end long")
    every = spans.unionByName(result.where(F.col("strings").isNull()).select("doc", "begin", "end")).unionByName(across)
    joint = F.array_sort(F.collect_list(F.struct("begin", "end")))
    lists = every.groupBy("doc").agg(joint.alias("spans")).join(own, "doc")
    return lists.groupBy("doc_id", "rk").agg(F.first("spans").alias("spans"))  # rows written twice have equal spans


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted({(s["begin"], s["end"]) for s in ([] if spans is None else spans)}):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


@pandas_udf(StringType())
def cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans; a character of which a part was cut goes too. Texts without spans stay as they are."""
    out = pd.Series([t if t is None or s is None else without(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(text, spans)])
    release()
    return out


def suffix_dedup(df: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if asked for).

    Texts are UTF-8 bytes; strings never cross documents and are judged on the input. A string that repeats within one
    document counts, overlapping or not; a row written twice repeats itself. Null texts are empty. Texts under LENGTH
    bytes stay whole. Null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    docs = row_key(texts(df, id_col, text_col))
    spans = cut_lineage(repeated_spans(docs).withColumnsRenamed({"doc_id": "id", "rk": "key"}))
    joined = packed_texts(docs).join(spans, (F.col("rk") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "packed", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:6 if with_text else 5]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for doc, packed, found in zip(*(c.to_pylist() for c in part.columns)):
                    raw, own = unpack_text(packed), merged(found)
                    kept = without(raw, own)
                    out.append((doc, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept)[:len(names)])
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.mapInArrow(run, schema)

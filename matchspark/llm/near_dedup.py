"""Near-duplicates by SetSketch registers, banding, joint likelihood and verification on full sets.

A document is the set of its word shingles. Its sketch holds, for each register, the smallest of exponentially distributed
values of the shingles, on a logarithmic scale of base B; registers of a union are the maxima, so sketches merge. Equal
sets are one class from the start. Classes that agree in a band of registers share a bucket. Every bucket names a leader;
members are compared with it first by the likelihood of both sketches, then on full sets. Buckets that still hold more
than one component compare the members outside their largest component with all the others, in blocks, so nothing depends
on the choice of leaders and no pairs of a group are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import U64, byte_slices, lean, lean_group, lower_bytes, mix, row_key, signed, sized, span_hashes, texts, word_spans
from matchspark.session import cut_lineage

#: Registers, registers in a band, bands. At similarity 0.8 a pair shares no band with probability 3e-6.
REGISTERS, BAND, BANDS = 256, 6, 42
B = 1.001
ZERO = 20_000
#: Points are drawn up to where a register stays empty with probability exp(-REACH) over the number of registers.
REACH = 6.0
#: Six standard deviations of the estimate at 0.8; pairs estimated lower are not verified.
MARGIN = 0.15
PART = 1 << 18
#: Sets compared at a time on either side, and distinct items at a time.
BLOCK, COLUMNS = 512, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every distinct shingle of each (lower-cased) row, ordered by row and hash."""
    start, end, row = word_spans(data, offsets)
    word = mix(span_hashes(data, start, end))
    n = np.bincount(row, minlength=len(offsets) - 1)
    length = np.minimum(n[row], width)  # words of the shingle that begins here
    left = np.cumsum(n)[row] - np.arange(len(row)) if len(row) else np.zeros(0, np.int64)
    whole = left >= length
    at = np.flatnonzero(whole)
    value = length[at].astype(U64)
    for step in range(width):
        own = length[at] > step
        value[own] = mix(value[own] * U64(0x9E3779B97F4A7C15) + word[at[own] + step])
    row = row[at]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
    return row[first], value[first]


def set_sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Registers (rows, REGISTERS) as uint16. Each element is a Poisson process whose points fall on random registers."""
    least = np.full(rows * REGISTERS, np.inf)
    n = np.bincount(row, minlength=rows)
    limit = ((np.log(REGISTERS) + REACH) / np.maximum(n, 1))[row]
    x, r = np.zeros(len(row)), 0
    while len(row):
        r += 1
        random = mix(value + U64((r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((random >> U64(11)).astype(float) + 0.5) * 2.0 ** -53) / REGISTERS
        on = x <= limit
        row, value, limit, x = row[on], value[on], limit[on], x[on]
        np.minimum.at(least, row * REGISTERS + (random[on] & U64(REGISTERS - 1)).astype(np.int64), x)
    with np.errstate(divide="ignore"):
        scale = np.floor(ZERO + 1 - np.log(least) / np.log(B))
    return np.clip(np.nan_to_num(scale, posinf=65535, neginf=0), 0, 65535).astype(np.uint16).reshape(rows, REGISTERS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key per band (rows, BANDS)."""
    part = sketch[:, :BAND * BANDS].reshape(len(sketch), BANDS, BAND).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) << U64(32), part.shape[:2])
    for i in range(BAND):
        key = mix(key + part[:, :, i] + U64(0x632BE59BD9B4E019))
    return key


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes two sketches most likely, given both set sizes (rows of registers)."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    ceiling = np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high, ratio = np.zeros(len(u)), ceiling.copy(), (5 ** 0.5 - 1) / 2
    for _ in range(30):
        p, q = high - ratio * (high - low), low + ratio * (high - low)
        left = fit(p) > fit(q)
        low, high = np.where(left, low, p), np.where(left, q, high)
    return (low + high) / 2


def sketch_table(docs: DataFrame, width: int) -> DataFrame:
    """doc (a number of this one evaluation), doc_id, rk, n, s1, s2 (hashes of the set) and sketch (null where empty)."""
    names = ["doc", "doc_id", "rk", "n", "s1", "s2", "sketch"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), PART):
                rows = hi - lo
                row, value = shingle_sets(lower_bytes(data), offsets, width)
                n = np.bincount(row, minlength=rows)
                sums = np.zeros((2, rows), U64)
                some = np.flatnonzero(n)
                if len(some):
                    at = (np.cumsum(n) - n)[some]
                    sums[0, some], sums[1, some] = np.add.reduceat(mix(value), at), np.add.reduceat(mix(value ^ U64(0x2545F4914F6CDD1D)), at)
                sketch = set_sketches(row, value, rows)
                ids = number + np.arange(rows)
                number += rows
                columns = [pa.array(ids), batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(n), pa.array(signed(sums[0])), pa.array(signed(sums[1]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() if k else None for s, k in zip(sketch, n.tolist())], pa.binary())], names)

    return docs.select("doc_id", "text", "rk").mapInArrow(run, "doc long, doc_id long, rk long, n long, s1 long, s2 long, sketch binary")


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bucket_rows(sketches: DataFrame) -> DataFrame:
    """key, rep, n: every class in the bucket of each of its bands."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rep, n = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(band_keys(registers(batch.column(2))).ravel())), pa.array(rep), pa.array(n)], ["key", "rep", "n"])

    return sketches.select("rep", "n", "sketch").mapInArrow(run, "key long, rep long, n long")


def near_sizes(a: str, b: str, percent: int):
    """Whether two set sizes allow the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate comes near the threshold, with it."""
    total = pairs.count()
    nodes = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    near = cut_lineage(sketches.join(sized(nodes, 2 * total, 16), "rep", "left_semi").select("rep", "n", "sketch"))
    one = near.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = near.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                j = likely_similarity(registers(part.column(4)), registers(part.column(5)), part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float))
                on = pa.array(j >= percent / 100 - MARGIN)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(on), part.column(1).filter(on), pa.array(j).filter(on)], ["a", "b", "likely"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return cut_lineage(both.mapInArrow(run, "a long, b long, likely double"))


def full_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, total: int, width: int) -> DataFrame:
    """rep and its whole set (sorted hashes) for the classes in ``nodes`` (column rep)."""
    keys = reps.join(sized(nodes, total, 16), "rep", "left_semi").select("rep", F.col("doc_id").alias("id"), F.col("rk").alias("own"))
    joined = docs.join(sized(keys, total, 40), (F.col("rk") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), PART):
                row, value = shingle_sets(lower_bytes(data), offsets, width)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["rep", "items"])

    return cut_lineage(joined.mapInArrow(run, "rep long, items binary").dropDuplicates(["rep"]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                on.append(100 * common >= percent * (len(x) + len(y) - common))
            on = pa.array(on, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], ["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """rep and label (the smallest rep reachable) of every end of ``edges`` (a, b): least labels, then labels of labels."""
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "rep"))
    while True:
        near = both.join(labels.select(F.col("rep").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["rep"] == near["u"]).select("rep", "label", F.least("label", "least").alias("low"))
        jump = labels.select(F.col("rep").alias("low"), F.col("label").alias("lower"))
        after = cut_lineage(step.join(jump, "low", "left").select("rep", F.least("low", "lower").alias("new"), F.col("label").alias("old")))
        changed = after.where("new <> old").limit(1).count()
        labels = after.select("rep", F.col("new").alias("label"))
        if not changed:
            return labels


def labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column``: its label, or itself."""
    own = labels.select(F.col("rep").alias(column), F.col("label").alias("found"))
    return rows.join(own, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    return labelled(labelled(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select(*pairs.columns)


def near_components(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept and rk (see ``row_key``).

    Words are separated by ASCII white space, A-Z lower-cased; shingles have ``width`` words, or all words of a shorter
    text. Documents are linked when 100 * intersection >= ``percent`` * union of their sets; the component's id is its
    smallest doc_id and ``kept`` marks the rows with that id. Null texts and texts without words have empty sets, are
    linked with nothing and kept. Null ids count only where a component has no other; other columns are ignored;
    repeated rows are linked like any equal rows. An empty table gives an empty result.
    """
    docs = row_key(texts(df, id_col, text_col))
    table = cut_lineage(sketch_table(docs, width))
    classes = table.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.min("doc_id").alias("least"))
    classes = cut_lineage(classes)
    total = classes.count()
    reps = table.join(sized(classes.select(F.col("rep").alias("doc")), total, 16), "doc", "left_semi").withColumnRenamed("doc", "rep")
    buckets = bucket_rows(reps)
    leaders = cut_lineage(buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("nl"), F.count("*").alias("size")).where("size > 1"))
    full = cut_lineage(buckets.join(sized(leaders, leaders.count(), 40), "key"))
    pairs = cut_lineage(full.where(F.col("rep") != F.col("leader")).where(near_sizes("n", "nl", percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    likely = estimated(pairs, reps, percent)
    nodes = cut_lineage(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct())
    sets = full_sets(docs, reps, nodes, nodes.count(), width)
    best = cut_lineage(likely.groupBy("b").agg(F.max_by("a", "likely").alias("a")).select("a", "b"))
    edges = verified(best, sets, percent)
    labels = components(edges)
    rest = cut_lineage(apart(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), labels))
    if rest.limit(1).count():
        edges = edges.union(verified(rest, sets, percent))
        labels = components(edges)
    more = crossing_links(full, labels, percent, lambda nodes: full_sets(docs, reps, nodes, nodes.count(), width))
    if more.limit(1).count():
        labels = components(edges.union(more))
    named = labelled(classes, labels, "rep", "label")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("s1", "s2", "component_id")
    out = table.select("doc_id", "rk", "n", "s1", "s2").join(sized(named, total, 40), ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "rk")


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the outsiders (side 1) and the members (side 0) of one block, as few as connect the same components."""
    a, b = group[group["side"] == 1], group[group["side"] == 0]
    sets = [[np.frombuffer(x, U64) for x in part["items"]] for part in (a, b)]
    size = [np.array([len(x) for x in part], np.int64) for part in sets]
    flat = [np.concatenate(part) if part else np.zeros(0, U64) for part in sets]
    shared = np.intersect1d(*flat)
    owner, code = [], []
    for items, n in zip(flat, size):
        at = np.searchsorted(shared, items)
        on = shared[np.minimum(at, max(0, len(shared) - 1))] == items if len(shared) else np.zeros(len(items), bool)
        order = np.argsort(at[on], kind="stable")
        owner.append(np.repeat(np.arange(len(n)), n)[on][order])
        code.append(at[on][order])
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        wide = []
        for who, what, n in zip(owner, code, size):
            i, j = np.searchsorted(what, [low, low + COLUMNS])
            wide.append(np.zeros((len(n), COLUMNS), np.float32))
            wide[-1][who[i:j], what[i:j] - low] = 1
        common += wide[0] @ wide[1].T
    la, lb = a["label"].to_numpy(np.int64), b["label"].to_numpy(np.int64)
    union = size[0][:, None] + size[1][None, :] - common
    x, y = np.nonzero((100 * common >= percent * union) & (la[:, None] != lb[None, :]))
    pair = np.unique(np.stack([np.minimum(la[x], lb[y]), np.maximum(la[x], lb[y])]), axis=1, return_index=True)[1] if len(x) else np.zeros(0, np.int64)
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.get(k, k) != k:
            k = root[k]
        return k

    kept = []
    for k in pair:
        p, q = find(int(la[x[k]])), find(int(lb[y[k]]))
        if p != q:
            root[p] = q
            kept.append(k)
    return pd.DataFrame({"a": a["rep"].to_numpy(np.int64)[x[kept]], "b": b["rep"].to_numpy(np.int64)[y[kept]]})


def crossing_links(full: DataFrame, labels: DataFrame, percent: int, sets_of) -> DataFrame:
    """Links between different components that share a bucket, as few as connect them.

    The buckets whose largest component is the same go together: the classes outside it are compared on full sets with
    all classes of these buckets, in blocks of about BLOCK by BLOCK, so a task holds two blocks whatever the group's size.
    """
    rows = labelled(full.select("key", "rep"), labels, "rep", "label")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("key").agg(F.max_by("label", "members").alias("main"), F.count("*").alias("parts"), F.sum("members").alias("members")).where("parts > 1 and members > 2")
    flat = cut_lineage(rows.join(mixed.select("key", "main"), "key").select("main", "rep", "label").distinct())
    sizes = flat.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count(F.when(F.col("label") != F.col("main"), 1)) / BLOCK).alias("outer"))
    flat = flat.join(sizes, "main")
    inner, outer = F.pmod(F.xxhash64("rep"), "blocks"), F.pmod(F.xxhash64("rep", F.lit(1)), "outer")
    members = flat.select("main", "rep", "label", F.lit(0).alias("side"), inner.alias("block"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("by"))
    outside = flat.where("label <> main").select("main", "rep", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), outer.alias("by"))
    sets = sets_of(flat.select("rep").distinct())
    dealt = members.unionByName(outside).join(sets, "rep").select("main", "block", "by", "side", "rep", "label", "items")
    return cut_lineage(dealt.groupBy("main", "block", "by").applyInPandas(lean_group(lambda g: block_links(g, percent)), "a long, b long"))

"""Frequent phrases (collocations) by Rabin-Karp fingerprints.

Prefix polynomials over the lower-cased words, one space between, give the fingerprint of every run of words at once. A
shuffle adds up fingerprints; each keeps a pointer to one occurrence and the range of a second, independent fingerprint. Runs
of words are only sent where all shorter runs in them can still be frequent: words first, then pairs of frequent words, then
longer runs of frequent pairs. A fingerprint whose second fingerprints differ stands for several phrases; these are counted
again by their text. Only frequent phrases are turned into text, by their pointers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import BASE, BASE_INVERSE, U64, ascii_lower, byte_slices, lean, mix, powers, signed, sized
from matchspark.session import cut_lineage

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
#: Base of the second fingerprint.
OTHER = 0xC2B2AE3D27D4EB4F
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)
#: Runs of words that a task sums up at a time, and words that are hashed at a time.
CHUNK, PART = 1 << 20, 1 << 17
#: Frequent fingerprints that are broadcast (32 MB) to leave out hopeless runs; beyond that all runs are shuffled.
MAX_KEYS = 1 << 22
#: Bits of a fingerprint; fewer only in tests, to make phrases collide.
BITS = 64
#: The number of words of a language is summed under this as a run of no words.
TOTAL = 0x5851F42D4C957F2D
COLUMNS = "fp long, n int, copies long, low int, high int, rk long, at int"


@dataclass
class Words:
    """The words of some rows: the bytes with one space after each word, where words start and end in it, their row, piece and place in the row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    at: np.ndarray

    def parts(self, longest: int) -> Iterator[tuple[Words, int]]:
        """Cuts of PART words, each followed by the words that its last runs need, and how many runs of a size begin in it."""
        for a in range(0, len(self.start), PART):
            cut = slice(a, a + PART + longest - 1)
            first, end = self.start[cut], self.end[cut]
            view = Words(self.data[first[0]:end[-1]], first - first[0], end - first[0], self.row[cut], self.piece[cut], self.at[cut])
            yield view, min(PART, len(self.start) - a)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of lower-cased rows; a piece ends at its row's end and at any of ``.,;:!?`` and line breaks."""
    solid = ~GAP[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    keep = solid.copy()
    after = end[end < len(data)]
    keep[after] = True
    gap = np.append(~solid, False)[end]  # a word at the end of its row may have none
    packed = data[keep]
    packed[~solid[keep]] = 0x20
    size = end - start
    first = np.cumsum(size + gap) - size - gap
    return Words(packed, first, first + size, row, np.cumsum(BREAK[data])[start] + row, start - offsets[row])


def polynomial(data: np.ndarray, base: int, inverse: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes times powers of ``base``, and the powers that move a difference of two to place 0."""
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data)), out=prefix[1:])
    return prefix, powers(inverse, len(data) + 1)


def prints(poly: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Fingerprints of spans; ``salt`` tells languages apart."""
    prefix, back = poly
    return mix(((prefix[end] - prefix[start]) * back[start] + (end - start).astype(U64) * U64(TOTAL)) ^ salt)


def fingerprint(poly, start, end, salt) -> np.ndarray:
    return prints(poly, start, end, salt) >> U64(64 - BITS)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys


def summed(parts: list[tuple]) -> pa.RecordBatch:
    """One row a fingerprint: copies, and where pointers are given the range of the second fingerprint and a pointer."""
    names, n = [c.split()[0] for c in COLUMNS.split(", ")], parts[0][0]
    fp, copies = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    columns = [pa.array(signed(fp[first])), pa.array(np.full(len(first), n, np.int32)), pa.array(np.add.reduceat(copies[order], first))]
    if len(parts[0]) == 3:
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(first), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names)
    other, rk, at = (np.concatenate([x[i] for x in parts]) for i in (3, 4, 5))
    other, own = other[order], order[first]
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, (np.minimum.reduceat(other, first), np.maximum.reduceat(other, first), rk[own], at[own]))], names)


def runs(words: Words, own: int, sizes: range, known: np.ndarray | None, inner: int, salt: np.ndarray, poly) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the first words of its runs, below ``own``, and their fingerprints; all runs of ``inner`` words in them are in ``known``."""
    able = None
    if known is not None:
        k = len(words.start) - inner + 1
        able = among(fingerprint(poly, words.start[:max(k, 0)], words.end[inner - 1:], salt[words.row[:max(k, 0)]]), known)
    for n in sizes:
        k = min(own, len(words.start) - n + 1)
        if k <= 0:
            return
        good = words.piece[:k] == words.piece[n - 1:n - 1 + k]
        for j in range(n - inner + 1 if able is not None else 0):
            good &= able[j:j + k]
        i = np.flatnonzero(good)
        yield n, i, fingerprint(poly, words.start[i], words.end[i + n - 1], salt[words.row[i]])


def counted(docs: DataFrame, sizes: range, known: DataFrame | None, inner: int, pointed: bool) -> DataFrame:
    """Fingerprints of runs of words summed over the table: fp, n (words), copies, low, high, rk, at.

    Runs of ``sizes`` words are counted where all their runs of ``inner`` words are in ``known``; they have a pointer (rk,
    at) and the range of second fingerprints if ``pointed``. The runs of ``inner`` words in ``known`` are counted again,
    with pointers. Without ``known``, the words of each language are counted as a run of none.
    """
    held, first_step = key_array(known), known is None
    again = range(0) if first_step else range(inner, inner + 1)

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, keys = defaultdict(list), 0, held.value if held else None
        for batch in batches:
            rk, salts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in byte_slices(batch.column(2)):
                words, salt = words_of(data, offsets), salts[lo:hi].astype(U64)
                for view, own in words.parts(max([inner, *sizes])):
                    poly = polynomial(view.data, BASE, BASE_INVERSE)
                    other = polynomial(view.data, OTHER, OTHER_INVERSE) if pointed or again else None
                    for n, i, fp in [*runs(view, own, again, keys, inner, salt, poly), *runs(view, own, sizes, keys, inner, salt, poly)]:
                        if not len(i):
                            continue
                        part = (n, fp, np.ones(len(i), np.int64))
                        if pointed or n in again:
                            second = (prints(other, view.start[i], view.end[i + n - 1], salt[view.row[i]]) >> U64(33)).astype(np.int32)
                            part += (second, rk[lo + view.row[i]], view.at[i].astype(np.int32))
                        parts[n].append(part)
                        rows += len(i)
                if first_step and len(words.row):
                    there, copies = np.unique(words.row, return_counts=True)
                    none = np.zeros(len(there), np.int32)
                    parts[0].append((0, mix(salt[there] ^ U64(TOTAL)), copies, none, rk[lo + there], none))
                    rows += len(there)
                if rows >= CHUNK:
                    yield from map(summed, parts.values())
                    parts, rows = defaultdict(list), 0
        yield from map(summed, parts.values())

    pointer = [F.first(c, ignorenulls=True).alias(c) for c in ("rk", "at")]  # rows hold both or none
    found = docs.select("rk", "salt", "text").mapInArrow(emit, COLUMNS)
    return found.groupBy("fp", "n").agg(F.sum("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"), *pointer)


def key_array(known: DataFrame | None):
    """The fingerprints of ``known`` as a broadcast sorted array, or None where they are too many."""
    if known is None or known.count() > MAX_KEYS:
        return None
    keys = known.select("fp").toArrow().column(0).to_numpy()
    return known.sparkSession.sparkContext.broadcast(np.sort(keys.astype(np.int64).view(U64)))


def materialised(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, phrase, n, copies of each fingerprint of ``frequent``, read at its pointer."""
    rows = frequent.count()
    pointers = frequent.groupBy("rk").agg(F.collect_list(F.struct("at", "n", "fp", "copies")).alias("runs"))  # at most the runs of one text
    there = docs.join(sized(frequent.select("rk").distinct(), rows, 16), "rk", "left_semi")
    once = there.groupBy("rk").agg(*[F.first(c).alias(c) for c in ("lang", "salt", "text")])  # copies of a text are alike
    names = ["lang", "phrase", "n", "copies", "fp"]

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, salt, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                cut = []
                for x in found:
                    words, at = [], x["at"]
                    for _ in range(x["n"]):
                        m = WORD.search(raw, at)
                        if not m:
                            break
                        words.append(m[0])
                        at = m.end()
                    cut.append(b" ".join(words))
                size = np.array([len(x) for x in cut])
                end = np.cumsum(size)
                fp = fingerprint(polynomial(np.frombuffer(b"".join(cut), np.uint8), BASE, BASE_INVERSE), end - size, end, np.full(len(cut), salt).astype(U64))
                # another text of the same key holds other words at the pointer
                out += [(lang, c.decode(), x["n"], x["copies"], x["fp"]) for x, c, h in zip(found, cut, signed(fp).tolist()) if x["n"] == 0 or h == x["fp"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names)

    joined = once.join(sized(pointers, rows, 64), "rk").select("lang", "salt", "text", "runs")
    return joined.mapInArrow(read, "lang string, phrase string, n int, copies long, fp long").dropDuplicates(["fp", "n"]).drop("fp")


def by_text(docs: DataFrame, sizes: range, doubtful: DataFrame) -> DataFrame:
    """lang, phrase, n, copies of all runs with a fingerprint and size of ``doubtful``, counted by their text."""
    held = key_array(doubtful)

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in byte_slices(batch.column(2)):
                words, salt = words_of(data, offsets), salts[lo:hi].astype(U64)
                langs = batch.column(0).slice(lo, hi - lo)
                for view, own in words.parts(max(sizes)):
                    whole = view.data.tobytes()
                    for n, i, fp in runs(view, own, sizes, None, 1, salt, polynomial(view.data, BASE, BASE_INVERSE)):
                        if held:
                            hit = among(fp, held.value)
                            i, fp = i[hit], fp[hit]
                        text = [whole[a:b].decode() for a, b in zip(view.start[i].tolist(), view.end[i + n - 1].tolist())]
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(view.row[i])), pa.array(text, pa.string()), pa.array(np.full(len(i), n, np.int32)), pa.array(signed(fp))], ["lang", "phrase", "n", "fp"])

    found = docs.select("lang", "salt", "text").mapInArrow(emit, "lang string, phrase string, n int, fp long")
    return found.join(doubtful.select("fp", "n"), ["fp", "n"], "left_semi").groupBy("lang", "phrase", "n").agg(F.count("*").alias("copies"))


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, n (its words), copies of all phrases of 1 to ``longest`` words with at least ``least`` copies.

    ``docs`` has lang, salt, text (lower-cased) and rk. The row with n = 0 has the number of all words of its language.
    """
    known, out = None, None
    # each step counts longer runs, and points at the frequent ones of the step before
    for sizes, inner, pointed in ((range(1, 2), 1, False), (range(2, min(longest, 2) + 1), 1, False), (range(3, longest + 1), 2, True)):
        if inner > longest:
            break
        found = cut_lineage(counted(docs, sizes, known, inner, pointed).where((F.col("copies") >= least) | (F.col("n") == 0)))
        known = found.where(F.col("n") == sizes.start)
        whole = found.where("rk IS NOT NULL")
        doubt = (F.col("low") != F.col("high")) & (F.col("n") > 0)
        phrases = materialised(docs, whole.where(~doubt))
        doubtful = whole.where(doubt)
        if not doubtful.isEmpty():
            phrases = phrases.unionByName(by_text(docs, range(inner, longest + 1), doubtful).where(F.col("copies") >= least))
        out = phrases if out is None else out.unionByName(phrases)
    return cut_lineage(out)


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line breaks and into words at spaces and tabs. Candidates
    have 2 to ``longest`` words and a >= ``least`` occurrences inside pieces. Of the cuts into a first part (l occurrences) and
    a rest (r), the one with the lowest floor(1000 * a * n / (l * r)) counts, ties to the shortest first part; n is the number
    of words of the language. A candidate inside a longer one with at least ``percent`` % of its occurrences is left out. Ranks
    go by score, then a, then the phrase's bytes. Null and empty texts hold no words; a null language is ``und``; rows written
    more than once count each time; other columns are ignored. A language without candidates, and an empty table, give no rows.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    docs = docs.withColumn("salt", F.xxhash64("lang")).withColumn("rk", F.xxhash64("lang", "text"))
    all_phrases = frequent_phrases(docs, least, longest)
    total = all_phrases.where("n = 0").select("lang", F.col("copies").alias("n"))
    phrases = all_phrases.where("n > 0").withColumnRenamed("n", "size")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("copies").alias("a"), F.split("phrase", " ").alias("words"))

    longer = candidates.where("size > 2").select(
        "lang", F.col("a").alias("outer"), F.explode(F.array(F.expr("array_join(slice(words, 1, size - 1), ' ')"), F.expr("array_join(slice(words, 2, size - 1), ' ')"))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))  # a run one word longer has no fewer occurrences than one longer still
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("outer") < percent * F.col("a"), F.lit(True))).drop("outer")

    cuts = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"),
    )
    head = phrases.select("lang", F.col("phrase").alias("head"), F.col("copies").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("copies").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"]).join(total, "lang")
    scored = scored.withColumns({"up": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Language-model scores by prediction by partial matching over bytes, beside a unigram baseline over words.

The model is a trie of byte contexts up to ORDER symbols long, counted over all training texts. A symbol is coded in the
longest context that is known; where it is new there, an escape (half a count for every distinct follower) leads
to the next shorter context, in which the symbols of the longer one are excluded. What is excluded follows from the
longer context alone, so all terms are fixed once the counts are known: the score of a (context, symbol) is worked out once
per distinct one, by joins from level to level. Texts look up the frequent ones in a table and are joined with the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import U64, byte_slices, lower_bytes, signed, span_hashes, texts, word_spans
from matchspark.session import cut_lineage

#: Context length, bits per symbol (0: before the text, 1-256: bytes, 257: end), symbols.
ORDER, BITS, SYMBOLS = 5, 9, 257
#: Grams whose scores and words whose counts are broadcast; the rest of both are joined.
MAX_GRAMS, MAX_WORDS = 1 << 20, 1 << 20
GRAM, WORD, TEXT = 0, 1, 2
PART = 1 << 20
MASK = (1 << BITS) - 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every byte and of the end of each row, and the row of each."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    first = offsets[:-1] + np.arange(rows) * (ORDER + 1)
    symbol = np.zeros(len(data) + rows * (ORDER + 1), np.int64)
    row = np.repeat(np.arange(rows), size + 1)
    place = np.arange(len(row)) + (row + 1) * ORDER
    symbol[first + ORDER + size] = SYMBOLS
    text = np.ones(len(row), bool)
    text[np.cumsum(size + 1) - 1] = False
    symbol[place[text]] = data.astype(np.int64) + 1
    key = np.zeros(len(row), np.int64)
    for back in range(ORDER, -1, -1):
        key = key << BITS | symbol[place - back]
    return key, row


class Tally:
    """Counts of 64-bit keys, merged now and then so that memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.parts.append((own, n))
        self.waiting += len(own)
        if self.waiting > 1 << 20:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.parts]])
        counts = np.concatenate([self.counts, *[n for _, n in self.parts]])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.keys)).astype(np.int64)
        self.parts, self.waiting = [], 0


def count_texts(docs: DataFrame) -> DataFrame:
    """kind, key, n, uses: grams, word hashes and the number of texts (key 0), ``n`` in training texts; ``uses`` of grams also counts held-out ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, n = [(GRAM, 1, Tally()), (GRAM, 0, Tally()), (WORD, 1, Tally())], 0
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(0), PART):
                data = lower_bytes(data)
                train = ~np.asarray(batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool)
                key, row = grams(data, offsets)
                tallies[0][2].add(key[train[row]])
                tallies[1][2].add(key[~train[row]])
                start, end, row = word_spans(data, offsets)
                tallies[2][2].add(signed(span_hashes(data, start, end))[train[row]])
                n += int(train.sum())
        for kind, learnt, tally in tallies:
            tally.merge()
            for i in range(0, len(tally.keys), 100_000):
                keys, uses = tally.keys[i:i + 100_000], tally.counts[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(uses * learnt), pa.array(uses)], COUNTS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([0]), pa.array([n]), pa.array([n])], COUNTS)

    counted = docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long, uses long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def last(key: Column, symbols: int) -> Column:
    return key.bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def gram_scores(counts: DataFrame) -> DataFrame:
    """key, uses, score (log10 probability of the symbol after its context) of every gram of ``counts`` (key, n, uses).

    The same terms as ``Ppm``, by joins: a shorter gram or context is the end of at most SYMBOLS longer ones by one symbol,
    so no key of the counts is hot. Tables of two symbols at most are broadcast.
    """
    small = lambda df, symbols: F.broadcast(df) if symbols <= 2 else df
    level = {ORDER: counts.where("n > 0").select("key", "n")}
    for order in range(ORDER - 1, -1, -1):
        level[order] = cut_lineage(level[order + 1].groupBy(last(F.col("key"), order + 1).alias("key")).agg(F.sum("n").alias("n")))
    contexts: dict[int, DataFrame] = {}
    for order in range(ORDER + 1):
        own = level[order].withColumn("context", F.shiftright("key", BITS))
        if not order:
            own = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
            contexts[0] = cut_lineage(own.withColumn("low_all", F.lit(0.0)).withColumn("low_escape", F.lit(0.0)))
            continue
        below = level[order - 1].select(F.col("key").alias("low"), F.col("n").alias("low_n"))
        own = own.withColumn("low", last(F.col("key"), order)).join(small(below, order), "low").groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("low_n").alias("seen"))
        shorter = contexts[order - 1].select(F.col("context").alias("low"), F.col("total").alias("low_total"), F.col("distinct").alias("low_distinct"))
        own = own.withColumn("low", last(F.col("context"), order - 1)).join(small(shorter, order - 1), "low")
        new = F.col("low_distinct") > F.col("distinct")
        own = own.withColumn("low_all", F.when(new, F.log10(F.col("low_total") - F.col("seen"))).otherwise(0.0))
        own = own.withColumn("low_escape", F.when(new, F.log10((F.col("low_distinct") - F.col("distinct")) / 2) - F.col("low_all")).otherwise(0.0))
        contexts[order] = cut_lineage(own.select("context", "total", "distinct", "low_all", "low_escape"))
    known = contexts[0].select("distinct").first()
    unseen = -float(np.log10(max(1, SYMBOLS - (known[0] if known else 0))))

    learnt = counts.where("n > 0").withColumn("context", F.shiftright("key", BITS)).join(contexts[ORDER].select("context", "total"), "context")
    scores = learnt.select("key", "uses", (F.log10(F.col("n") - 0.5) - F.log10("total")).alias("score"))
    todo = counts.where("n = 0").select("key", "uses", F.lit(0.0).alias("score"), F.lit(False).alias("came"), F.lit(0.0).alias("all"), F.lit(0.0).alias("escape"))
    for order in range(ORDER, -1, -1):
        found = level[order].select(F.col("key").alias("own"), "n")
        costs = contexts[order].select("context", F.log10("total").alias("own_all"), (F.log10(F.col("distinct") / 2) - F.log10("total")).alias("own_escape"), "low_all", "low_escape")
        at = todo.withColumn("own", last(F.col("key"), order + 1)).withColumn("context", F.shiftright("own", BITS))
        at = at.join(small(found, order + 1), "own", "left").join(small(costs, order), "context", "left")
        base, out = F.when(F.col("came"), F.col("all")).otherwise(F.col("own_all")), F.when(F.col("came"), F.col("escape")).otherwise(F.coalesce("own_escape", F.lit(0.0)))
        term = F.when(F.col("n").isNotNull(), F.log10(F.col("n") - 0.5) - base).otherwise(out)
        at = cut_lineage(at.select(
            "key", "uses", (F.col("score") + term).alias("score"), F.col("n").isNotNull().alias("done"), F.col("own_all").isNotNull().alias("came"),
            F.coalesce("low_all", F.lit(0.0)).alias("all"), F.coalesce("low_escape", F.lit(0.0)).alias("escape")))
        scores = scores.unionByName(at.where("done").select("key", "uses", "score"))
        todo = at.where("NOT done").drop("done")
    return cut_lineage(scores.unionByName(todo.select("key", "uses", (F.col("score") + unseen).alias("score"))))


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and values of at most ``limit`` rows (key, n, value) of the highest ``n``, sorted by key, and the least ``n`` of them.

    Rows of equal count stay or go together: the least count follows from how many rows each count has. Counts of 2**16
    and more are taken by their nine leading bits.
    """
    low = "CAST(floor(log2(n)) AS INT) - 8"
    step = F.when(F.col("n") < 1 << 16, F.col("n")).otherwise(F.expr(f"shiftleft(shiftright(n, {low}), {low})"))
    sizes = counts.groupBy(step.alias("n")).count().collect()  # at most 2**16 rows and 2**9 for each further bit
    sizes = sorted((-r["n"], r["count"]) for r in sizes)
    held, least = 0, None
    for n, rows in sizes:
        if held + rows > limit:
            break
        held, least = held + rows, -n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), 1 << 62
    rows = counts.where(F.col("n") >= least).select("key", "value").toArrow()
    key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], value[order], least


class HashTable:
    """Open addressing over distinct int64 keys: the place of each queried key among ``keys``, or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys), dtype=np.int32), self.slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            place = self.slots[at]
            some = place >= 0
            same = some & (self.keys[place] == keys[todo])
            out[todo[same]] = place[same]
            more = some & ~same
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Level:
    """One context length: (context, symbol) with log counts, and what a context costs."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int):
        self.grams, self.n, self.order = HashTable(key), n, order
        context = key >> BITS
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
        self.contexts = HashTable(context[first])
        self.of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
        self.total = np.bincount(self.of, n, len(first))
        self.distinct = np.bincount(self.of, minlength=len(first)).astype(float)
        self.log_n = np.log10(n - 0.5).astype(np.float32)
        self.log_all = np.log10(self.total)
        self.escape = np.log10(self.distinct / 2) - self.log_all

    def exclude(self, low: Level) -> None:
        """What the next shorter contexts cost when reached by an escape from these."""
        below = low.grams.find(self.grams.keys & ((1 << BITS * (low.order + 1)) - 1))
        seen = np.bincount(self.of, low.n[below], len(self.total))
        context = low.contexts.find(self.contexts.keys & ((1 << BITS * low.order) - 1))
        total, distinct = low.total[context] - seen, low.distinct[context] - self.distinct
        new = distinct > 0
        self.low_all = np.log10(np.where(new, total, 1))
        self.low_escape = np.where(new, np.log10(np.maximum(distinct, 1) / 2) - self.low_all, 0.0)


class Ppm:
    """The model of (context, symbol) counts of the full context length in memory; ``gram_scores`` has it as joins."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        for order in range(ORDER + 1):
            low = keys & ((1 << BITS * (order + 1)) - 1)
            own, at = np.unique(low, return_inverse=True)
            level = Level(own, np.bincount(at, counts, len(own)), order)
            if order:
                level.exclude(self.levels[-1])
                self.levels[-1].n = None
            self.levels.append(level)
        self.levels[-1].n = None
        known = self.levels[0].distinct[0] if len(keys) else 0
        self.unseen = -np.log10(max(1, SYMBOLS - known))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        top = self.levels[ORDER]
        place = top.grams.find(key)
        hit = place >= 0
        out = np.zeros(len(key))
        out[hit] = top.log_n[place[hit]] - top.log_all[top.of[place[hit]]]
        todo = np.flatnonzero(~hit)
        above = np.full(len(todo), -1)  # the known context of the next longer order, if any
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            own = key[todo] & ((1 << BITS * (order + 1)) - 1)
            place, context = level.grams.find(own), level.contexts.find(own >> BITS)
            came, known = above >= 0, context >= 0
            longer = self.levels[order + 1] if order < ORDER else None
            base = np.zeros(len(todo))
            base[~came & known] = level.log_all[context[~came & known]]
            if longer is not None:
                base[came] = longer.low_all[above[came]]
            found = place >= 0
            out[todo[found]] += level.log_n[place[found]] - base[found]
            out[todo[~came & known & ~found]] += level.escape[context[~came & known & ~found]]
            if longer is not None:
                out[todo[came & ~found]] += longer.low_escape[above[came & ~found]]
            todo, above = todo[~found], context[~found]
        out[todo] += self.unseen
        return out


class Model:
    """The tables of frequent grams and words in use, built once per worker."""

    source = ""
    built: tuple = ()

    @classmethod
    def of(cls, name: str, arrays) -> tuple[HashTable, np.ndarray, HashTable, np.ndarray]:
        if cls.source != name:
            cls.built = ()
            keys, scores, heavy, heavy_log = arrays.value
            cls.built, cls.source = (HashTable(keys), scores, HashTable(heavy), heavy_log), name
        return cls.built


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 7 is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and the baseline learn from the texts that are not held out. ``score`` is the log10 probability of the
    lower-cased bytes of the text and its end. Null texts are empty and have the end token alone. With nothing to learn
    from, every symbol is equally likely. Repeated rows count each time and get equal scores; null ids are trained on;
    other columns are ignored; an empty table gives an empty result.
    """
    docs = texts(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    counts = cut_lineage(count_texts(docs))
    words = counts.where(F.col("kind") == WORD).select("key", "n", F.log10(F.col("n") + 1.0).alias("value"))
    sums = counts.where(F.col("kind") != GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()
    sums = {r["kind"]: r for r in sums}
    ends = sums[TEXT]["n"] if TEXT in sums else 0
    total = ends + (sums[WORD]["n"] if WORD in sums else 0)
    distinct = (ends > 0) + (sums[WORD]["keys"] if WORD in sums else 0)
    heavy, heavy_log, least_word = most_frequent(words, MAX_WORDS)
    scores = gram_scores(counts.where(F.col("kind") == GRAM).select("key", "n", "uses")).select("key", F.col("uses").alias("n"), F.col("score").alias("value"))
    keys, values, least_gram = most_frequent(scores, MAX_GRAMS)
    arrays, name = df.sparkSession.sparkContext.broadcast((keys, values, heavy, heavy_log)), uuid.uuid4().hex

    def rare_rows(kind: int, ids: np.ndarray, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        m = len(first)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[row[first]]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(np.diff(np.append(first, len(key)))),
            pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(np.full(m, kind, np.int32)), pa.array(key[first]),
        ], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gram_score, word_table, known_log = Model.of(name, arrays)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), PART):
                rows = hi - lo
                data = lower_bytes(data)
                gram, gram_row = grams(data, offsets)
                place = table.find(gram)
                hit = place >= 0
                score = np.bincount(gram_row[hit], gram_score[place[hit]], rows).astype(float)
                start, end, row = word_spans(data, offsets)
                word = signed(span_hashes(data, start, end))
                at = word_table.find(word)
                known = at >= 0
                ids = number + np.arange(rows)
                number += rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(np.bincount(row, minlength=rows) + 1),
                    pa.array(np.bincount(row[known], minlength=rows)), pa.array(np.bincount(row[known], known_log[at[known]], rows).astype(float)), pa.array(score),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()),
                ], NAMES)
                if not known.all():
                    yield rare_rows(WORD, ids, row[~known], word[~known])
                if not hit.all():
                    yield rare_rows(GRAM, ids, gram_row[~hit], gram[~hit])

    scored = cut_lineage(docs.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n long, known long, log double, score double, kind int, key long"))
    rare = scored.where(F.col("kind").isNotNull()).select("row", "kind", "key", "n")
    rest = words.where(F.col("n") < least_word).select(F.lit(WORD).alias("kind"), "key", "value").unionByName(scores.where(F.col("n") < least_gram).select(F.lit(GRAM).alias("kind"), "key", "value"))
    is_word, value = F.col("kind") == WORD, F.col("n") * F.col("value")
    found = rare.join(rest, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(is_word, F.col("n"))).alias("rare_known"), F.sum(F.when(is_word, value)).alias("rare_log"), F.sum(F.when(~is_word, value)).alias("rare_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.where(F.col("kind").isNull()).join(found, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero(F.col("rare_known")) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + zero(F.col("rare_log")) + float(np.log10(ends + 1)) - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + zero(F.col("rare_score"))).alias("score"),
    )


NAMES = ["row", "doc_id", "held_out", "n", "known", "log", "score", "kind", "key"]
COUNTS = ["kind", "key", "n", "uses"]

"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's leaves hold the merge rank of each symbol with its right neighbour; inner nodes hold minima, so the root names
the leftmost merge of lowest rank. A merge changes three leaves and their ancestors. Words of similar length are merged
side by side in one array of trees. Words repeat, so each worker keeps a bounded table of those it has met.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchspark.llm.common import byte_slices, lean, texts

NONE = np.int32(1 << 30)
#: How byte-level vocabularies split words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words kept by a worker before its table starts anew.
TABLE_WORDS = 300_000
#: Text encoded at a time, the longest word merged beside others, and symbols merged side by side.
CHUNK_BYTES, WIDE, PART = 4 << 20, 512, 1 << 15


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Pairs of symbols with their merge rank and the symbol they make, in an open-addressing table."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        size = 1 << self.BITS
        self.made, self.key, self.rank = made.astype(np.int32), np.full(size, -1, np.int64), np.zeros(size, np.int32)
        todo = np.arange(len(left))
        pair = left.astype(np.int64) << 20 | right
        at, self.probes = self.slot(pair), 1
        while len(todo):
            free = self.key[at] < 0
            self.key[at[free]], self.rank[at[free]] = pair[todo][free], todo[free]
            lost = self.key[at] != pair[todo]
            todo, at = todo[lost], (at[lost] + 1) & (size - 1)
            self.probes += len(todo) > 0
        self.lookup = dict(zip(pair.tolist(), range(len(pair))))

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or NONE."""
        pair = left.astype(np.int64) << 20 | right
        at = self.slot(pair)
        out = np.full(pair.shape, NONE, np.int32)
        found = self.key[at] == pair
        out[found] = self.rank[at[found]]
        left_over = np.flatnonzero(~found & (self.key[at] >= 0))
        for step in range(1, self.probes):
            if not len(left_over):
                break
            near = (at[left_over] + step) & ((1 << self.BITS) - 1)
            hit = self.key[near] == pair[left_over]
            out[left_over[hit]] = self.rank[near[hit]]
            left_over = left_over[~hit & (self.key[near] >= 0)]
        return out

    def merge_rows(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of ``ids`` (rows, a power of two) to the end; returns the ids and which of them remain."""
        n, width = ids.shape
        ids = ids.copy()
        column = np.arange(width)
        after = np.tile(column + 1, (n, 1))
        before = np.tile(column - 1, (n, 1))
        alive = column < length[:, None]
        tree = np.full((n, 2 * width), NONE, np.int32)
        pair = alive[:, 1:]
        leaf = tree[:, width:-1]
        row, at = np.nonzero(pair)
        rank = self.ranks(ids[row, at], ids[row, at + 1])
        leaf[row, at] = np.where(rank < NONE, rank * width + at, NONE)
        half = width
        while half > 1:
            tree[:, half // 2:half] = np.minimum(tree[:, half:2 * half:2], tree[:, half + 1:2 * half:2])
            half //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at = root % width
            gone = after[row, at]
            ids[row, at] = self.made[root // width]
            alive[row, gone] = False
            right, left = after[row, gone], before[row, at]
            after[row, at] = right
            inner = right < length[row]
            before[row[inner], right[inner]] = at[inner]
            self.place(tree, ids, row, at, right, inner, width)
            self.place(tree, ids, row, left, at, left >= 0, width)
            tree[row, width + gone] = NONE
            for node in (at, gone, left):
                ok = node >= 0
                r, node = row[ok], (node[ok] + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NONE]
        return ids, alive

    def place(self, tree, ids, row, left, right, ok, width) -> None:
        """Set the leaf of symbol ``left`` from its pair with ``right``, or to NONE where there is none."""
        r, a, b = row[ok], left[ok], right[ok]
        rank = self.ranks(ids[r, a], ids[r, b])
        tree[r, width + a] = np.where(rank < NONE, rank * width + a, NONE)
        r, a = row[~ok & (left >= 0)], left[~ok & (left >= 0)]
        tree[r, width + a] = NONE

    def merge_one(self, ids: list[int]) -> list[int]:
        """The same for one very long word, on plain lists."""
        n, none, find, made = len(ids), int(NONE), self.lookup.get, self.made.tolist()
        width = 1 << max(1, (n - 1).bit_length())

        def leaf(a: int, b: int) -> int:
            rank = find(ids[a] << 20 | ids[b])
            return none if rank is None else rank * width + a

        tree = [none] * (2 * width)
        tree[width:width + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], alive[gone] = made[rank], False
            right, left = after[gone], before[at]
            after[at] = right
            if right < n:
                before[right] = at
            for node, value in ((gone, none), (at, leaf(at, right) if right < n else none), (left, leaf(left, at) if left >= 0 else none)):
                if node >= 0:
                    node += width
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return [x for x, own in zip(ids, alive) if own]


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library, with a table of the words met so far."""

    loaded: dict[str, Bpe] = {}
    table_words = TABLE_WORDS

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        ends = file["model"].get("end_of_word_suffix") or ""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in file["model"]["merges"]]
        known = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.merges = MergeTable(*np.array(known, np.int64).T)
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + ends] for b in range(256)], np.int32)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        of = {c: b for b, c in letters.items()}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token if c in of) if all(c in of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.clear()

    @classmethod
    def shared(cls, raw: bytes) -> Bpe:
        """One instance per worker process and file."""
        key = f"{cls.__name__} {hashlib.sha256(raw).hexdigest()}"
        if key not in cls.loaded:
            cls.loaded[key] = cls(raw)
        return cls.loaded[key]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after another, and where each word's ids start (one more entry than words)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(words), np.uint8)
        pool = self.first[flat]
        some = size > 0
        pool[at[1:][some] - 1] = self.last[flat[at[1:][some] - 1]]
        count = size.copy()
        width = 2
        while width <= WIDE:
            pick = np.flatnonzero((size > width // 2) & (size <= width) & (size > 1))
            for part in np.array_split(pick, max(1, len(pick) * width // PART)):
                if len(part):
                    place = at[part, None] + np.arange(width)
                    inside = place < at[part + 1, None]
                    rows = np.zeros((len(part), width), np.int32)
                    rows[inside] = pool[place[inside]]
                    ids, alive = self.merges.merge_rows(rows, size[part])
                    count[part] = alive.sum(1)
                    pool[(at[part, None] + np.cumsum(alive, 1) - 1)[alive]] = ids[alive]
            width *= 2
        for i in np.flatnonzero(size > WIDE):
            ids = self.merges.merge_one(pool[at[i]:at[i + 1]].tolist())
            count[i] = len(ids)
            pool[at[i]:at[i] + len(ids)] = ids
        ends = np.concatenate([[0], np.cumsum(count)])
        return pool[spread(at[:-1], count, ends)], ends

    def words(self, chunk: str) -> tuple | list[str]:
        """The words of a chunk that are merged one by one."""
        return (chunk,) if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else WORDS.findall(chunk)

    def odd(self, chunk: str) -> bool:
        """Whether a chunk needs ``encode_odd``: those with special tokens."""
        return self.cut is not None and "<" in chunk and self.cut.search(chunk) is not None

    def encode_odd(self, chunk: str) -> np.ndarray:
        parts = [np.array([self.special[x]], np.int32) if x in self.special else self.encode_chunks([x])[0] for x in self.cut.split(chunk) if x]
        return np.concatenate(parts)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``chunks`` without odd ones, one after another, and where each chunk's ids start."""
        found = [self.words(c) for c in chunks]
        flat, ends = self.encode_words([w.encode() for w in chain.from_iterable(found)])
        return flat, ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])]

    def codes(self, chunks: list[str]) -> np.ndarray:
        """The place in the table of every chunk, after those that it lacked have been encoded."""
        if len(self.table) > self.table_words:
            self.clear()
        n = len(self.table)
        out = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))
        new = [self.whole(c) for c in islice(self.table, n, None)]
        odd = np.fromiter(map(self.odd, new), bool, len(new))
        flat, ends = self.encode_chunks([c for c, o in zip(new, odd) if not o])
        rest = [self.encode_odd(c) for c, o in zip(new, odd) if o]
        size = np.zeros(len(new), np.int64)
        size[~odd], size[odd] = np.diff(ends), [len(x) for x in rest]
        start = np.zeros(len(new), np.int64)
        start[~odd], start[odd] = ends[:-1], len(flat) + np.cumsum(size[odd]) - size[odd]
        self.start = np.concatenate([self.start, len(self.pool) + start])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat, *rest])
        return out

    @staticmethod
    def whole(chunk: str) -> str:
        """A chunk as it stands in its text: those of ``split_text`` lose the blank that comes before them."""
        return chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else " " + chunk

    def clear(self) -> None:
        self.table = Numbered()
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_lists(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents given as chunks, one after another, and where each document's ids start."""
        code = self.codes(list(chain.from_iterable(lists)))
        size = self.size[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        held = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return self.pool[spread(self.start[code], size, ends)], ends[held]


def spread(start: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indexes of all items of runs that begin at ``start``; ``ends``: 0 and the running sum of ``size``."""
    return np.repeat(start - ends[:-1], size) + np.arange(ends[-1])


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose only white space is single blanks and line ends between other characters."""
    gap = (data == 32) | (data == 10)
    odd = (data < 9) | ((data > 10) & (data < 32))
    odd[1:] |= gap[1:] & gap[:-1]
    high = np.flatnonzero(data >= 0xC2)
    if len(high):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = wide[high], wide[high + 1], wide[high + 2]
        space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        odd[high[space]] = True
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = False
    some = offsets[1:] > offsets[:-1]
    plain[some] &= ~gap[offsets[:-1][some]] & ~gap[offsets[1:][some] - 1]
    return plain


def split_text(text: str, plain: bool) -> list[str]:
    """Chunks that encode independently: before each single blank or line end, or else the vocabulary's own words."""
    if not text:
        return []
    if plain:
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = "\0" + chunks[0]
        return chunks
    return ["\0" + text]


class Pieces:
    """Byte strings of one kind for every id (its text, its decimal digits), to be joined for many ids at once."""

    def __init__(self, parts: list[bytes]):
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ``ids`` one after another, and where those of each document begin."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[spread(self.start[ids], size, ends)].tobytes(), ends[at].tolist()


def encoded(raw, columns: Callable, names: list[str]):
    """A ``mapInArrow`` function: ``columns(bpe, ids, at)`` of the documents of each slice, after doc_id."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.shared(raw.value)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), CHUNK_BYTES):
                plain = plain_rows(data, offsets).tolist()
                ids, at = bpe.encode_lists([split_text(t or "", p) for t, p in zip(batch.column(1).slice(lo, hi - lo).to_pylist(), plain)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns(bpe, ids, at)], ["doc_id", *names])
        bpe.clear()  # the worker lives on and may serve other operators

    return run


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once by the driver and sent to the workers (a few MB)."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the tokenizers library encodes it without added tokens.

    A null or empty text has no ids. Special tokens in a text get their id. Rows are independent: repeated rows and null
    ids stay as they are, other columns are ignored, an empty table gives an empty result.
    """

    def columns(bpe, ids, at):
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]

    return texts(df, id_col, text_col).mapInArrow(encoded(vocabulary(df, path), columns, ["ids"]), "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids are none, broken UTF-8 becomes U+FFFD, unknown ids are left out."""
    raw = vocabulary(df, path)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bpe.shared(raw.value).bytes
        for batch in batches:
            out = [b"".join(known[i] for i in ids or [] if i is not None and 0 <= i < len(known)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``bpe_encode`` and then ``bpe_decode`` give, without moving either."""

    def columns(bpe, ids, at):
        if not hasattr(bpe, "digits"):
            bpe.digits, bpe.texts = Pieces([f"{i},".encode() for i in range(len(bpe.bytes))]), Pieces(bpe.bytes)
        (digits, a), (raw, b) = bpe.digits.join(ids, at), bpe.texts.join(ids, at)
        numbers = [hashlib.sha256(digits[i:max(i, j - 1)]).hexdigest() for i, j in zip(a, a[1:])]
        decoded = [hashlib.sha256(raw[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(b, b[1:])]
        return [pa.array(np.diff(at)), pa.array(numbers), pa.array(decoded)]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(df, id_col, text_col).mapInArrow(encoded(vocabulary(df, path), columns, ["n_tokens", "ids_sha256", "decoded_sha256"]), schema)

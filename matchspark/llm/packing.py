"""Packing of documents into fixed windows by the sum-of-squares rule.

A document's tokens are cut into whole windows and one rest. Online, each rest goes to the fill level that makes the sum
of squared counts of partly filled windows smallest; a level array holds those counts and the windows open at each level.
Every task packs its own share as it reads it, so nothing is shuffled. What stays open at a task's end is levelled out by
cutting pieces of the emptiest windows into the gaps of the fullest; the single rest becomes sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from matchspark.llm.bpe import Bpe, vocabulary
from matchspark.llm.common import SPACE, byte_slices, lean, texts

#: Fixed value: how the lower-case vocabulary splits words.
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Text encoded at a time: a worker also holds its open windows.
CHUNK_BYTES = 1 << 20
#: Windows a task may hold open; beyond it half of them are levelled out, as all are at the end.
MAX_OPEN = 8192


class WordBpe(Bpe):
    """A vocabulary of lower-case words with word ends, which drops white space: each word stands alone."""

    def __init__(self, raw: bytes):
        super().__init__(raw)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()

    @staticmethod
    def whole(chunk: str) -> str:
        return chunk

    def words(self, chunk: str) -> tuple | list[str]:
        chunk = chunk.lower()
        return (chunk,) if chunk.isalpha() else LOWER_WORDS.findall(chunk)

    def odd(self, chunk: str) -> bool:
        """Texts passed whole and words beyond Latin-1 go through the library."""
        return not chunk.isascii() and max(chunk) > "\xff" or chunk[:1] == "\0"

    def encode_odd(self, chunk: str) -> np.ndarray:
        return np.array(self.library.encode(chunk.lstrip("\0"), add_special_tokens=False).ids, np.int32)


def simple_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of Latin-1 text whose points and commas before white space all follow a letter or digit."""
    letter = (data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    odd = data >= 0xC4
    odd[1:-1] |= ((data[1:-1] == 44) | (data[1:-1] == 46)) & SPACE[data[2:]] & ~letter[:-2]
    odd[:1] |= (data[:1] == 44) | (data[:1] == 46)
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = False
    begin = offsets[:-1][offsets[1:] > offsets[:-1]]
    out[offsets[1:] > offsets[:-1]] &= (data[begin] != 44) & (data[begin] != 46)
    return out


def split_words(text: str, simple: bool) -> list[str]:
    """White-space separated words, of simple texts in lower case and without the points and commas at their ends.

    A text with special tokens or with separators that only Python splits at stays whole.
    """
    if "<|" in text or "\0" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return ["\0" + text]
    if simple:
        text = text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
    return text.split()


class Packer:
    """Open windows by fill level, and the pieces they hold: (document, start, ids)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def place(self, piece: tuple) -> list[list]:
        """Put one rest into the best level; returns the windows that this fills, each as its pieces."""
        n = len(piece[2])
        top = self.window - n
        to = self.count[n:self.window + 1].copy()
        to[-1] = 0
        cost = 2 * (to - self.count[:top + 1]) + 2
        cost[-1] -= 1
        cost[self.count[:top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * to[0] + 1
        level = top - int(np.argmin(cost[::-1]))
        if level:
            pieces = self.take(level)
        else:
            pieces = []
        pieces.append(piece)
        if level + n == self.window:
            return [pieces]
        self.put(level + n, pieces)
        if self.open <= MAX_OPEN:
            return []
        rest = self.drained()
        out = list(self.levelled(rest, MAX_OPEN // 2))
        for level, pieces in rest:
            self.put(level, pieces)
        return out

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.at[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def drained(self) -> list[tuple]:
        """All open windows with their levels, the fullest first; none stays open."""
        rest = [(level, pieces) for level in range(self.window, 0, -1) for pieces in self.at[level]]
        self.__init__(self.window)
        return rest

    def levelled(self, rest: list[tuple], keep: int) -> Iterator[list]:
        """Fill the fullest of ``rest`` with cuts of the emptiest until at most ``keep`` stay in it; yields the full ones."""
        full, low = 0, len(rest) - 1
        while full < low and low - full >= keep:
            level, pieces = rest[full]
            below, giver = rest[low]
            doc, start, ids = giver.pop()
            n = min(self.window - level, len(ids))
            pieces.append((doc, start + len(ids) - n, ids[len(ids) - n:]))
            if n < len(ids):
                giver.append((doc, start, ids[:len(ids) - n]))
            rest[full], rest[low] = (level + n, pieces), (below - n, giver)
            if level + n == self.window:
                yield pieces
                full += 1
            if below == n:
                low -= 1
        rest[:] = rest[full:low + 1]

    def finish(self) -> Iterator[list]:
        """Windows still open, levelled out: all full, then one rest as sequences of powers of two."""
        rest = self.drained()
        yield from self.levelled(rest, 1)
        for level, pieces in rest:
            size = 1 << (level.bit_length() - 1)
            while pieces:
                own, need = [], size
                while need:
                    doc, start, ids = pieces.pop(0)
                    own.append((doc, start, ids[:need]))
                    if len(ids) > need:
                        pieces.insert(0, (doc, start + need, ids[need:]))
                    need -= len(own[-1][2])
                yield own
                level -= size
                size = 1 << (level.bit_length() - 1) if level else 0


def pack(df: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Each document is its ids and ``end_id``; each id lies in exactly one piece, and a sequence holds ``window`` ids at
    most, without gaps. A null or empty text is ``end_id`` alone. Repeated rows and null ids are packed like any other
    row; other columns are ignored; an empty table gives no pieces. Sequence ids are unique but not consecutive.
    """
    raw = vocabulary(df, path)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = WordBpe.shared(raw.value), Packer(window)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
                out.append(row + (ids,) if with_ids else row)
                offset += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*out)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1), CHUNK_BYTES):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                simple = simple_rows(data, offsets).tolist()
                flat, at = bpe.encode_lists([split_words(t or "", s) for t, s in zip(batch.column(1).slice(lo, hi - lo).to_pylist(), simple)])
                for doc, a, b in zip(docs, at, at[1:]):
                    ids = np.append(flat[a:b], np.int32(end_id))
                    whole = len(ids) - len(ids) % window
                    for start in range(0, whole, window):
                        emit([((doc, len(ids)), start, ids[start:start + window])])
                    if whole < len(ids):
                        for full in packer.place(((doc, len(ids)), whole, ids[whole:].copy())):
                            emit(full)
                if len(out) > 5000:
                    yield batch_of()
        for pieces in packer.finish():
            emit(pieces)
        yield batch_of()
        bpe.clear()  # the worker lives on and may serve other operators

    return texts(df, id_col, text_col).mapInArrow(run, schema)

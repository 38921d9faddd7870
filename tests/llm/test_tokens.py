"""BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchspark.llm.bpe import Bpe, bpe_decode, bpe_digests, bpe_encode
import matchspark.llm.packing as packing
from matchspark.llm.packing import Packer, pack

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_bpe(table, request):
    df = request.getfixturevalue(table)
    tok = library(BYTES)
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_digests(df, BYTES).collect()) == want
    encoded = bpe_encode(df, BYTES)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert Counter(tuple(r) for r in bpe_decode(encoded, BYTES).collect()) == Counter(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aehnt \n\t'.,é<|>s1 ", max_size=40))
def test_any_text_encodes_like_the_library(text):
    bpe = Bpe.shared(open(BYTES, "rb").read())
    test_any_text_encodes_like_the_library.tok = getattr(test_any_text_encodes_like_the_library, "tok", None) or library(BYTES)
    import pyarrow as pa

    from matchspark.llm.bpe import encoded

    class Raw:
        value = open(BYTES, "rb").read()

    run = encoded(Raw, lambda b, ids, at: [pa.array([ids[x:y].tolist() for x, y in zip(at, at[1:])], pa.list_(pa.int32()))], ["ids"])
    got = next(run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
    assert got.column(1).to_pylist()[0] == test_any_text_encodes_like_the_library.tok.encode(text, add_special_tokens=False).ids
    assert bpe is Bpe.shared(Raw.value)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing(table, request):
    df = request.getfixturevalue(table)
    tok = library(WORDS)
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.select("doc_id", "text").collect())
    pieces = pack(df, WORDS, with_ids=True).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        size = sum(p.length for p in own)
        assert size <= 2048 and (size == 2048 or size & (size - 1) == 0)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, own in by_doc.items():
        whole = Counter(n for d, n in want.elements() if d == doc)
        if sum(whole.values()) == 1:
            own.sort(key=lambda p: p.start)
            assert tuple(x for p in own for x in p.ids) == next(iter(whole)) and {p.doc_tokens for p in own} == {len(next(iter(whole)))}
        assert Counter(x for p in own for x in p.ids) == Counter(x for ids in whole.elements() for x in ids)


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    packer = Packer(32)
    for _ in range(400):
        n = int(rng.integers(1, 32))
        before = packer.count.copy()

        def after(level):
            c = before.copy()
            c[level] -= level > 0
            if level + n < 32:
                c[level + n] += 1
            return int((c[1:32] ** 2).sum())

        options = [0, *(h for h in range(1, 33 - n) if before[h] > 0)]
        packer.place(("d", 0, np.zeros(n, np.int32)))
        assert int((packer.count[1:32] ** 2).sum()) == min(after(h) for h in options)


def test_open_windows_are_levelled_out_beyond_the_limit(monkeypatch):
    """Rests too long to pair up fill no window by themselves; however few may stay open, none is closed short."""
    monkeypatch.setattr(packing, "MAX_OPEN", 8)
    rng = np.random.default_rng(11)
    packer, out = packing.Packer(2048), []
    sizes = rng.integers(1200, 2041, 700).tolist()
    for doc, n in enumerate(sizes):
        out += packer.place((doc, 0, np.arange(n, dtype=np.int32)))
        assert packer.open <= 9
    rest = list(packer.finish())
    assert {sum(len(ids) for _, _, ids in w) for w in out} == {2048}
    short = [n for n in (sum(len(ids) for _, _, ids in w) for w in rest) if n < 2048]
    assert sum(short) < 2048 and all(n & (n - 1) == 0 for n in short)
    held = {}
    for doc, start, ids in (p for w in out + rest for p in w):
        assert ids.tolist() == list(range(start, start + len(ids)))
        held.setdefault(doc, []).extend(ids.tolist())
    assert [sorted(held[d]) for d in range(len(sizes))] == [list(range(n)) for n in sizes]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_digests(empty, BYTES).count() == bpe_encode(empty, BYTES).count() == pack(empty, WORDS).count() == 0

"""Importance resampling against the rules written out row by row."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import matchspark.llm.resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, x in docs:
        words, fs = runs(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] if r[0] is not None else 1 << 63, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, out))


def got(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words]) for r in df.collect())


@pytest.mark.parametrize("percent, least", [(5, 20), (50, 1), (100, 0), (1, 5000)])
def test_documents_and_odd_rows(spark, documents, odd, percent, least):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(documents.select("doc_id", "text").limit(30))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, least)
    assert got(rs.importance_resample(docs, target, percent=percent, least_words=least)) == want


def test_clashing_columns_null_targets_and_empty_tables(spark, odd):
    target = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    clash = odd.withColumnRenamed("rep", "place").withColumnRenamed("kept", "rank")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(rs.importance_resample(clash, target, percent=40, least_words=1)) == brute(docs, [], 40, 1)
    assert rs.importance_resample(odd.limit(0), target).count() == 0
    assert got(rs.importance_resample(odd, target.limit(0), percent=40, least_words=1)) == brute(docs, [], 40, 1)


def test_features_of_pieces_and_long_words(monkeypatch):
    monkeypatch.setattr(rs, "CHUNK", 5)
    rows = ["a " * 23 + "é" * 90 + " b " + "x" * 70 + " c", "", None, "one", "two words", "日本" * 40 + " " + "日" * 30 + " z"]
    have = [[] for _ in rows]
    for lo, hi, words, pieces in rs.features(pa.array(rows, pa.string()), 3, 1 << 31):
        assert words.tolist() == [len(runs(t)[0]) for t in rows[lo:hi]]
        for row, bucket in pieces:
            for r, b in zip(row.tolist(), bucket.tolist()):
                have[lo + r].append(b)
    for t, h in zip(rows, have):
        assert sorted(h) == sorted(zlib.crc32(f.encode()) % (1 << 31) for f in runs(t)[1])


def test_kth_key_with_ties(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(-3, 3, 3000), rng.integers(0, 40, 3000), rng.integers(0, 2, 3000))]
    df = spark.createDataFrame(rows, "score long, place long, n_features long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 2, 1499, 2999, 3000):
        assert rs.kth_key(df, k) == order[k - 1]

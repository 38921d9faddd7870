"""Collocations against the rules written out on whole texts."""

import re
from collections import Counter, defaultdict

import pytest

import matchspark.llm.collocations as co


def brute(rows, least, longest, top, percent):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, co.collocations(df, **kw).collect()))


@pytest.mark.parametrize("least, longest, top, percent", [(12, 5, 2000, 100), (8, 3, 40, 60)])
def test_documents(spark, documents, least, longest, top, percent):
    docs = documents.limit(120)
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows, least, longest, top, percent)
    assert len(want) > 30
    assert got(docs, least=least, longest=longest, top=top, percent=percent) == want


def test_colliding_fingerprints_and_no_pruning(spark, odd, monkeypatch):
    """With fingerprints of ten bits all phrases collide; with no room for known keys all runs are shuffled."""
    rows = [(r.lang, r.text) for r in odd.collect()] + [(None, "a b, a b; c\ta  b d. a b c d e f"), ("x", "Ä ä é a b"), ("en", "a b c a b c")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, 2, 5, 2000, 100)
    assert got(df, least=2) == want
    for name, value in (("BITS", 10), ("MAX_KEYS", 0), ("CHUNK", 16), ("PART", 3)):
        monkeypatch.setattr(co, name, value)
        assert got(df, least=2) == want


def test_clashing_columns_and_empty_tables(spark, odd):
    clash = odd.withColumn("rk", odd["doc_id"]).withColumn("salt", odd["doc_id"]).withColumn("phrase", odd["text"]).withColumn("n", odd["doc_id"])
    assert got(clash, least=2) == brute([(r.lang, r.text) for r in odd.collect()], 2, 5, 2000, 100)
    assert got(odd.limit(0)) == []
    assert got(odd.where("text = ''")) == []
    assert got(odd, least=10**6) == []

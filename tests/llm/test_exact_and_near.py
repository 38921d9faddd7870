"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchspark.llm.exact_dedup import CountingQuotientFilter, exact_dedup
from matchspark.llm.near_dedup import B, REGISTERS, likely_similarity, near_components, set_sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().lower().decode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 57) - 1), st.integers(1, 1 << 20)), max_size=200))
def test_counting_quotient_filter_is_lossless(items):
    held = dict(items)
    keys = np.array(sorted(held), np.uint64)
    counts = np.array([held[int(k)] for k in keys], np.int64)
    raw = CountingQuotientFilter.pack(keys, counts, 57)
    k, c = CountingQuotientFilter.unpack(raw)
    assert k.tolist() == keys.tolist() and c.tolist() == counts.tolist()
    k, c = CountingQuotientFilter.merge([raw, CountingQuotientFilter.pack(keys[::2], counts[::2], 57)])
    assert k.tolist() == keys.tolist() and c.tolist() == [int(n) * (1 + (i % 2 == 0)) for i, n in enumerate(counts)]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = Counter()
    for i, t in rows:
        own = groups[lower(t)]
        out[(i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_exact_dedup(table, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = exact_dedup(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_brute(rows)
    stays = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len({lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def near_brute(rows, width):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return Counter((i, len(sets[k]), i if not sets[k] else min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("table,width", [("odd", 2), ("documents", 2), ("documents", 5)])
def test_near_components(table, width, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = near_components(df, width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_group_of_chained_copies(spark):
    """A large group in which neighbours are alike, its ends are not, beside pairs just under the threshold."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[2 * i:2 * i + 60])) for i in range(120)]
    rows += [(1000 + i, " ".join([*(f"u{j}" for j in range(43)), *(f"v{i}_{j}" for j in range(7))])) for i in range(60)]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows, 2)


def test_estimates_and_merging():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        common, n = rng.integers(0, 1 << 63, int(4000 * share / (1 + share)), dtype=np.uint64), 2000
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
        row = np.zeros(n, np.int64)
        x, y, both = set_sketches(row, a, 1), set_sketches(row, b, 1), set_sketches(np.zeros(2 * n, np.int64), np.concatenate([a, b]), 1)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(likely_similarity(x, y, np.array([n * 1.0]), np.array([n * 1.0]))[0] - true) < 0.15
        assert (np.maximum(x, y) >= both).mean() > 0.97  # a union's registers are the maxima
    assert B > 1 and REGISTERS == 256


@pytest.mark.parametrize("operator", [exact_dedup, near_components])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0

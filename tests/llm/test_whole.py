"""Operators past the sizes up to which one table or array holds everything."""

import numpy as np
import pytest

import matchspark.llm.lm_score as lm
from matchspark.llm.common import byte_slices, lower_bytes


@pytest.mark.parametrize("table, most", [("odd", 0), ("documents", 300)])
def test_scores_use_all_counts(table, most, request, monkeypatch):
    """Scores are those of the trie of all training grams, however few grams are broadcast."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "MAX_GRAMS", most)
    df = request.getfixturevalue(table).limit(120)
    rows = [(r.doc_id, r.text, r.held_out) for r in df.select("doc_id", "text", lm.held_out(df["doc_id"]).alias("held_out")).collect()]
    keys = [np.concatenate([lm.grams(lower_bytes(d), o)[0] for _, _, d, o in byte_slices(pa.array([t or ""]))]) for _, t, _ in rows]
    model = lm.Ppm(*np.unique(np.concatenate([k for k, r in zip(keys, rows) if not r[2]]), return_counts=True))
    want = sorted((str(r[0]), len(k), float(model.log10(k).sum())) for k, r in zip(keys, rows))
    ids = {}
    for i, _, score in want:
        ids.setdefault(i, []).append(score)
    got = {}
    for r in lm.lm_score(df).collect():
        got.setdefault(str(r.doc_id), []).append(r.score)
    assert got.keys() == ids.keys()
    for i, scores in ids.items():
        assert np.allclose(sorted(got[i]), sorted(scores), rtol=1e-5, atol=0.01)  # Ppm holds logs in single precision


def test_the_most_frequent_of_many_large_counts(spark):
    """Large counts are told apart, so a full table never empties the broadcast."""
    rows = [(i, n, float(i)) for i, n in enumerate([3] * 50 + list(range(65_000, 75_000)) + [1 << 40, (1 << 40) + 5])]
    key, value, least = lm.most_frequent(spark.createDataFrame(rows, "key long, n long, value double"), 1000)
    assert 500 < len(key) <= 1000 and {r[0] for r in rows if r[1] >= least} == set(key.tolist()) and value.tolist() == [float(k) for k in key]

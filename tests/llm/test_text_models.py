"""Language ID, language-model scores, fingerprints, HTML extraction, URL rules and passage removal."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import matchspark.llm.html_text as html_pages
import matchspark.llm.suffix_dedup as suffix
from matchspark.llm.common import byte_slices, eight_bytes, mix
from matchspark.llm.fingerprints import K, S, anchors, fingerprints, likeness
from matchspark.llm.html_text import blocks, html_text
from matchspark.llm.language_id import language_id
from matchspark.llm.lm_score import Ppm, grams, lm_score
from matchspark.llm.suffix_dedup import suffix_array, suffix_dedup
from matchspark.llm.url_filter import url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def held(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


def removed(texts):
    count = Counter(t[s:s + 200] for t in texts for s in range(len(t) - 199))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for s in range(len(t) - 199):
            if count[t[s:s + 200]] > 1:
                mask[s:s + 200] = b"\1" * 200
        out.append((len(t), sum(mask), sum(1 for a, b in zip(b"\0" + mask, mask) if b and not a), hashlib.sha256(bytes(c for c, m in zip(t, mask) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_passages(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    x, y = next(t for _, t in rows if len(t) > 900), next(t for _, t in reversed(rows) if len(t) > 900)
    rows += [(None, x[:250]), (9001, None), (9002, ""), (9003, "a" * 450), (9004, "ab" * 150), (9005, "é" * 101), (9006, y), (9006, y), (9007, "q" * 199), (9008, "pré" + x[5:260] + "fin"), (9009, x[5:204] + "zz")]
    rows += [(9100 + i, f"{i} " * 60 + y[100:240] + f" {i * 7}" * 60) for i in range(12)]
    rows += [(9200 + i, f"{i} " * 60 + y[100:340] + f" {i * 7}" * 60) for i in range(12)]
    want = Counter((i, *w) for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows])))
    assert Counter(tuple(r) for r in suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()) == want


def test_passages_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows])))
    assert Counter(tuple(r) for r in suffix_dedup(odd).collect()) == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300, 1500):
        raw = rng.choice(list(b"ab c"), n).astype(np.uint8).tobytes() + b"\xff"
        order = suffix_array(np.frombuffer(raw, np.uint8), eight_bytes(np.frombuffer(raw + bytes(208), np.uint8)))
        assert sorted(order.tolist()) == list(range(n + 1))
        assert [raw[i:i + 200] for i in order] == sorted(raw[i:i + 200] for i in range(n + 1))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_base_scores(table, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, WORD.findall((r.text or "").encode().lower().decode()) + [None]) for r in df.select("doc_id", "text").collect()]
    count = Counter(w for i, words in rows if not held(i, 7) for w in words)
    total = sum(count.values())
    want = sorted((str(i), held(i, 7), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w), 6)) for i, w in rows)
    got = lm_score(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one_and_prefer_what_was_seen():
    data = np.frombuffer(b"the cat sat on the mat. the dog ate the cat. and then that was it", np.uint8)
    keys, _ = grams(data, np.array([0, 20, 20, len(data)]))
    own, n = np.unique(keys, return_counts=True)
    model = Ppm(own, n)
    for context in [*(keys[[0, 3, 20, 25, 40]] >> 9), 12345]:
        assert abs((10 ** model.log10((np.int64(context) << 9) | np.arange(1, 258))).sum() - 1) < 1e-5
    seen, _ = grams(np.frombuffer(b"the cat", np.uint8), np.array([0, 7]))
    other, _ = grams(np.frombuffer(b"xqz#vkw", np.uint8), np.array([0, 7]))
    assert model.log10(seen).sum() > model.log10(other).sum()
    assert abs((10 ** Ppm(own[:0], n[:0]).log10(seen[:1]))[0] - 1 / 257) < 1e-9


def test_language_id(spark, documents):
    got = {r.doc_id: r for r in language_id(documents).collect()}
    lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    out = [i for i in lang if held(i, 4)]
    assert len(got) == documents.count() and all(got[i].held_out == held(i, 4) for i in lang)
    assert sum(got[i].lang_pred == lang[i] for i in out) > 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_of_odd_rows(odd, spark):
    got = language_id(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 8)} == {"und"} and all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (1, 7, 9))
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id(unlabelled).collect()] == [("und", 0.0)]
    assert language_id(unlabelled.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_fingerprints(table, request):
    df = request.getfixturevalue(table)
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want = Counter()
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        h = len(a) // 2
        want[(i, len(a), hashlib.sha256((a[:len(a) - h] + b[:h]).encode()).hexdigest())] += 1
    got = fingerprints(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.edited_sha256 in by_text:
            assert by_text[r.edited_sha256] == r.edited_fingerprint
        by_text[r.edited_sha256] = r.edited_fingerprint
    if table == "documents":
        assert np.mean([r.near_edited for r in got]) > 0.25 > 0.05 > np.mean([r.near_next for r in got])


def brute_links(text):
    """Links of a text from the definition: k-mers whose smallest inner s-mer stands at an edge, and the steps between them."""
    data = text.encode()
    rank = lambda s: int(mix(np.array([int.from_bytes(s, "big")], np.uint64))[0])
    found = []
    for i in range(len(data) - K + 1):
        inner = [rank(data[j:j + S]) for j in range(i, i + K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, data[i:i + K]))
    if len(found) == 1 or (data and len(data) < K):
        return Counter([found[0][1] if found else data])
    return Counter((a[1], b[1], b[0] - a[0]) for a, b in zip(found, found[1:]))


def test_likeness_of_all_links():
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))
    shared = words(60)
    cases = [("", ""), ("", "x"), ("abc", "abc"), ("abc", "abd"), (words(40), words(40)), (words(80) + shared + words(50), words(10) + shared), (shared * 3, shared), (shared, shared[:90] + "X" + shared[91:]), ("a" * 40, "a" * 60)]
    for a, b in cases:
        x, y = brute_links(a), brute_links(b)
        either = sum((x | y).values())
        mine = [anchors(d, o)[0][1] for t in (a, b) for _, _, d, o in byte_slices(pa.array([t]))]
        assert likeness(*mine) == pytest.approx(sum((x & y).values()) / either if either else 1.0)


def test_small_parts_of_long_texts_count(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(map(str, rng.integers(0, 10**6, n)))
    passage, long = text(400), text(20000)
    rows = [(1, text(20000) + passage), (2, passage + text(20000)), (3, long), (4, long[:70000] + "abc" + long[70003:])]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.005 < got[1].near_next < 0.02 and 0.99 < got[3].near_next < 1
    assert got[3].fingerprint != got[4].fingerprint


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(0x4E00 + i % 600) * 3} {chr(0x4E00 + i % 600) * 2}", f"l{i % 600:03}") for i in range(2400)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    known = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len({r.lang_pred for r in got}) > 500 and {r.lang_pred for r in got} <= known
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.9


PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><div id="cookie-notice">We use</div>
<article><h1>Big &lt;T&gt;</h1><p>One<b>two</b> three&nbsp;x<br>y<p>Next <script>var t="</p>";</script>para<aside>side</aside><form>f<input></form><div class="ad">buy</div>
<table><tr><td>c1<td>c2</table></article><section class="comments"><article>cmt</article></section><footer>foot</footer></body>"""


def test_html(spark):
    shared = "<div>Home About Contact Imprint Privacy Terms Help Jobs Press</div>"
    rows = [(i, f"http://h.com/{i}", f"{shared}<div>{' '.join(f'w{i}_{j}' for j in range(20))}</div>") for i in range(5)]
    rows += [(10, "http://a.org/", PAGE), (10, "http://a.org/", PAGE), (None, None, None), (11, "", ""), (12, "x", "<p>only < text"), (13, "y", "<div " * 500), (14, "z", "<article>" + "<p>long text " * 3000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in html_text(df).collect()}
    assert got[10] == "Big <T>\nOnetwo three x y\nNext para\nc1\nc2"
    assert all(got[i] == " ".join(f"w{i}_{j}" for j in range(20)) for i in range(5))
    assert got[None] == got[11] == "" and got[12] == "only < text" and got[14] == "\n".join(["long text"] * 3000)
    assert len(html_text(df).collect()) == len(rows) and html_text(df.limit(0)).count() == 0
    assert blocks("") == []


def own_words(streams, run=8):
    """For each page's words: whether no run around them stands on a page with other words."""
    pages = {}
    for words in streams:
        for i in range(len(words) - run + 1):
            pages.setdefault(tuple(words[i:i + run]), set()).add(tuple(words))
    return [[not any(len(pages[tuple(words[i:i + run])]) > 1 for i in range(max(0, j - run + 1), min(j, len(words) - run) + 1)) for j in range(len(words))] for words in streams]


@pytest.mark.parametrize("chars", [None, 40_000])
def test_repeats_of_large_hosts(spark, monkeypatch, chars):
    if chars:
        monkeypatch.setattr(html_pages, "SHARE_CHARS", chars, raising=False)
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    notices = [words(int(n)) for n in rng.integers(6, 14, 1100)]
    streams = [words(int(rng.integers(0, 20))) + notices[i % 1100] + words(int(rng.integers(0, 20))) for i in range(2200)]
    streams += [streams[5]] * 3 + [words(7), [], ["a"] * 30, ["a"] * 31] + [words(12)] * 20
    streams += [w[:4] + ["x"] + w[5:] for w in streams[:60]]
    rows = [(i, f"http://large.org/{i}", f"<p>{' '.join(w)}</p>") for i, w in enumerate(streams)]
    other = [(10_000 + i, "http://small.org/", f"<p>{' '.join(streams[i])}</p>") for i in range(5)]  # of another host: no repeats
    got = {r.page_id: r for r in html_text(spark.createDataFrame(rows + other, "page_id long, url string, html string")).collect()}
    for i, (stream, own) in enumerate(zip(streams, own_words(streams))):
        assert got[i].text == " ".join(w for w, o in zip(stream, own) if o) and got[i].n_repeated == own.count(False)
    assert all(got[10_000 + i].text == " ".join(streams[i]) for i in range(5)) and len(got) == len(rows) + 5


@pytest.mark.parametrize("chars", [None, 100])
def test_hosts_of_few_words(spark, monkeypatch, chars):
    if chars:
        monkeypatch.setattr(html_pages, "SHARE_CHARS", chars, raising=False)
    for pages in (["<p>two words"], [""], [None, "<p></p>"], ["<p>a b c", "d", "e f g h i j k l"], ["<p>" + "a " * 9, "<p>" + "a " * 9]):
        rows = [(None if i else 2**60 + 1, "http://few.org/", page) for i, page in enumerate(pages)]
        got = html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert Counter((r.page_id, r.text, r.n_repeated) for r in got) == Counter((i, " ".join((p or "").replace("<p>", "").replace("</p>", "").split()), 0) for i, _, p in rows)


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net", "http://net/", "http://xnet/", "https://a.b.example.com/de/", "http://example.com/De/", "http://x.org/fr/#a", "://q.net/p#x", "http://a.net?x=/en/", "http://é.org/fr/"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, urls[3], "h", "p"), (None, urls[5], "h", "p")], "page_id long, url string, host string, rule string")

    def judge(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.encode().lower().decode()
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    table = spark.createDataFrame(rules + rules[:1], "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_filter(df, table).collect())
    assert got == Counter((r.page_id, *judge(r.url)) for r in df.collect())
    none = url_filter(df, table.limit(0)).collect()
    assert len(none) == df.count() and {r.verdict for r in none} == {"allow"} and url_filter(df.limit(0), table).count() == 0
    plan = url_filter(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan.replace("Scan Arrow", "")


def test_many_listed_urls(spark):
    """Filters of many blocks: every listed URL is found and nothing else."""
    table = spark.range(5000).selectExpr("concat('h', id, '.test') AS host", "concat('/p', id % 7, '/') AS path", "'block' AS verdict")
    df = spark.range(10000).selectExpr("id AS page_id", "concat('http://www.h', id, '.test/p', id % 7, '/x') AS url")
    assert url_filter(df, table).where("verdict = 'block'").count() == 5000 == url_filter(df, table).where("verdict = 'block' AND page_id < 5000").count()


@pytest.mark.parametrize("operator", [suffix_dedup, lm_score, fingerprints])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0


def test_language_features_of_a_slice_take_little_memory():
    import tracemalloc

    import numpy as np

    from matchspark.llm import language_id as L

    L.Letters.fold(np.zeros(1, np.int64))
    model = L.Model(["a", "b"], np.ones(1 << L.FEATURE_BITS))
    text = np.random.default_rng(2).integers(97, 123, L.PART).astype(np.uint8)
    tracemalloc.start()
    model.vectors(text, np.arange(0, L.PART + 1, 2048))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20

"""The operators on small fixtures, against brute force, and on odd inputs."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, html, jaccard, language, mixing, quality, sentencepiece, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and a column that clashes with the operators' own."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 3, 1), (1, "the quick brown fox jumps over the lazy dog", "en", "a", 3, 1), (2, None, None, None, None, None), (3, "", "en", "a", 0, 1), (None, "le chat est sur la table", "fr", "b", 4, 1), (4, "  \n\t ", "de", "b", 4, 1), (5, long, "en", "a", 5, 1), (6, "x" * 50_000, None, "c", 6, 1), (7, "ÀÉ 漢字 ▁ \U0001f600", "fr", None, 7, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, texts):
    sets, top = shingle_sets(texts), {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(ids[i]), find(ids[j])))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def test_jaccard_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3 + [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(0, 60, 2)]
    texts += [" ".join(base[:30] + [f"q{j}_{i}" for i in range(30)]) for j in range(10)] + ["a b", "A  b", "a c", "", None, " "]
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[4 * k : 4 * k + 40]) for k in range(10)]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components([i for i, _ in rows], texts)


def test_jaccard_documents(documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents).collect()}
    assert got == brute_components([r.doc_id for r in rows], [r.text for r in rows])


def test_jaccard_odd(odd):
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(odd).collect())
    assert got[(1, 1)] == 2 and got[(2, 2)] == 1 and sum(got.values()) == 8
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0
    assert set(jaccard.drop_near_copies(odd).columns) == set(odd.columns)


def test_jaccard_repeated_ids(spark):
    """Of rows that share a doc_id and a text one stays; different texts of a doc_id link each on its own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a)] * 40 + [(1, b), (2, c), (3, b + " end"), (4, c + " end"), (5, a + " end"), (2, "x y"), (6, ""), (6, "")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == {(1, 56, 1): 41, (3, 57, 1): 1, (2, 56, 2): 1, (4, 57, 2): 1, (5, 57, 1): 1, (2, 1, 2): 1, (6, 0, 6): 2}
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.drop_near_copies(docs).collect())
    assert kept == {(1, a): 1, (1, b): 1, (2, c): 1, (2, "x y"): 1, (6, ""): 2}


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.load_pieces(path)


@pytest.mark.parametrize("bound", [sentencepiece.BROADCAST_SEGMENTS, 0])
def test_sentencepiece_equals_the_library(spark, documents, odd, pieces, bound):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=pieces[0])
    both = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in both.collect()}
    encoded = sentencepiece.encode(both, pieces[1], broadcast_segments=bound)
    for r in encoded.collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id] or "")
    for r in sentencepiece.decode(encoded, pieces[1]).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")


def test_viterbi_fold(spark):
    table = sentencepiece.PieceTable((("▁", 1, -3.0), ("a", 2, -2.0), ("b", 3, -2.0), ("ab", 4, -2.5), ("▁a", 5, -2.6), ("▁ab", 6, -7.0), ("bab", 7, -1.0)), (), 0, ())
    found = spark.createDataFrame([(s,) for s in ("▁ab", "▁abab", "▁aab", "▁xb", "▁")], "segment string")
    got = {r.segment: list(np.frombuffer(r.ids, "<i4")) for r in sentencepiece.encode_segments(found, table).collect()}
    scores = {p: (i, v) for p, i, v in table.pieces}
    for segment, ids in got.items():
        assert ids == sentencepiece.encode_one(segment, table, scores)
    assert got["▁abab"] == [5, 7] and got["▁xb"] == [1, 0, 3]


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 12)) * rng.gamma(1.0, size=(500, 1))
    x[200:260] = x[200]
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)] + [(900, None, 0), (1000, [float("nan")] * 12, 0), (1100, [None] * 12, 0), (1200, [1.0] * 12, 0)]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")).collect()
    ids = np.r_[np.arange(500), 1200]
    ints = np.floor(1024 * np.vstack([x, np.ones(12)])).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = ints @ ints[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want += [(ids[q], k, ids[i], s[i]) for k, i in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError, match="longer"):
        topk.exact_topk(spark.createDataFrame([(0, [4e6] * 2), (1, [3e6] * 2)], "vec_id long, embedding array<double>"))


def test_topk_in_blocks(spark, monkeypatch):
    """Several blocks of queries, tasks and steps give the rows of one."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = sorted(map(tuple, topk.exact_topk(e, is_query=F.col("vec_id") % 5 == 0).collect()))
    for name, value in (("BLOCK_BYTES", 1 << 14), ("TASK_ROWS", 100), ("STEP_ROWS", 16), ("STEP_QUERIES", 8)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.exact_topk(e, is_query=F.col("vec_id") % 5 == 0).collect())) == want


def test_nearest_in_parts(spark, monkeypatch):
    """Leaves in parts, queries in blocks, ties and repeated rows: with full recall the rows are exact."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(60, 6)), 4, axis=0)
    docs = spark.createDataFrame([(i % 200, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("TASK_ROWS", 20), ("QUERY_BLOCK", 3), ("STEP_ROWS", 8)):
        monkeypatch.setattr(ann, name, value)
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(docs, k=5, recall=1.0, calibration=1000, branch=3, depth=2).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.arange(240) % 200
    for q in range(0, 200, 20):
        own = min(x[ids == q].tolist())
        s = ann.inner(x, np.repeat(np.array([own]), len(x), 0))
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert got[q] == [(ids[i], s[i]) for i in order]


def test_nearest_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(dict)
    for r in ann.nearest(e).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = ann.inner(x, np.repeat(x[q : q + 1], len(x), 0))
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        found = [got[ids[q]][k] for k in range(1, 21)]
        assert all(score == s[np.flatnonzero(ids == v)[0]] for v, score in found)
        hits, total = hits + len({ids[i] for i in order} & {v for v, _ in found}), total + 20
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_nearest_with_a_repeated_query(spark):
    """Rows that share the query's vec_id don't push out its neighbours."""
    rng = np.random.default_rng(4)
    near = [(i, [1.0, *(0.01 * rng.normal(size=3)).tolist()]) for i in range(1, 20)] + [(i, [0.5, *(0.01 * rng.normal(size=3)).tolist()]) for i in range(21, 40)]
    docs = spark.createDataFrame([(0, [2.0, 0.0, 0.0, 0.0])] * 50 + near, "vec_id long, embedding array<double>")
    got = [r for r in ann.nearest(docs, is_query=F.col("vec_id") == 0, recall=1.0).collect()]
    x = np.array([v for _, v in near])
    want = [near[i][0] for i in np.argsort(-x[:, 0], kind="stable")[:20]]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == want


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [("http://A.Example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://b.org/x", "b.org", "/x", "org/", "allow"), ("http://b.org", "b.org", "", None, "allow"), ("http://x.com/de/porn", "x.com", "/de/porn", "com/de/", "block"), ("http://x.net/porn-1", "x.net", "/porn-1", None, "block"), ("http://x.net/popcorn", "x.net", "/popcorn", None, "allow"), ("http://x.net/sexy/casino", "x.net", "/sexy/casino", None, "block"), ("http://x.net/casino/casino", "x.net", "/casino/casino", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://h?q#f", "h", "", None, "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow")])
def test_urls(spark, url, host, path, rule, verdict):
    assert urls.UrlFilter().judge(url)[:4] == (host, path, rule, verdict)
    got = urls.filter_urls(spark.createDataFrame([(None, url, "h")], "page_id long, url string, host string")).first()
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_html():
    model = html.fit_html(html.training_pages())
    prose = "A long walk through the woods and over the hill brought them to the lake, where the boats lay. "
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>Walk &amp; lake</h1><p>{prose * 3}</p><p>one\n  two<br>three</p><script>x("</p>")</script></article><div class="comments"><p>{prose}</p></div><footer>&copy; us</footer></body></html>'
    assert html.extract(page, model) == f"Walk & lake\n{(prose * 3).strip()}\none two three"
    for odd in (None, "", "   ", "<", "</p>", "<p", "<div " + "a" * 1000, "<b>" * 3000):
        assert isinstance(html.extract(odd, model), str)


def test_html_keeps_what_follows_icons_and_lies_in_wrappers():
    model = html.fit_html(html.training_pages())
    prose = ("A long walk through the woods and over the hill brought them to the lake, where the boats lay. " * 4).strip()
    want = f"{prose}\nSum is x+y here.\n{prose}"
    article = f"<article><p>{prose}</p><p>Sum is <math><mi>x</mi><mspace/><mo>+</mo><mi>y</mi></math><math/> here.</p><p>{prose}</p></article>"
    for icon in ('<svg class="i"/>', "<svg/>", "<svg>"):
        assert html.extract(f"<html><body>{icon}{article}<footer>us</footer></body></html>", model) == want
        assert html.extract(f"<html><body>{article.replace('<p>Sum', icon + '<p>Sum')}<footer>us</footer></body></html>", model) == want
    assert html.extract(f"<html><body><svg><text>no</text></svg>{article}</body></html>", model) == want
    menu = '<nav><a href="/">Home</a></nav>'
    for form in ("<form>", '<form id="aspnetForm" method="post">'):
        assert html.extract(f"<html><body>{form}{menu}{article}<label>Name</label></form><footer>us</footer></body></html>", model) == want
    assert html.extract(f"<html><body>{article}<form><p>Our letter by mail</p></form></body></html>", model) == want


def test_html_inline_adverts_go():
    model = html.fit_html(html.training_pages())
    prose = "A long walk through the woods and over the hill brought them to the lake, where the boats lay."
    page = f"<html><body><article><p>{prose} <span class=ad>BUY NOW</span>It was <em>late</em>, <a href='/x'>the road</a> <b>dark</b>.</p><p>{prose}</p></article></body></html>"
    assert html.extract(page, model) == f"{prose} It was late, the road dark.\n{prose}"


def test_extract_pages_odd(spark):
    prose = "A long walk through the woods and over the hill brought them to the lake, where the boats lay."
    long = "<article>" + "".join(f"<p>{prose} {i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "http://a/", None, "t"), (1, "http://a/", "", "t"), (None, None, f"<article><p>{prose}</p></article>", "t"), (2, "u", long, None), (2, "u", long, None)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(0, len(prose), len(prose)), (1, 0, 0), (1, 0, 0), *[(2, len(got[-1].text), len(got[-1].text))] * 2]
    assert got[-1].text.count("\n") == 2999
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_odd(spark):
    rows = spark.createDataFrame([(1, "http://b.org/x")] * 3, "page_id long, url string")
    assert urls.filter_urls(rows).count() == 3 and urls.filter_urls(rows.limit(0)).count() == 0


def test_marginals_are_exact():
    """Sum-product on a tree equals the sum over all states."""
    rng = np.random.default_rng(3)
    parents, unary, pair = np.array([-1, 0, 0, 1, 1, 2]), rng.normal(size=6), np.log(rng.dirichlet((1, 1), 2))
    weights = np.zeros((2, 6))
    for state in np.ndindex(*[2] * 6):
        p = np.exp(sum(u * s for u, s in zip(unary, state, strict=True)) + sum(pair[state[parents[i]], state[i]] for i in range(1, 6)))
        for i, s in enumerate(state):
            weights[s, i] += p
    assert np.allclose(html.marginals(parents, unary, pair), weights[1] / weights.sum(0))


def area_under_curve(pos, neg):
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_toxicity(spark, odd):
    """Held-out labels of sf0.1, of which some toxic documents hold no word that tells."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    from ledgerloom.llm.common import held_out

    found = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    pos, neg = [r.score for r in found if r.toxic == 1], [r.score for r in found if r.toxic == 0]
    assert area_under_curve(pos, neg) > 0.93 and np.mean(np.array(pos) >= 0.3) > 0.6 and np.mean(np.array(neg) >= 0.3) < 0.03
    assert toxicity.score_toxicity(odd, model).where("score between 0 and 1").count() == 9
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(odd.limit(0), toxicity.fit_toxicity(docs.limit(0), labels.limit(0))).count() == 0


def brute_kneser_ney(rows, n, d):
    """P(x | h) of each class from (class, text) rows, and the shared S(x | h), written from the definitions."""
    pairs = {(y, p, w) for y, t in rows for p, w in zip(["", *t.split()], t.split(), strict=False)}
    count = collections.Counter()
    for y, _, w in pairs:
        word = f" {w} "
        for i in range(1, len(word)):
            count[y, word[max(0, i - n + 1) : i], word[i]] += 1
    seen = {h + x for _, h, x in count}
    suffixes = {g[i:] for g in seen for i in range(len(g))}
    before = collections.Counter(g[1:] for g in suffixes if len(g) > 1)

    def shared(h, x):
        after = {g[-1]: k for g, k in before.items() if g[:-1] == h}
        low = shared(h[1:], x) if h else 1 / (len({g for g in before if len(g) == 1}) + 1)
        return max(after.get(x, 0) - d, 0) / sum(after.values()) + d * len(after) / sum(after.values()) * low if after else low

    def own(y, h, x):
        after = {b: k for (c, a, b), k in count.items() if (c, a) == (y, h)}
        low = shared(h[1:], x)
        return max(after.get(x, 0) - d, 0) / sum(after.values()) + d * len(after) / sum(after.values()) * low if after else low

    return own, shared, count


def test_kneser_ney_by_brute_force(spark):
    rows = [(1, "you are an idiot idiot scum"), (1, "scum of idiots are you"), (0, "you are an ideal sum of art"), (0, "idle scouts are an art")]
    n, d = 4, 0.75
    own, shared, count = brute_kneser_ney(rows, n, d)
    grams = toxicity._grams(spark.createDataFrame(rows, "y int, text string"), n)
    got = {r.g: (r.t, r.o) for r in grams.collect()}
    assert got == {h + x: (count[1, h, x], count[0, h, x]) for _, h, x in count}
    low = {r.g: r.low for r in toxicity.shared_probabilities(grams, d).collect()}
    assert all(abs(low[g] - shared(g[1:-1], g[-1])) < 1e-9 for g in got)
    letters = sorted({x for _, _, x in count})
    for h in ("", "i", "id", "are"):
        rest = 1 / (len(letters) + 1)  # what S leaves for characters never seen
        assert sum(shared(h, x) for x in letters) < 1 and sum(shared(h, x) for x in letters) > 1 - rest
    grams_found, _ = toxicity._logs(grams, d, 10_000)
    for g, e in zip(grams_found["g"], grams_found["e"], strict=True):
        assert abs(e - np.log(own(1, g[:-1], g[-1]) / own(0, g[:-1], g[-1]))) < 1e-5
    assert dict(zip(grams_found["g"], grams_found["e"], strict=True))[" sc"] > 0


def test_toxicity_of_one_new_character(spark):
    """A text whose only new word is one character, alone or after others: shorter than the grams."""
    from ledgerloom.llm.common import WordTable

    grams, histories = [" x ", "x "], [" x", "x"]
    keys = [np.sort(toxicity._hashes(g)) for g in (grams, histories)]
    model = toxicity.ToxicityModel(5, keys[0], np.ones(2, np.float32), keys[1], np.zeros(2, np.float32), np.array([1.0, 0, 0, 0]))
    one, many = toxicity.word_evidence(model), toxicity.word_evidence(model)
    assert isinstance(one, WordTable) and next(one.rows(["x"])).tolist() == next(many.rows(["x", "known", "words"]))[:1].tolist() == [[1.0, 0.5]]
    assert toxicity.features("known words x", one) == toxicity.features("known words x", many)
    docs = spark.createDataFrame([(1, "x"), (2, "\u6f22 \u6f22"), (3, "known words"), (4, "known words \U0001f600"), (None, "7")], "doc_id long, text string").coalesce(1)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(score) == 5 and score[1] > score[3] == score[4] == score[2]
    assert toxicity.drop_toxic(docs, model, 0.51).count() == 4


def test_toxicity_keeps_the_share_of_labels_under_the_cap(spark):
    """Texts that say nothing score about the share of toxic labels, whatever the cap on the sample is."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in rng.integers(0, 40, 8))) for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.1)) for i in range(6000)], "doc_id long, toxic int")
    for cap in (6000, 300):
        model = toxicity.fit_toxicity(docs, labels, max_per_class=cap)
        found = toxicity.score_toxicity(docs, model).agg(F.avg("score").alias("s"), F.avg("predicted").alias("p")).first()
        assert 0.03 < found.s < 0.2 and found.p < 0.2


def test_language(spark, documents, odd):
    model = language.fit_languages(documents)
    found = language.identify_documents(documents, model).join(documents.select("doc_id", F.col("lang").alias("l")), "doc_id").collect()
    assert np.mean([r.lang == r.l for r in found if r.accepted]) > 0.95 and np.mean([r.accepted for r in found]) > 0.95
    got = language.identify_documents(odd, model).collect()
    assert len(got) == 9 and all(not r.accepted for r in got if r.doc_id in (2, 3, 4))
    assert language.visible("<p>Stra&szlig;e caf&eacute;<script>x</script>") == " Straße café "
    assert [language.site(h) for h in ("a.b.co.uk", "a.b.de", "b.com", "")] == ["b.co.uk", "b.de", "b.com", ""]
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://a.de/x", "<html lang=de><p>der die und nicht", "x")], "page_id long, url string, html string, lang string")
    assert language.identify_pages(pages, model).count() == 2
    assert language.identify_documents(odd.limit(0), model).count() == 0


def test_declared_language_after_a_long_preamble():
    for preamble in ("<!-- " + "licence " * 5000 + "-->", " " * 30_000):
        assert language.declared(f'{preamble}<html class="x" lang="fr-CA"><p>x') == "fr"
    assert language.declared("<p>x" * 10_000) is None


def test_languages_come_from_the_table(spark, documents):
    words = "il gatto dorme sulla sedia della cucina mentre la pioggia cade piano sopra i tetti della vecchia strada".split()
    rng = np.random.default_rng(6)
    italian = spark.createDataFrame([(10_000 + i, " ".join(rng.choice(words, 40)), "it", "x") for i in range(40)] + [(20_000, "unu du tri", "eo", "x")], "doc_id long, text string, lang string, source string")
    both = documents.select("doc_id", "text", "lang", "source").unionByName(italian)
    model = language.fit_languages(both)
    assert model.languages == ("de", "en", "es", "fr", "it")
    assert language.identify_documents(italian.where("lang = 'it'"), model).where("accepted and lang = 'it'").count() == 40


def test_pipeline_stages_judge_rows(spark):
    """Null doc_ids stay, and rows of one doc_id are judged one by one."""
    import corpus_pipeline

    words = {"en": "the house and the garden of the old town are near the river".split(), "fr": "la maison et le jardin de la vieille ville sont dans le pays".split()}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[x], 30)), x, "a") for i in range(60) for x in (("en", "fr")[i % 2],)]
    rows += [(None, " ".join(rng.choice(words["en"], 30)), "en", "a") for _ in range(20)] + [(1, "漢字 漢字 漢字", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(t for _, t, _, _ in rows[:-1])
    found = jaccard.drop_near_copies(docs)
    assert found.columns == docs.columns and found.where("doc_id is null").count() == 20
    model = mixing.fit_domains(docs, docs.select("doc_id"), F.col("lang"))
    mixed = mixing.sample_mixed(docs, model, {"en": 0.5, "fr": 0.5})
    assert mixed.columns == docs.columns
    copies = mixing.mix(docs, model, ["doc_id"], {"en": 0.5, "fr": 0.5})
    assert mixed.where("doc_id is null").count() == copies.where("doc_id is null").agg(F.sum("copies")).first()[0] > 0
    assert 0 < copies.where("doc_id is null and copies <= rate").count() < 20  # rounded row by row


def test_quality(documents, labels, odd):
    model = quality.fit_quality(documents, labels)
    assert quality.score_quality(documents, labels, model).where("score between 0 and 1").count() == documents.count()
    assert quality.score_quality(odd, labels, model).count() == 9
    assert quality.score_quality(odd.limit(0), labels.limit(0), quality.fit_quality(odd.limit(0), labels.limit(0))).count() == 0


def test_quality_shrinks_sites(spark):
    """Sites that differ change the ranking, and a sparse path is drawn to its host."""
    rng = np.random.default_rng(8)
    good, bad = "a plain sentence of many sound words .", "x x x x 1 1 1 ! !"
    rows, marks = [], []
    for i in range(1200):
        host = ("good.example", "bad.example")[i % 2]
        fine = rng.random() < (0.9 if i % 2 == 0 else 0.1)
        rows.append((i, "\n".join(rng.permutation([good, good, bad] if fine == (rng.random() < 0.8) else [good, bad, bad])), host, "main" if i < 1194 else "rare"))
        marks.append((i, int(fine), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, labels, model).collect()
    truth = {i: q for i, q, _ in marks}
    auc = lambda pick: area_under_curve([pick(r) for r in found if truth[r.doc_id]], [pick(r) for r in found if not truth[r.doc_id]])
    assert auc(lambda r: r.score) > auc(lambda r: r.evidence) + 0.05
    rates = {(r.doc_id % 2, r.doc_id >= 1194): (r.host_rate, r.path_rate) for r in found}
    assert rates[0, False][0] > 0.7 > 0.3 > rates[1, False][0]
    assert abs(rates[0, True][1] - rates[0, True][0]) < 0.2  # three rows move it little from its host


def test_mixing(documents, labels, odd):
    model = mixing.fit_domains(documents, labels, F.col("lang"))
    rows = mixing.posteriors(documents, model, ["doc_id"])
    steps, now, want = mixing.fit_rates(rows, model.domains, {model.domains[0]: 1.0})
    assert len(steps) > 1 and now[0] > 0.95  # rates of the others meet 0
    assert rows.select(mixing._rate(steps, len(model.domains)).alias("r")).where("r = 0").count() > 0
    goal = {d: 1.0 for d in model.domains}
    rows = mixing.posteriors(documents, model, ["doc_id"])
    steps, now, want = mixing.fit_rates(rows, model.domains, goal)
    assert np.abs(now - want).max() < 0.01
    assert mixing.mix(documents, model, ["doc_id"], goal).where("rate >= 0").count() == documents.count()
    assert mixing.mix(odd, model, ["doc_id"]).count() == 9
    assert mixing.sample_mixed(odd, model).columns == odd.columns
    assert mixing.mix(odd.limit(0), model, ["doc_id"]).count() == 0


def test_jaccard_words_of_one_polynomial(spark):
    """Two words that agree under every polynomial modulo 2**64 are two words."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    docs = spark.createDataFrame([(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 2)]


def test_jaccard_large_groups(spark):
    """Many blank, equal and nearly equal rows, dealt to several tasks."""
    near = lambda j: " ".join(f"n{i}" if i != j % 60 else f"q{j}" for i in range(60))
    rows = [(i, " ") for i in range(3000)] + [(10_000 + i, "one two three four five six") for i in range(3000)] + [(20_000 + i, near(i)) for i in range(3000)] + [(30_000, "x y z")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("n_shingles", "component_id").agg(F.count("*").alias("x")).where("x > 1").collect()
    assert [tuple(r) for r in got if r.n_shingles == 2] == [(2, 10_000, 3000)]
    assert sum(r.x for r in got if r.component_id == 20_000) == 3000


def test_jaccard_tokens_of_the_same_sets_ask_once(spark, monkeypatch):
    """Unlinked texts that share a long passage are asked by one row each, not by one for each token in common."""
    passage = " ".join(f"shared{i}" for i in range(250))
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(150))) for i in (1, 2)]
    written, stash = {}, jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, name: written.setdefault(name, stash(df, name)) if name == "first" else stash(df, name))
    monkeypatch.setattr(jaccard, "release", lambda *stashed: None)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]
    assert written["first"].count() == 2


def test_jaccard_random_families(spark):
    """Variants at all degrees of similarity, of short and long texts, against brute force."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(3, 160)))]
        for _ in range(6):
            words = [w for w in base if rng.random() > rng.choice([0.0, 0.01, 0.04])]
            words = [w if rng.random() > rng.choice([0.0, 0.01, 0.05]) else f"r{rng.integers(1 << 30)}" for w in words]
            texts.append(" ".join(words + ["common tail that all the texts of this test share"] * int(rng.integers(0, 2))))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components([i for i, _ in rows], texts)


def test_least_shared_prefix_tokens(spark):
    """The bound on shared prefix tokens holds for random pairs at the edge of a link."""
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(400):
        n, m = sorted(rng.integers(1, 300, 2))
        need = -(-75 * (n + m) // 175)
        if need > n:
            continue
        ids = rng.permutation(n + m - need)
        a, b = np.sort(ids[:n]), np.sort(np.r_[ids[:need], ids[n:]])
        keep = lambda s: set(s[: len(s) - -(-75 * len(s) // 100) + 1 + len(s) // jaccard.SHARE].tolist())
        rows.append((int(n), int(m), len(keep(a) & keep(b))))
    df = spark.createDataFrame(rows, "n int, m int, shared int")
    assert df.where(F.col("shared") < F.least(*jaccard.least_shared(F.col("n"), F.col("m"), 75))).count() == 0 and len(rows) > 50

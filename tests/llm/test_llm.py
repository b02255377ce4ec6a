"""Each operator against a brute-force version or a held-out measure, and on odd tables."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodgeprice.llm import (common, components, decontam, htmltext, minhash, mixing, pii, pqindex, quality, sharding,
                            substrings, urls, wordhash)

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot int, "
              "target string, component_id int, st_words string, mix_source string, rid int, a int, hash int")
EXTRA = (1, "x", 2, "y", 3, "z", "w", 4, 5, 6)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"Word{i % 9001}" for i in range(60_000))
    same = "The quick brown fox jumps over the lazy dog and runs on to the river, " * 6
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3),
            (4, long, "en", "b", len(long)), (5, same, "en", "b", 1), (6, same, "en", "a", 1), (7, same + "end", "en", "a", 1),
            (7, same + "end", "en", "a", 1), (None, same, "en", "c", 1), (8, "na " * 500, "en", "c", 1), (9, "é", "fr", "c", 1),
            (9, "other text", "fr", "c", 1), (10, "x" * 300_000, "en", "b", 1)]
    return spark.createDataFrame([r + EXTRA for r in rows], DOC_SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


# words

def test_words_are_those_of_the_pattern():
    texts = ["", None, " a  b\tc\n", "é x y", "A\x0bB", "one", "tail ", "\r\n"]
    w = wordhash.words(pa.array(texts))
    flat = [x for t in texts for x in words(t, lower=False)]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == flat
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = ["alpha beta gamma " * 50, "beta " + "y" * 500, "gamma"]
    whole = wordhash.words(pa.array(texts)).hash
    win = wordhash.windows(whole, 3)
    monkeypatch.setattr(wordhash, "CHUNK", 64)
    assert (wordhash.words(pa.array(texts)).hash == whole).all()
    assert (wordhash.windows(whole, 3) == win).all()
    assert (np.concatenate([wordhash.words(pa.array([t])).hash for t in texts]) == whole).all()


# 1 mixing

def test_mix_shares_and_ceiling(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_report(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    per = got.groupby("source").agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"))
    assert (got.taken <= 2 * got["size"]).all()
    assert abs(per.target.sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum()
    assert (per.target <= 2 * per["size"]).all() and (per["size"] == got.groupby("source").source_size.first()).all()
    assert abs(per.taken.sum() - per.target.sum()) < 0.1 * per.taken.sum()
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mix_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "mix_source string, size long")
    got = {r[0]: r[2] for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    # 1665 in all: a and c end at 200 and 20, b takes the rest up to 2000
    assert got == {"a": 200.0, "b": 1445.0, "c": 20.0, None: 0.0}


# 2 PII

def test_base_rules_equal_plain_regular_expressions(docs):
    def plain(kind, text):
        rule = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
        out = []
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                    "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(m.span())
        return out

    texts = [r.text for r in docs.select("text").collect()]
    texts += ["a@b@c.de x..@y-.z.q_ @a.b +1 2-3.4(5)6 7 8 9 +123456789012345678", "1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.4 1..2.3.4",
              "4111 1111-1111 1111 4111111111111112 0000000000000000000", "é a.b@c.d.e.f@g.h"]
    for t in texts:
        for k, find in pii.FINDERS.items():
            assert find(t) == plain(k, t), (k, t[:200])


def test_crf_finds_tokens_and_nothing_in_plain_text(docs):
    got = docs.select("doc_id", "text").toPandas().merge(pii.find(docs).toPandas(), on="doc_id")
    for r in got.itertuples():
        want = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]+)"', r.text, re.I)]
        own = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("secret:")]
        assert own == want
        base = ",".join(f"{k}:{a}:{b}" for k, f in pii.FINDERS.items() for a, b in f(r.text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    k = len(pii.STATES)
    m = pii.Model(np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    e = rng.normal(size=(9, k))
    got = pii.decode(m, e, np.array([0, 4, 4, 5, 9]))
    for a, b in ((0, 4), (4, 5), (5, 9)):
        value = lambda p: m.start[p[0]] + sum(e[a + i, s] for i, s in enumerate(p)) + sum(  # noqa: B023, E731
            m.transition[x, y] for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(k), repeat=b - a), key=value)
        assert list(best) == got[a:b].tolist()


# 3 embeddings

def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pqindex, "BLOCK", 40)
    monkeypatch.setattr(pqindex, "PER_LIST", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 16)), base[[0] * 150] + 0.1 * rng.normal(size=(150, 16)),
                        base[[1] * 5], 3 * base[[1]]]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [None] + [1.0] * 15, 0),
           (905, [float("inf")] * 16, 0), (906, [1.0, 2.0], 0)]
    got = pqindex.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"))
    got = got.toPandas().set_index("vec_id")
    truth = links.sum(1) - 1
    found = got.loc[range(len(x))].n_links.to_numpy()
    assert (found <= truth).all() and found.sum() >= 0.98 * truth.sum()
    assert (got.loc[[r[0] for r in odd]].n_links == 0).all() and got.loc[[r[0] for r in odd]].kept.all()
    low = np.arange(len(x))
    for _ in range(20):
        low = np.where(links, low[None, :], len(x)).min(1)
    assert (got.loc[range(len(x))].component_id.to_numpy() == low).mean() > 0.98


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pqindex.near_vectors(empty).count() == 0


# 4 urls

def test_url_rules_and_model(spark):
    cases = {"http://www.example.com/en/1": "www.example.com/en/", "https://A.Example.com/en/2?q": "example.com/en/",
             "http://x.net/es/": "net/es/", "http://example.com": None, "http://notexample.com/en/": "com/", "no url": None,
             None: None, "": None, "http://x.org/en/": None, "ftp://x.NET/fr/a#b": "net/fr/"}
    rows = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(rows).collect()}
    assert [got[i].rule for i in range(len(cases))] == list(cases.values())
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/2") and (got[5].host, got[5].path) == ("", "")
    new = ["http://big-casino.example.org/en/7", "http://cheap-pills24.example.org/de/9", "http://m.spam-farm.example.org/",
           "http://river-museum.example.org/en/7", "http://blog.thernd.example.org/de/612", "http://physics.example.net/de/3"]
    rows = spark.createDataFrame(list(enumerate(new)), "page_id long, url string")
    assert [r.verdict for r in urls.judge(rows).orderBy("page_id").collect()] == ["block"] * 3 + ["allow"] * 3
    assert urls.judge(rows.limit(0)).count() == 0


# 5 decontamination

def test_masks_find_every_tolerated_window():
    size, slack = decontam.WINDOW, decontam.TOLERANCE
    for n in range(slack + 1):
        for bad in itertools.combinations(range(size), n):
            assert any(all(at + k not in bad for k, c in enumerate(mask) if c == "1")
                       for mask in decontam.MASKS for at in range(size - len(mask) + 1))


def test_leaks_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(9001, "short five words only here", ), (9002, None), (9003, ""), (9004, "four words are few")]
    bench = bench.union(spark.createDataFrame([(i, *t) if t else (i, None) for i, *t in extra], bench.schema))
    more = spark.createDataFrame([(5001, "so Short FIVE words only here ok"), (5002, "short five words only there")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    items = {r.item_id: words(r.text) for r in bench.collect()}
    want = set()
    for d in docs.collect():
        w = words(d.text)
        have = set(w)
        for i, item in items.items():
            size = min(13, len(item))
            slack = 2 if size == 13 else 0
            if len(item) < 5 or sum(x in have for x in item) < size - slack:
                continue
            for begin in range(-len(item) + size, len(w) - size + 1):
                same = [0 <= begin + k < len(w) and w[begin + k] == x for k, x in enumerate(item)]
                inside = [0 <= begin + k < len(w) for k in range(len(item))]
                if any(sum(same[k:k + size]) >= size - slack and all(inside[k:k + size]) for k in range(len(item) - size + 1)):
                    want.add((d.doc_id, i))
                    break
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == want and (5001, 9001) in got and (5002, 9001) not in got
    kept = {r.doc_id for r in decontam.drop_leaking(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_benchmark_blocks_change_nothing(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in decontam.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert len(decontam.indexes(bench)) > 2
    assert {tuple(r) for r in decontam.leaks(docs, bench).collect()} == one


# 6 quality

def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_without_both_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(4, 1), (5, 1), (6, None), (None, 0)], "doc_id long, quality int")
    assert set(quality.score_report(odd, empty).toPandas().score) == {0.5}
    assert quality.score_report(odd, one).count() == odd.count()
    assert quality.score_report(none, one).count() == 0


# 7 html

def test_html_cases():
    stop = "This is the text of the article and it has all of the words that we want to see in it. "
    page = f"""<html><head><title>t</title><style>p{{a:b}}</style></head><body><nav><a href="/">Home</a></nav>
    <div class="ad">Buy the best of the best and you will have it for the rest of it, that is it.</div><article><h1>Head&amp;line</h1>
    <p>{stop}</p><p><b>Short<br>one.</b><p>x &lt; y&nbsp;z</p><!-- <p>no</p> --><script>var t="</p>";</script>
    <aside>{stop}</aside><div id="comments"><p>{stop}</p></div></article><form><p>{stop}</p></form><footer>&copy; me"""
    assert htmltext.main_text(page) == "\n".join(["Head&line", stop.strip(), "Short one.", "x < y z"])
    plain = f'<div class="menu"><p>{stop}</p></div><p>{stop}</p><p>Yes.</p><p>{stop}</p><div><a href="x">{stop}</a></div><p>Bye.</p>'
    assert htmltext.main_text(plain) == "\n".join([stop.strip(), "Yes.", stop.strip()])
    for bad in (None, "", "<", "<p", "</", "<a href='", "<!--", "<script>x", "&#xZZ;<p>&", "<p class=\"a>b</p>" * 50):
        htmltext.main_text(bad)


def test_html_extracts_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = pages.join(htmltext.extract(pages).select("page_id", "text", "n_chars"), "page_id").toPandas()
    for r in got.itertuples():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(htmltext.entities.unescape(re.sub("<[^>]+>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 8 substrings

def span_truth(texts):
    ws = [words(t, lower=False) for t in texts]
    seen = Counter(tuple(w[j:j + 35]) for w in ws for j in range(len(w) - 34))
    out = []
    for w in ws:
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j:j + 35])] > 1:
                keep[j:j + 35] = [False] * 35
        kept = [x for x, k in zip(w, keep) if k]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lowest_is_the_leftmost_minimum():
    rng = np.random.default_rng(0)
    for span in (1, 2, 3, 5, 8, 24):
        g = rng.integers(0, 6, 300).astype(np.uint64)
        assert substrings.lowest(g, span).tolist() == [i + int(np.argmin(g[i:i + span])) for i in range(len(g) - span + 1)]


def test_spans_against_brute_force(docs, odd):
    for table in (docs, odd):
        got = substrings.remove_duplicates(table).toPandas()
        want = span_truth([r.text for r in table.select("text").collect()])
        assert sorted(zip(got.n_words, got.n_removed, got.kept_sha256)) == want


def test_spans_of_random_repeats(spark):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        w = list(rng.choice(pool, 150))
        for _ in range(3):
            a, n, b = rng.integers(0, 2900), rng.integers(30, 60), rng.integers(0, 100)
            w[b:b] = pool[a:a + n]
        texts.append(" ".join(w))
    texts += ["a b " * 40, "a b " * 30, "c " * 36, "d " * 35]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.remove_duplicates(rows).toPandas()
    assert sorted(zip(got.n_words, got.n_removed, got.kept_sha256)) == span_truth(texts)


# 9 near duplicates

def near_truth(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]
             and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b]))
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in rng.integers(0, 9999, 200)]
    family = []
    for k in range(70):  # chained edits: members far apart link through others
        w = list(base)
        for j in rng.integers(0, 200, rng.integers(1, 7)):
            w[j] = f"e{k}"
        family.append((5000 + k, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + family
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_truth(rows)
    for few, small, block in ((8, 64, 512), (0, 2, 16)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table).collect()}
        assert got == want


def test_pairs_of_small_and_large_buckets_are_all_compared(spark):
    """Every document its own component: the links found are all pairs that reach the threshold and share a bucket."""
    rng = np.random.default_rng(12)
    template, rows = [f"t{i}" for i in range(150)], []
    for family, members in enumerate([3, 5, 9] * 16):
        own = [f"f{family}w{i}" for i in range(50)]
        for m in range(members):
            w = template + own
            for j in rng.integers(0, 200, 2):
                w[j] = f"e{len(rows)}x{j}"
            rows.append((len(rows), " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sig = common.written(minhash.signatures(table), "test-signatures")
    keys = sig.selectExpr("doc_id as doc", "explode(bands) as band", "doc_id as component")
    opened = common.written(minhash._open_rows(keys), "test-open")
    sizes = [r.n for r in opened.select("band", "n").distinct().collect()]
    assert min(sizes) <= minhash.SMALL < max(sizes)
    got = minhash._remaining(opened, sig, table).collect()
    bands = {r.doc_id: set(r.bands) for r in sig.collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {(a, b) for a, b in itertools.combinations(sets, 2)
            if 100 * len(sets[a] & sets[b]) >= minhash.PERCENT * len(sets[a] | sets[b]) and bands[a] & bands[b]}
    assert len(want) > 20
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_estimate_is_near_the_true_similarity(spark):
    rng = np.random.default_rng(6)
    out = []
    for n, m in ((400, 400), (3000, 2800), (30, 33)):
        pool = np.unique(wordhash.mix(rng.integers(1, 2**62, 2 * n + m).astype(np.uint64)))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:int(0.9 * n)], pool[n:n + m - int(0.9 * n)]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        out.append((minhash.registers(a).tolist(), minhash.registers(b).tolist(), len(a), len(b), true))
    rows = spark.createDataFrame(out, "ra array<int>, rb array<int>, na int, nb int, t double")
    from pyspark.sql import functions as F
    for r in rows.withColumn("e", minhash.estimate(*(F.col(c) for c in ("ra", "rb", "na", "nb")))).collect():
        assert abs(r.e - r.t) < 0.12


def test_near_duplicates_on_odd_rows(odd):
    got = minhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    named = got[got.doc_id.notna()].set_index("doc_id")
    assert named.loc[[5, 6, 7]].component_id.eq(5).all() and not named.loc[6].kept and named.loc[1].kept
    assert got[got.doc_id.isna()].component_id.isna().all() and got[got.doc_id.isna()].kept.all()


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 400, 400: 400}


# 10 sharding

def test_shards_are_even_and_slots_gapless(docs, odd):
    for table, shards in ((docs, 7), (odd, 40), (odd, 3)):
        got = sharding.shard_report(table, shards).toPandas()
        size = got.groupby("shard").size().reindex(range(shards), fill_value=0)
        assert len(got) == table.count() and size.max() - size.min() <= 1
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))


def test_settle_moves_little():
    rng = np.random.default_rng(7)
    counts = rng.poisson(3, sharding.CELLS)
    at = []
    for shards in (40, 41):
        where = {}
        for cell, lo, hi, shard, _ in sharding.settle(counts, shards):
            where.update({(cell, r): shard for r in range(lo, hi)})
        assert len(where) == counts.sum()
        at.append(where)
    assert sum(at[0][k] != at[1][k] for k in at[0]) < 0.35 * len(at[0])


# odd and empty tables, every operator and stage

def test_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog and runs on to the river, The quick brown"), (None, None)],
                                  "item_id long, text string")
    for table in (odd, none):
        n = table.count()
        assert mixing.mix_report(table).count() == n
        assert pii.find(table).count() == n
        assert sharding.place(table, 5).columns == [c for c in DOC_NAMES if c not in ("shard", "slot")] + ["shard", "slot"]
        assert minhash.near_duplicates(table).count() == n
        assert substrings.remove_duplicates(table).count() == n
        leaks = {r.doc_id for r in decontam.leaks(table, bench).collect()}
        assert leaks == ({5, 6, 7, None} if n else set())
        assert decontam.leaks(table, bench.limit(0)).count() == 0
        pages = table.selectExpr("doc_id page_id", "lang url", "text html", "size", "shard text")
        assert htmltext.extract(pages).count() == n and urls.judge(pages).count() == n


DOC_NAMES = [c.split()[0] for c in DOC_SCHEMA.split(", ")]


def test_stages_keep_columns(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(5, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            rows = got.count()
            if name != "shard":
                assert got.columns == table.columns
            else:
                assert rows == table.count()


def test_keep_one_links_from_the_given_percentage(spark):
    rng = np.random.default_rng(8)
    rows, want, between = [], set(), 0
    for k in range(40):
        a = [f"d{k}w{i}" for i in range(200)]
        b = list(a)
        for j in rng.choice(40, rng.integers(3, 7), replace=False):
            b[5 * j] = f"d{k}e{j}"
        sets = [{tuple(w[j:j + 5]) for j in range(196)} for w in (a, b)]
        common_, union = len(sets[0] & sets[1]), len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k} if 100 * common_ >= 80 * union else {2 * k, 2 * k + 1}
        between += 80 * union <= 100 * common_ < 85 * union
    assert between > 3 and len(want) > 45
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.keep_one(table, 80)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = labels[(labels.quality == 1)].doc_id
    first = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).toPandas()
    assert first.doc_id.isin(clean).sum() >= 0.97 * len(clean)
    near = near_truth(list(zip(first.doc_id, first.text)), 80)
    second = first[[near[i][1] == i for i in first.doc_id]]
    leaking = {r.doc_id for r in decontam.leaks(spark.createDataFrame(second), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    third = second[~second.doc_id.isin(leaking)]
    taken = mixing.mix_report(spark.createDataFrame(third)).toPandas().set_index("doc_id")["copies"]
    assert Counter(got.doc_id.tolist()) == Counter({i: n for i, n in taken.items() if n})
    size = got.groupby("shard").size()
    assert size.max() - size.min() <= 1 and isinstance(got, pd.DataFrame) and common.WORD

"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from folioframe.llm import byte_bpe, chat, components, decontam, quality, rp_forest, simhash, substring, toxicity, url_filter, warc

DOCS = "doc_id long, text string, n_words string, fp string, chunk int, score string, `a b` string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "kept") for i, t in texts], schema)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["der", "été", "THE", "Straße", "a", "b2", "c.", "|", "x" * 90] + [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 14, 60]))) for _ in range(n)]
    base += [base[5] + "\n" + base[9], base[7].replace("a", "b"), "\t ".join(base[3].split()), base[11].upper()]
    rows = list(enumerate(base)) + [(3, base[3]), (3, base[3]), (7, base[8]), (None, base[9]), (None, base[9]), (None, None), (900, None), (901, ""), (902, " \n")]
    return rows + [(903, " ".join(f"long{i % 700}" for i in range(30_000)))]


# --- connected components ---------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200, i) for i in range(100, 160)] + [(i, i + 1) for i in range(300, 340)]
    edges += [(None, 1), (5, None), (6, 6)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in label:
        for u, v in edges:
            if u in label and v in label and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert found == label
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------------------

def test_forest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 16))
    x = [c + s * rng.standard_normal(16) for c in centres for s in (0, 0.05, 0.07)] + [centres[0] + 0.03 * rng.standard_normal(16) for _ in range(150)]
    x = [list(map(float, v)) for v in x]
    x += [x[0], x[0], [2 * a for a in x[4]], None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(None, x[9], 1)]
    found = rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int"), leaf=16, tile=32)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in found.filter("id is not null").collect()}
    ok = [i for i, v in enumerate(x) if v and len(v) == 16 and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    m = np.array([x[i] for i in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    links = {i: near[k].sum() - 1 + (near[k, ok.index(9)]) for k, i in enumerate(ok)}
    label = dict(zip(ok, ok))
    for _ in range(12):
        label = {i: min(label[ok[j]] for j in np.flatnonzero(near[k])) for k, i in enumerate(ok)}
    n = len(x)
    want = {i: (links.get(i, 0), label.get(i, i)) for i in range(n)} | {n - 2: (1, n - 2), n - 1: (1, n - 2)}
    assert {i: v[:2] for i, v in got.items()} == {i: (int(a), b) for i, (a, b) in want.items()}
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    assert found.count() == len(rows)


def test_forest_recall_of_random_trees(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sum(r.n_links for r in rp_forest.near_duplicates(e).collect())
    m = np.array([r.embedding for r in e.collect()], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert got >= 0.9 * ((m @ m.T >= 0.95).sum() - len(m))
    assert rp_forest.near_duplicates(e.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------------

def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_contamination(spark):
    texts = some_texts(4)
    long = texts[20][1] if len(texts[20][1].split()) > 20 else next(t for _, t in texts if t and len(t.split()) > 20)
    items = [(1, " ".join(long.split()[2:17])), (2, "W1 w2"), (10, "w3"), (11, None), (12, "..."), (13, "never seen words"), (14, long), (14, long), (None, "w4 W5"),
             (15, "long1 long2 long3 long4 long5 long6 long7 long8 long9 long10 long11")]
    table = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(table, bench, window=10)
    assert found.columns == ["doc_id", "text", "fp", "chunk", "score", "a b", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]

    windows = {}
    for i, t in items:
        w = ascii_words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[s:s + 10]), set()).add(i)
    want = []
    for i, t in texts:
        w, hit, of = ascii_words(t), set(), set()
        for p, ids in windows.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s:s + len(p)]) == p:
                    hit.update(range(s, s + len(p)))
                    of |= ids
        want.append((i, t, len(w), len(hit), len([x for x in of if x is not None]), ",".join(sorted(str(x) for x in of if x is not None)), bool(hit)))
    got = [(r.doc_id, r.text, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontam.contamination(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(table.limit(0), bench).count() == 0


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SMALL_BYTES", -1)
    test_contamination(spark)


def test_proximity(spark):
    filler = " ".join(f"f{i}" for i in range(20))
    table = spark.createDataFrame([(1, "rare1 x rare2"), (2, "rare1 x x x x rare2"), (3, f"rare1 {filler} rare2"), (4, "rare2 x rare1"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "rare1 x rare2")], "item_id long, text string")
    got = {(r.k1, r.item, r.distance) for r in decontam.proximity_matches(table, bench, slack=5).collect()}
    assert got == {("1", 9, 0), ("2", 9, 3), ("4", 9, 4)}


def test_proximity_by_the_terms_that_occur(spark):
    table = spark.createDataFrame([(1, "rare1 changed rare2"), (2, "twin"), (3, "twin x x twin"), (4, "a solo b"), (5, "only")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "rare1 absent rare2"), (10, "twin y twin"), (11, "solo"), (12, "only absent")], "item_id long, text string")
    got = {(r.k1, r.item, r.distance) for r in decontam.proximity_matches(table, bench, slack=5).collect()}
    assert got == {("1", 9, 0), ("3", 10, 1), ("4", 11, 0)}


# --- 3 ------------------------------------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_byte_bpe(spark):
    texts = [t for _, t in some_texts(5)] + ["<|endoftext|> 😀 naïve 'll'LL　\x1c\x85  x\r\n\r\n", "é" * 500, "ab" * 5000, "\u0000 � \U000323b0"]
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = byte_bpe.encode(table, RANKS, public_tokenizers.PATTERN, offsets=True).collect()
    plain = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(table, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for r in coded:
        text = texts[r.doc_id] or ""
        assert r.ids == ref.encode_ordinary(text) == plain[r.doc_id].ids
        assert bytes(plain[r.doc_id].decoded) == text.encode()
        pieces = [(text[a:b].encode(), ref.decode_single_token_bytes(i)) for (a, b), i in zip(r.offsets, r.ids)]
        assert all(token in of for of, token in pieces)
    assert byte_bpe.encode(table.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------

def test_warc(spark):
    big, other = "é<p>" * 400, "b" * 1000
    rows = [(1, "http://A.example.com/x?y#z", big), (5, "http://b.example.com/", big), (3, "no host", big), (7, "http://b.example.com/", "small"), (8, "http://b.example.com/", "small"),
            (9, None, None), (10, "http://c\r\nX: y/%0A\t", ""), (11, "http://u/", other), (11, "http://u/", other), (12, "http://u/", "b" * 999), (13, "http://v/", "a\r\n\r\nb" * 300),
            (None, "http://n/", other), (-4, "http://m/", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, id string")
    capture = warc.write(pages, archive_bytes=2000, block_lines=2)
    found = warc.lookup(capture, pages)
    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        last = max((k for k, _, o in rows if (o or "").encode() == body and k is not None), default=None)
        revisit = len(body) >= 1000 and last is not None and i != last
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.lookup(capture, spark.createDataFrame([(1, "http://elsewhere/")], "page_id long, url string")).count() == 0
    only = warc.lookup(capture, spark.createDataFrame([(8, "http://b.example.com/")], "page_id long, url string")).collect()
    assert [bytes(r.payload) for r in only] == [b"small"]
    empty = warc.write(pages.limit(0))
    assert warc.lookup(empty, pages).count() == 0


# --- 5 and 6 ------------------------------------------------------------------------------------------------------------

def test_quality_learns_a_plain_difference(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(rng.randint(5, 80))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randint(5, 80))) for _ in range(60)]
    table = docs(spark, list(enumerate(good + bad)) + [(None, None), (9000, None), (9001, ""), (9002, "x" * 200_000), (3, good[3])])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(9003, None), (None, 1), (9001, 7)], "doc_id long, quality int")
    model = quality.fit_documents(table, labels)
    got = quality.classify(table, model)
    assert [c for c in got.columns if c not in table.columns] == ["predicted"] and got.count() == table.count()
    rows = got.select("doc_id", "score", "predicted").filter("doc_id < 210").collect()
    assert sum((r.predicted == 1) == (r.doc_id < 150) for r in rows) >= len(rows) - 2
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality.classify(table.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit_documents(table, labels.filter("quality = 1"))


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(7)
    mean, factor = rng.standard_normal((2, 3)), [np.linalg.cholesky(np.cov(rng.standard_normal((3, 50)))) for _ in range(2)]
    model = quality.Discriminant(tuple(mean), tuple(np.linalg.inv(f) for f in factor), tuple(float(np.log(np.diag(f)).sum()) for f in factor), 0.4)
    x = rng.standard_normal((5, 3))
    log_density = [[-0.5 * (v - mean[k]) @ np.linalg.solve(factor[k] @ factor[k].T, v - mean[k]) - 0.5 * np.linalg.slogdet(factor[k] @ factor[k].T)[1] for v in x] for k in (0, 1)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(np.array(log_density[1]) - log_density[0] + 0.4))))


def test_toxicity_finds_markers(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(300)]
    toxic = [" ".join([*(word() for _ in range(rng.randint(5, 40))), "zorgik" + word(), "You", "Idiot"][:-1 - i % 2]) for i in range(80)]
    table = docs(spark, list(enumerate(clean + toxic)) + [(None, None), (9000, ""), (9001, "plain " * 50_000)])
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(380)] + [(9000, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    rows = toxicity.classify(table, model).collect()
    assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 380]
    assert sum(r.predicted == (r.doc_id >= 300) for r in known) >= 0.98 * len(known)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (None, 9000, 9001))
    assert toxicity.classify(table.limit(0), model).count() == 0


def test_address_stays_within_its_text():
    none = np.zeros(0, np.uint64)
    markers = toxicity.Markers(none, (none,) * len(toxicity.BEGINNINGS))
    votes = np.arange(len(toxicity.NAMES)) == toxicity.NAMES.index("addressed")
    model = toxicity.Toxicity(markers, None, np.concatenate([2.0 * votes, 2.0 * votes, [-1.0]]))

    def counted(*texts):
        return np.concatenate([toxicity.count_hits(words, markers) for _, words in toxicity.slabs(pa.array(texts))])

    for text, addressed in [("idiot", 0), ("an idiot", 0), ("such an idiot", 0), ("oh you idiot", 1), ("you a b idiot", 1), ("you a b c idiot", 0)]:
        alone, beside = counted(text), counted("this is for you", text, "", text)[[1, 3]]
        assert alone[0][votes] == addressed
        assert (beside == alone).all() and (model.score(beside) == model.score(alone)).all()


def test_short_texts_have_signatures_of_their_own():
    def signed(*texts):
        return [*toxicity.signature.func(pa.array(texts, pa.string())).to_pylist()]

    texts = ["idiot", "Idiot!", "you", "you idiot", "idiot you", "you you", "", None, "three words here"]
    one, upper, you, two, turned, twice, empty, null, long = signed(*texts)
    assert one == upper and empty == null
    assert len({one, you, two, turned, twice, empty, long}) == 7
    assert [signed(t)[0] for t in texts] == [one, upper, you, two, turned, twice, empty, null, long]  # whatever lies in the same slab


def test_short_toxic_posts_teach_markers(spark):
    clean = [(i, f"plain word number {i} and more") for i in range(300)]
    toxic = [(1000 + i, f"zorgik w{i:03d}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + toxic], "doc_id long, toxic int")
    learned = [toxicity.learn_markers(docs(spark, clean + toxic).repartition(n), labels, "doc_id", "text", "toxic") for n in (1, 7)]
    zorgik = toxicity._lexicon("zorgik")
    assert all(toxicity._among(zorgik, m.words).all() for m in learned)
    assert (learned[0].words == learned[1].words).all()


def test_fits_without_labels(spark):
    table = docs(spark, [(i, f"you idiot number {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for marks, want in [(labels, 1), (labels.withColumn("quality", F.lit(0)), 0), (labels.limit(0), 0.5)]:
        model = quality.fit_documents(table, marks, one_class=True)
        assert all(abs(r.score - want) < 1e-9 for r in quality.classify(table, model).collect())
    assert quality.classify(table, quality.fit_documents(table.limit(0), labels)).filter("score = 0.5").count() == 40
    marks = labels.withColumnRenamed("quality", "toxic")
    for known, given in [(table, marks.limit(0)), (table, marks), (table, marks.withColumn("toxic", F.lit(0))), (table.limit(0), marks), (table.limit(0), marks.limit(0))]:
        model = toxicity.fit(known, given)
        assert all(0 <= r.score <= 1 for r in toxicity.classify(table, model).collect())
    assert all(abs(r.score - toxicity.PRIOR) < 1e-9 for r in toxicity.classify(table, model).collect())


def test_label_model_recovers_voters():
    rng = np.random.default_rng(9)
    y = rng.random(20_000) < 0.1
    fires = np.array([[0.01, 0.02, 0.005, 0.03], [0.8, 0.6, 0.7, 0.5]])
    votes = rng.random((len(y), 4)) < np.where(y[:, None], fires[1], fires[0])
    patterns, counts = np.unique(votes.astype(int), axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float))
    assert np.abs(model.fires - fires).max() < 0.08 and abs(model.prior - 0.1) < 0.03
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.97


# --- 7 ------------------------------------------------------------------------------------------------------------------

def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("bad.org", "", "block"), ("bad.org", "", "allow"), ("evil.org", "/x", "block"),
                                   ("good.org", "", "allow")], url_filter.RULES)
    link = '<LINK href="{}" rel=canonical>'.format
    jump = "<meta http-equiv='Refresh' content=\"0; URL={}\">".format
    rows = [(1, "http://WWW.Example.NET/en/a?q#f", None), (2, "https://example.net/de/", ""), (3, "x.net", None), (4, None, None), (5, "http://net", ""), (6, "ftp://bad.org:1/", ""),
            (7, "http://a.org/", link("https://evil.org/xyz")), (8, "https://a.org/#top", ""), (9, "http://b.org/", jump("http://a.org/")), (10, "http://evil.org/y", ""),
            (11, "http://c.org/", link("http://evil.org/x") + link("http://good.org/")), (12, "http://d.org/", link("/relative")), (13, "http://bad.org/z", ""),
            (14, "http://e.org/", ""), (14, "http://e.org/", ""), (15, "http://ÉX.net/É?/", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    moved = spark.createDataFrame([("http://e.org/", "http://b.org/"), (None, "http://b.org/")], "u string, v string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, moved).collect()}
    assert got == {1: ("www.example.net", "/en/a", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
                   5: ("net", "", None, "allow"), 6: ("bad.org:1", "/", None, "allow"), 7: ("a.org", "/", None, "block"), 8: ("a.org", "/", None, "block"), 9: ("b.org", "/", None, "block"),
                   10: ("evil.org", "/y", None, "allow"), 11: ("c.org", "/", None, "allow"), 12: ("d.org", "/", None, "allow"), 13: ("bad.org", "/z", "bad.org", "allow"),
                   14: ("e.org", "/", None, "block"), 15: ("Éx.net", "/É", "net/", "block")}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("verdict = 'block'").count() == 0


def test_url_filter_resolves_links(spark):
    rules = spark.createDataFrame([("bad.org", "", "block"), ("a.org", "/de/", "block")], url_filter.RULES)
    link = '<link rel="alternate canonical" href="{}">'.format
    jump = "<meta http-equiv=refresh content='0; url={}'>".format
    rows = [(1, "http://a.org/x/y", link("/de/x"), "block"), (2, "http://a.org/x/z?q", link("../de/./x"), "block"), (3, "https://b.org", jump("//BAD.org/y"), "block"),
            (4, "http://c.org/p", jump("q?a=1&amp;b=2"), "block"), (5, "http://c.org/q?a=1&b=2", link("http://bad.org/"), "block"), (6, "http://d.org/", link("mailto:x@bad.org"), "allow"),
            (7, "http://e.org/", link("/go?to=http://bad.org/"), "allow"), (8, "http://f.org/a", '<base href="//bad.org/n/">' + link("m"), "block"), (9, "http://g.org/", link("#top"), "allow"),
            (10, "http://h.org/x", link("?p=1"), "block"), (11, "http://h.org/x?p=1", link("//bad.org"), "block"), (12, "no address", link("de/x"), "allow"),
            (13, "http://i.org/", '<link rel="canonical-not" href="http://bad.org/">', "allow"), (14, "http://j.org/", "<link rel=canonical href=http://bad.org/>", "block")]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules).collect()} == {r[0]: r[3] for r in rows}
    ways = [("http://a/b/c/d?q", t) for t in ("g", "./g", "g/", "/g", "//g", "?y", "g?y", ".", "..", "../g", "../../..", "../../../g", "http://h/x/../y", "g?y=../x")]
    from urllib.parse import urljoin
    seen = spark.createDataFrame(ways, "b string, t string").select("t", url_filter.resolve(F.col("b"), F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in seen} == {t: t if "://" in t else urljoin(b, t) for b, t in ways}


# --- 8 ------------------------------------------------------------------------------------------------------------------

def test_fingerprint():
    import xxhash
    for _, text in some_texts(10):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint_of(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("tile", [4096, 8])
def test_fingerprint_links(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres for k in (0, 1, 2, 3, 4, 5)} | {centres[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(12), 2)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_components(prints).collect()}
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    for _ in range(30):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    assert got == dict(zip(signed, label.tolist()))


def test_near_duplicates(spark):
    texts = some_texts(12)
    table = docs(spark, texts)
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(texts)
    blank = [r for r in found if r.fp == 0]
    assert {r.id for r in blank} >= {None, 900, 901, 902} and len({r.component_id for r in blank}) == 1
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert kept.count() == len({r.component_id for r in found})
    assert simhash.near_duplicates(table.limit(0)).count() == 0 and simhash.keep_one(table.limit(0)).count() == 0


def test_keep_one_without_ids(spark):
    table = spark.createDataFrame([(None, "only nulls here now"), (None, "only nulls here now"), (1, "quite another text instead"), (1, "quite another text instead")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(table).collect()) == ["only nulls here now", "quite another text instead"]


# --- 9 ------------------------------------------------------------------------------------------------------------------

def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "[+]", "\\[INST]", "[\\INST][\\\\/INST", "<s", "<\\/s>", "", None, "a\nb", "[", "x[", "[/INST]</s>", "<s>", "$1 \\"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate(zip(nasty, itertools.cycle(["user", "user", "assistant", "assistant", None, "a]b%5D", ""])))]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, "assistant", "first"), (3, 0, "user", "then"), (None, 1, "user", "no id"), (4, 1, None, None)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    order = lambda v: (v is not None, v or 0)
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: (order(t[0]), t[1] is not None, t[1] or "", t[2] or ""))
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(a, t or "") for _, a, t in turns]
        assert r.loss_text == "".join(t or "" for _, a, t in turns if a == "assistant")
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        assert len(re.findall(r"\[INST[ \]]", r.formatted)) == sum(1 for i, t in enumerate(turns) if i == 0 or turns[i - 1][1] != t[1])
    assert chat.format_conversations(table.limit(0)).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------------

def without_repeats(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1) if i is not None else []:
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {s + k for s in range(len(w) - window + 1) if i is not None and first[tuple(w[s:s + window])] < i for k in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 700])
def test_substring(spark, chunk_bytes):
    rows = some_texts(13)
    table = docs(spark, rows)
    found = substring.dedup_windows(table, window=4, chunk_bytes=chunk_bytes)
    assert found.columns == ["doc_id", "text", "fp", "chunk", "score", "a b", "n_words", "n_removed", "kept_text"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=repr) == without_repeats(rows, 4)
    assert substring.dedup_windows(table.limit(0)).count() == 0


def test_gap_code():
    rng = np.random.default_rng(14)
    for top in (10, 70_000, 10**9):
        cells = np.sort(rng.integers(0, top, 500).astype(np.uint64))
        assert (substring.gap_decode(substring.gap_code(cells)) == cells).all()
    exact = np.array([0, 0, 65535, 65535, 131070, 196605 + 1], np.uint64)
    assert (substring.gap_decode(substring.gap_code(exact)) == exact).all()

"""The corpus operators against brute force, on the fixture and on odd rows."""

import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from touchline.llm import common, decontam, graph, gru_lm, langid, mixing, ngram_join, pii, quality, queries, token_scan, toxicity, urls

LONG = "long words " * 4000
HUGE = "some words of a text that goes on and on, " * 40_000  # 1.7 MB
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n\r\x0b\x0c ", None, "a", 7),
    (4, "One two three. Write to a@b.com_x@y.z, +1 (234) 567-8901; 4111 1111 1111 1111 or 1.2.3.4.5!", "en", "a", 1),
    (4, "One two three. Write to a@b.com_x@y.z, +1 (234) 567-8901; 4111 1111 1111 1111 or 1.2.3.4.5!", "en", "a", 1),
    (4, "the same id, another text", "en", "b", 2),
    (5, LONG, "en", "b", 3),
    (None, "no id at all but some words", "de", "b", 4),
    (6, "É😀 4111111111111111 😀 x@é.com a.b@c.d-e.f..g", "fr", "é", 5),
    (7, "#*$%&|<> a\n\n a\na \na\na", "fr", "é", 6),
    (8, "A b C d E f G h " * 3, "en", "a", 8),
    (9, "12345678 9 " * 30, "xx", "z", 9),
    (10, "1.2.3.4" * 3 + ".1" * 3000 + "@" * 300 + "+1" + " " * 3000 + "2345678901", None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = [(1, "a b c d e f g h a b c d"), (2, "one two three"), (3, ""), (4, None), (None, "some words"), (6, "A B C D E F G H A B")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("i", "h", "s", "n", "term", "size", "bin", "kept", "copies", "label", "word", "node", "group", "_id")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in (4, 8))) for i in (3, 4, 5, 7, 8, 9, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    us = [None, "", "nohost/en/", "http://a.com/en/7?x#y", "HTTP://X.Example.COM/en/7", "https://example.com?q=/en/", "ftp://m.example.net/de/81", "a://b.org/es/://c", "http://EXAMPLE.net/de/7/index.html", "http://q.org/xx", "http://q.org/xx"]
    spark.createDataFrame(list(enumerate(us)), "page_id long, url string").withColumn("html", F.when(F.col("page_id") == 9, '<link href="http://k.com/en/1" rel="canonical">')).write.parquet(f"{d}/pages.parquet")
    vecs = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, math.nan]), (8, [math.inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [3.0, 0.1]), (None, [0.0, 1.0]), (10, [-1.0, 0.0])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("label", "node", "cls", "d1", "n", "group")}).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, odd):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def source(spark, d, t="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]


def keyed(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows_give_every_row(spark, odd, name):
    n = queries.QUERIES[name](spark, odd).count()
    assert n == (11 if "op7" in name else n if name == "pipeline" or "op11" in name or "op13" in name else len(ODD))


@pytest.fixture(params=["sf", "odd"])
def where(request, sf, odd):
    return {"sf": sf, "odd": odd}[request.param]


def test_pii(spark, where):
    got = queries.op1_sanitise_pii(spark, where).collect()
    want = []
    for r in source(spark, where):
        n, digest, text = brute.pii(r["text"])
        want.append((r["doc_id"], *n, digest))
    assert keyed([r.asDict() for r in got], "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_pii_terms_that_give_an_entity_away(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fred", "gina", "hugo"]
    near = [f"{w} madame zyzzyva wrote from x@y.com to {w} {v}" for w, v in zip(names, reversed(names))]
    rest = [f"madame wrote from home about words and words number {i}" for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near + rest)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(docs, ["doc_id"]).collect()}
    assert "zyzzyva" not in got[0]["_pii_clean"] and "[EMAIL]" in got[0]["_pii_clean"] and "madame" in got[0]["_pii_clean"]
    assert got[100]["_pii_clean"] == (near + rest)[100]


def test_pii_terms_far_from_their_entity(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fred", "gina", "hugo"]
    near = [f"{w} madame zyzzyva wrote from x@y.com to {w} {v}" for w, v in zip(names, reversed(names))]
    far = "zyzzyva said " + "many other words " * 20 + "x@y.com " + "and more of these words " * 20 + "Zyzzyva"
    rest = [f"madame wrote from home about words and words number {i}" for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near, far, *rest])], "doc_id long, text string")
    got = {r.doc_id: r["_pii_clean"] for r in pii.sanitise(docs, ["doc_id"]).collect()}
    assert "zyzzyva" not in got[8].lower() and "[EMAIL]" in got[8] and "many other words" in got[8]
    assert got[0].count("zyzzyva") == 0 and got[9] == rest[0]


def test_pii_terms_are_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "abcdefg" for b in "xyz" for c in ("lorem", "É", "ipsum")]
    entities = ["x@y.com", "10.0.0.1", "+1 234 567 8901", "a.b@c.org"]
    secret = {e: ["zyzzyva"] if k == 3 else ["annaname", "bertname"][: 1 + k % 2] for k, e in enumerate(entities)}
    docs = []
    for i in range(300):
        t = list(rng.choice(words, rng.integers(3, 60)))
        if i % 3 == 0:
            for e in rng.choice(entities, rng.integers(1, 4)):
                at = int(rng.integers(len(t) + 1))
                t[at:at] = [e, rng.choice(secret[e])] if rng.random() < 0.8 else [rng.choice(words), e]
        if i % 50 == 0:
            t.append(rng.choice(["annaname", "bertname"]))
        docs.append(" ".join(t))
    want, share = brute.disclosing(docs)
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ["doc_id"]).collect()
    got = {r.doc_id: sorted((x.s, x.e, x.kind) for x in r["_pii_terms"]) for r in rows}
    assert got == {i: sorted(w) for i, w in enumerate(want)} and sum(map(bool, want)) > 30 and {k for w in want for _, _, k in w} == {4, 5}
    for r, w in zip(sorted(rows, key=lambda r: r.doc_id), want):
        spans = sorted([(int(a), int(b), k) for k, a, b in (x.split(":") for x in brute.pii(docs[r.doc_id])[2].split(","))] if brute.pii(docs[r.doc_id])[2] else [])
        text, at = "", 0
        for a, b, k in sorted([*spans, *w], key=lambda x: x[:2]):
            text += docs[r.doc_id][at : max(at, a)] + ({4: "[TERM]", 5: ""}.get(k, f"[{str(k).upper()}]") if a >= at else "")
            at = max(at, b)
        assert r["_pii_clean"] == text + docs[r.doc_id][at:]


def test_pii_in_one_text_of_many_entities(spark):
    import time

    text = lambda n: " ".join(f"some words é of u{i}@h{i}.com" for i in range(n))
    took = []
    for n in (100, 2000, 8000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        began = time.time()
        got = pii.sanitise(docs, ["doc_id"]).first()
        took.append(time.time() - began)
        assert len(got["_pii_base"]) == n and got["_pii_clean"] == " ".join(["some words é of [EMAIL]"] * n)
    assert took[2] < 4 * took[1] + 10, took


def test_pii_of_one_address_in_many_documents(spark):
    """One entity, given away by a number of terms that grows with the documents: what a text holds bounds the join."""
    rows = lambda n: [(i, " ".join(["common words here"] * 2 + [f"t{'abcdefghij'[i // 3 % 10]}{''.join('abcdefghij'[int(c)] for c in str(i // 3))}", "joe@x.org"] + [f"tail{'xyz'[i % 3]}{i % 7 * 'q'}"])) for i in range(n)]
    docs = spark.createDataFrame(rows(1200), "doc_id long, text string")
    spanned = pii.with_spans(docs)
    near = common.materialise(pii.contexts(spanned), "contexts")
    told = common.materialise(pii.disclosures(docs, near), "disclosures")
    assert told.count() > 300
    found = pii.occurrences(spanned, told)
    assert 1000 < found.count() <= 10 * 1200  # places in the texts, of ten words each


def test_pii_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "madame zyzzyva wrote from x@y.com") for i in range(20)] + [(i, f"other words {i}") for i in range(20, 90)], "doc_id long, text string")
    assert pii.sanitise(docs, ["doc_id"]).first()["_pii_clean"] == "madame zyzzyva wrote from [EMAIL]"


def test_toxicity_learns_and_locates(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        s = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        bad = i % 4 == 0
        if bad:
            k = rng.integers(len(s))
            s[k] += " " + rng.choice(["vile", "viler", "foul"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, lab)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if brute.rest(i, 5) == 0]
    assert np.mean([(got[i].score >= 0.5) == bool(labels[i][1]) for i in held]) > 0.97
    hit = next(i for i in held if labels[i][1])
    s = got[hit].offending[0]
    assert any(w in rows[hit][1][s.start : s.end] for w in ("vile", "foul"))


def test_toxicity_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    rng = np.random.default_rng(8)
    bags = [[[int(f) for f in rng.choice(12, rng.integers(1, 5), replace=False)] for _ in range(rng.integers(1, 4))] for _ in range(30)]
    labels = [int(any(3 in s for s in d)) for d in bags]
    model = toxicity.NoisyOr().fit([np.array([f for s in d for f in s], np.int32) for d in bags], [np.array([len(s) for s in d]) for d in bags], np.array(labels))
    w, b = brute.noisy_or(bags, labels, 40, toxicity.RATE, toxicity.L1)
    assert math.isclose(model.bias, b, rel_tol=1e-6) and model.weights.keys() == {f for f, x in w.items() if abs(x) > toxicity.LEAST_WEIGHT}
    assert all(math.isclose(x, w[f], rel_tol=1e-6) for f, x in model.weights.items())
    # scores of whole texts
    model = toxicity.NoisyOr()
    model.bias, model.weights = -2.0, {toxicity.features(x)[-1]: y for x, y in (("vile", 3.0), ("kind", -1.0), ("so", 0.5))}
    texts = ["So vile. Kind words! So so", "", None, "kind kind\nVILE", "nothing of it?"]
    own = {"vile": 3.0, "kind": -1.0, "so": 0.5}
    for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        none = 1.0
        for sentence in toxicity.SENTENCE.findall((texts[r.doc_id] or "").lower()):
            if words := set(toxicity.WORD.findall(sentence)):
                none *= 1 - 1 / (1 + math.exp(-(-2.0 + sum(own.get(w, 0.0) for w in words))))
        assert math.isclose(r.score, 1 - none, abs_tol=1e-9)


def test_one_text_stands_for_a_label(spark):
    docs = spark.createDataFrame([(1, f"vile text {i}") for i in range(50)] + [(k, "kind text") for k in range(2, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 9)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.NoisyOr.fit
    try:
        toxicity.NoisyOr.fit = lambda self, found, sizes, y: seen.append(len(y)) or fit(self, found, sizes, y)
        toxicity.fit_toxicity(docs, labels)
    finally:
        toxicity.NoisyOr.fit = fit
    assert seen and seen[0] == sum(brute.rest(k, 5) != 0 for k in range(1, 9))


def test_toxicity_contract(spark, odd):
    got = queries.op2_toxicity(spark, odd).collect()
    assert all(r.held_out == (brute.rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_near_duplicates(spark, where):
    rows = sorted(source(spark, where), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    links, groups = brute.near([r["text"] for r in rows])
    want = [(r["doc_id"], rows[g]["doc_id"], n) for r, g, n in zip(rows, groups, links)]
    assert keyed([r.asDict() for r in queries.op3_ngram_join(spark, where).collect()], "doc_id", "class_id", "n_links") == sorted(want, key=repr)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    base = [str(x) for x in rng.integers(0, 999, 120)]
    texts = []
    for _ in range(90):
        t = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            t[k] = "zz"
        texts.append(" ".join(t))
    links, groups = brute.near(texts)
    got = sorted(ngram_join.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), recall=0.99999).collect(), key=lambda r: r["_id"])
    assert [r.n_links for r in got] == links and [r.class_id for r in got] == groups


def test_repeated_rows_enter_their_block_once(spark):
    words = [f"w{k}" for k in range(80)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, near), (3, "alone in this corpus")], "doc_id long, text string")
    got = sorted((r["_id"], r.class_id, r.n_links, r.n_partners) for r in ngram_join.grouped(docs).collect())
    assert got == [(1, 1, 3, 1)] * 3 + [(2, 1, 3, 1), (3, 3, 0, 0)]


def test_bands_reach_their_recall():
    for s, recall in ((0.8, 0.9995), (0.6, 0.99), (0.9, 0.999)):
        b, r = ngram_join.choose_bands(s, recall)
        assert 1 - (1 - s**r) ** b >= recall


def test_keep_one_of_each_group(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 4, 5, None, 6, 7, 8, 9, 10]))


def test_large_ids_beside_nulls(spark, tmp_path):
    big = 2**60 + 1
    spark.createDataFrame([(big, "some words of a text", "en", "a", 1), (None, "other words", "en", "a", 1)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(big, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_toxicity", "op3_ngram_join", "op4_lm_score", "op6_token_counts", "op9_language_id"):
        assert {r.doc_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == {big, None}


def test_a_text_of_megabytes(spark, tmp_path):
    rows = [(1, HUGE + "one two three", "en", "a", 1), (2, "other words of a short text that has twenty words or more, so that the fixed rules do not reject it at all", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n = len(HUGE.split()) + 3
    got = {name: {r.doc_id: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("op4_lm_score", "op5_quality_rules", "op10_decontaminate")}
    assert got["op4_lm_score"][1].n_tokens == n + 1 and math.isfinite(got["op4_lm_score"][1].score)
    assert got["op5_quality_rules"][1].n_words == n and got["op5_quality_rules"][1].base_failed
    assert got["op10_decontaminate"][1].n_words == n and got["op10_decontaminate"][1].n_hit == 3 and got["op10_decontaminate"][2].n_hit == 0
    assert {r.phrase for r in queries.QUERIES["op11_collocations"](spark, str(tmp_path)).collect()} >= {"goes on and"}
    assert [r.doc_id for r in queries.QUERIES["op13_lexical_search"](spark, str(tmp_path)).collect()] == [1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, None), (300, 301), (301, 300)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def test_language_model_base(spark, where):
    rows = [(r["doc_id"], r["text"]) for r in source(spark, where)]
    want = sorted(((i, h, n, k, total, round(b, 4)) for (i, _), (h, n, k, total, b) in zip(rows, brute.unigram(rows))), key=repr)
    got = queries.op4_lm_score(spark, where).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_network_gradient():
    rng = np.random.default_rng(0)
    k = 70
    p = {n: v.astype(np.float64) for n, v in gru_lm.initial(rng.integers(1, 50, k).astype(float)).items()}
    h, ids = rng.normal(size=(9, gru_lm.HIDDEN)), rng.choice([0, 1, *range(32, k)], 9)
    grads = {n: np.zeros_like(v) for n, v in p.items()}
    _, dh = gru_lm.output(p, h, ids, grads)
    loss = lambda: -gru_lm.output(p, h, ids)[0].mean()
    for name in ("c", "w", "wb", "cb"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), p[name].shape)
        p[name][at] += 1e-5
        up = loss()
        p[name][at] -= 2e-5
        down = loss()
        p[name][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=1e-4)
    h[2, 3] += 1e-5
    up = loss()
    h[2, 3] -= 2e-5
    assert math.isclose((up - loss()) / 2e-5, dh[2, 3], rel_tol=1e-3, abs_tol=1e-7)


def test_network_learns_and_windows_agree(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [np.array([*([32, 33, 34] * int(rng.integers(3, 40))), 0]) for _ in range(300)]
    p = gru_lm.initial(np.bincount(np.concatenate(texts), minlength=70).astype(float))
    sums = {n: np.full_like(v, 0.01) for n, v in p.items()}
    first = gru_lm.log_likelihood(p, texts).sum()
    for _ in range(4):
        gru_lm.train(p, np.concatenate(texts), sums)
    then = gru_lm.log_likelihood(p, texts)
    assert then.sum() > 0.5 * first  # log likelihoods: more than halved
    monkeypatch.setattr(gru_lm, "SCORE_WINDOW", 5)
    assert np.allclose(gru_lm.log_likelihood(p, texts), then, rtol=1e-4)
    assert np.allclose([gru_lm.log_likelihood(p, [t])[0] for t in texts[:5]], then[:5], rtol=1e-4)


def test_network_trains_on_every_token(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 400)))) for i in range(300)] + [(None, "one"), (7, None)], "doc_id long, text string")
    corpus = gru_lm.Corpus(common.materialise(gru_lm.token_table(docs), "t"))
    for n in (1, 5):
        weights, done = gru_lm.fit_network(gru_lm.token_ids(docs.repartition(n), corpus, F.lit(True)), corpus)
        assert done == corpus.n and not np.array_equal(weights, gru_lm.pack(gru_lm.initial(corpus.network_counts())))


def test_recurrent_gradient():
    rng = np.random.default_rng(4)
    k, steps, lanes = 70, 7, 3
    p = {n: v.astype(np.float64) for n, v in gru_lm.initial(rng.integers(1, 50, k).astype(float)).items()}
    x, t = rng.integers(0, 5, (steps, lanes)), rng.choice([0, 1, *range(32, k)], (steps, lanes))
    there = np.ones((steps, lanes), bool)
    there[-2:, 2] = False
    h = rng.normal(size=(lanes, gru_lm.HIDDEN))
    grads, after, _ = gru_lm.window_gradients(p, x, t, there, h)
    loss = lambda: gru_lm.window_gradients(p, x, t, there, h)[2] / there.sum()
    for name in ("x", "u", "c", "w"):
        flat = grads[name].ravel()
        for at in np.argsort(-np.abs(flat))[[0, 3, 11]]:
            i = np.unravel_index(at, p[name].shape)
            p[name][i] += 1e-5
            up = loss()
            p[name][i] -= 2e-5
            down = loss()
            p[name][i] += 1e-5
            assert math.isclose((up - down) / 2e-5, flat[at], rel_tol=1e-4)
    # a plain loop over one lane gives the same state
    s = h[0]
    for token in x[:, 0]:
        s = s * (token != gru_lm.END)
        sig = lambda v: 1 / (1 + np.exp(-v))
        m = gru_lm.HIDDEN
        z = sig(p["x"][token][:m] + s @ p["u"][:, :m])
        r = sig(p["x"][token][m : 2 * m] + s @ p["u"][:, m : 2 * m])
        c = np.tanh(p["x"][token][2 * m :] + r * (s @ p["u"][:, 2 * m :]))
        s = (1 - z) * c + z * s
    assert np.allclose(s, after[0])


def test_model_scores_are_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.geometric(0.002, rng.integers(1, 200)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = common.materialise(gru_lm.token_table(docs), "t")
    corpus = gru_lm.Corpus(counts)
    every = gru_lm.token_ids(docs, corpus, F.lit(True))
    flat, _ = gru_lm.fit_network(every, corpus)
    got = {r.doc_id: r.score for r in gru_lm.score_documents(every, corpus, flat, counts).collect()}
    known = len(corpus.network_counts())
    p, place, c = gru_lm.unpack(flat, known), {w.decode(): i + gru_lm.WORDS for i, w in enumerate(corpus.words[: gru_lm.VOCABULARY])}, dict(zip([w.decode() for w in corpus.words], corpus.c))
    rest = {}
    for w, v in c.items():
        if w not in place:
            rest[gru_lm.ending(w.encode())] = rest.get(gru_lm.ending(w.encode()), 1) + v + 1
    assert len(rest) > 20
    for i, text in rows[:12]:
        h, last, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.END, 0.0
        for w in [*text.split(), None]:
            h = gru_lm.cell(p["x"][[last]], h, p["u"])[0]
            last = gru_lm.END if w is None else place.get(w, gru_lm.ending(w.encode()))
            total += gru_lm.output(p, h, np.array([last]))[0][0] / math.log(10)
            if w is not None and w not in place:
                total += math.log10((c[w] + 1) / rest[last])
        assert math.isclose(total, got[i], rel_tol=1e-4)


def test_model_is_the_same_in_every_layout(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "STREAM_TOKENS", 700)
    monkeypatch.setattr(gru_lm, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(gru_lm, "KEPT", 1500)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{k}" for k in rng.geometric(0.002, rng.integers(1, 400)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[3], (None, None)], "doc_id long, text string")
    found = []
    for n in (1, 8):
        some = docs.repartition(n)
        counts = common.materialise(gru_lm.token_table(some), "t")
        corpus = gru_lm.Corpus(counts)
        every = gru_lm.token_ids(some, corpus, F.col("doc_id") % 5 != 0)
        found.append(sorted(((r.doc_id or -1, r.score) for r in gru_lm.score_documents(every, corpus, gru_lm.fit_network(every, corpus)[0], counts).collect())))
    assert np.allclose(*[[s for _, s in f] for f in found], rtol=1e-9, atol=1e-6)


def test_network_is_a_distribution():
    p = gru_lm.initial(np.array([5.0, 9.0, *[0.0] * 30, *np.arange(1.0, 39.0)]))
    h = np.random.default_rng(0).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    total = sum(math.exp(gru_lm.output(p, h, np.array([i]))[0][0]) for i in range(96))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_quality_counts(spark, where):
    want = []
    for r in source(spark, where):
        q = brute.quality(r["text"])
        want.append((r["doc_id"], *q, q[0] < 20 or 100 * q[4] > 30 * q[0]))
    got = [r.asDict() for r in queries.op5_quality_rules(spark, where).collect()]
    assert keyed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_sketch_is_close_and_merges(spark):
    rows = [(("en", "fr")[i % 2], "s", i * i % 100_003) for i in range(20_000)]
    df = spark.createDataFrame(rows, "lang string, source string, v long").withColumn("metric", F.lit("x"))
    bits = F.length(F.bin("v")) - 6
    binned = F.when(F.col("v") < 64, F.col("v")).otherwise(F.call_function("shiftright", F.col("v"), bits) + 32 * bits)
    bins = df.groupBy("lang", "source", "metric", binned.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    v = np.array([r[2] for r in rows])
    q = quality.quantiles(bins, []).first()
    for got, at in ((q.q1, 25), (q.q3, 75)):
        assert abs(got - np.percentile(v, at)) <= np.percentile(v, at) / 16
    assert q["size"] == 20_000


def test_quality_thresholds_follow_the_group(spark):
    plain = ["many plain words of a text that goes on and on %d" % i + " and some more words to be long enough for it" for i in range(300)]
    table = [" | ".join(f"c{(i + 1) * k}" for k in range(1, 20)) for i in range(300)]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([(t, "prose") for t in plain] + [(t, "tables") for t in table] + [(table[0] + " w", "prose")])]
    got = {r.doc_id: r["_quality_kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(got[i] for i in range(600)) and not got[600]


def test_quality_asks_for_evidence_of_repeats(spark):
    """In a group without repeats, a line that stands twice in a short text is kept; a third of many lines is not."""
    words = lambda i, a, b: " ".join(f"w{i}x{k}" for k in range(a, b))
    lines = lambda i, n, again: "\n".join([words(i, 20 * k, 20 * k + 9) for k in range(n)] + [words(i, 20 * k, 20 * k + 5) for k in range(again)] * 2)
    rows = [(i, words(i, 0, 120)) for i in range(200)]
    rows += [(200, "\n".join([words(0, 0, 13), words(200, 20, 110), words(0, 0, 13)]))]
    rows += [(201, lines(201, 3, 1)), (202, lines(202, 40, 25)), (203, lines(203, 400, 45))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = {r.doc_id: r["_quality_kept"] for r in quality.quality_rules(docs, ["doc_id"]).collect()}
    assert all(got[i] for i in range(202)) and not got[202] and not got[203]


def test_quality_evidence_is_wilsons_bound(spark):
    rows = [(0, 0), (0, 9), (1, 1), (1, 6), (20, 60), (900, 1000), (7, 5)]
    got = spark.createDataFrame(rows, "k long, n long").select(quality.evident(F.col("k"), F.col("n")).alias("v")).collect()

    def low(k, n):
        """Where the share's normal test at Z deviations would still let k of n happen, by bisection."""
        k, a, b = min(k, n), 0.0, min(k, n) / n
        for _ in range(200):
            m = (a + b) / 2
            a, b = (a, m) if k / n - m <= quality.Z * math.sqrt(m * (1 - m) / n) else (m, b)
        return a * 10_000

    for (k, n), r in zip(rows, got):
        assert abs(r.v - (low(k, n) if n else 0)) <= 1


def test_token_counts(spark, where):
    import tiktoken

    with open(token_scan.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=token_scan.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r["doc_id"], len(e.encode_ordinary(r["text"] or ""))) for r in source(spark, where)), key=repr)
    assert keyed([r.asDict() for r in queries.op6_token_counts(spark, where).collect()], "doc_id", "n_tokens") == want


def test_separator_scan_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "SPAN", 8)
    rng = np.random.default_rng(1)
    want = []
    for f in range(3):
        a = rng.integers(0, 9, 4000 + f).astype("<u2")
        a[a == 3] = token_scan.SEPARATOR
        a[500:900] = 1  # a document over many blocks
        a.tofile(tmp_path / f"{f}.tokens")
        ends = np.flatnonzero(a == token_scan.SEPARATOR)
        want += [(f"{f}.tokens", i, int(n), True) for i, n in enumerate(np.diff(np.concatenate([[-1], ends])) - 1)]
        if ends[-1] < len(a) - 1:
            want.append((f"{f}.tokens", len(ends), int(len(a) - 1 - ends[-1]), False))
    (tmp_path / "e.tokens").write_bytes(b"")
    assert sorted(map(tuple, token_scan.token_counts(spark, f"file://{tmp_path}", block_bytes=20).collect())) == sorted(want)
    (tmp_path / "odd.tokens").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_scan.token_counts(spark, f"file://{tmp_path}")


def used_partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_blocks_are_many_tasks_work(spark, tmp_path):
    """Numbered partitions: the few rows that stand for blocks are not coalesced into one task."""
    np.zeros(306 * 64, f"<u{token_scan.WIDTH}").tofile(tmp_path / "a.tokens")
    blocks = token_scan.blocks_of(spark, f"file://{tmp_path}", 64 * token_scan.WIDTH)
    assert blocks.count() == 306
    assert used_partitions(token_scan.separators(blocks, f"file://{tmp_path}")) >= 8


def test_many_copies_are_many_tasks_work(spark):
    again = spark.createDataFrame([(1, 5, 3_000_000)], "r_id long, r_hash long, n long")
    rows = spark.createDataFrame([(1, 5, 7), (2, 6, 8)], "_id long, _hash long, v int")
    out = decontam.repeated(rows, common.materialise(again, "again"))
    assert out.count() == 3_000_001 and used_partitions(out.where("_id = 1")) >= 8


def test_urls(spark, where):
    got = {r.page_id: r for r in queries.op7_url_filter(spark, where).collect()}
    for r in source(spark, where, "pages"):
        host, path, rule, verdict = brute.url(r["url"])
        g = got[r["page_id"]]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == verdict if verdict else g.verdict in ("allow", "block")


def test_url_blocks_reach_aliases(spark):
    pages = spark.createDataFrame([(1, "http://a.info/x"), (2, "http://b.info/y"), (3, "http://c.info/z"), (4, "http://d.info/w"), (5, "http://www.a.info/x/#top")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("http://a.info/x", "http://k.com/en/1"), ("http://b.info/y", "http://k.com/en/2"), ("http://b.info/y", "http://example.com/en/7"), ("http://c.info/z", "http://a.info/x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, edges=edges).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_links_are_resolved(spark):
    forms = {"/de/8": "http://h.org/de/8", "//k.com/en/1": "http://k.com/en/1", "x?a=1&amp;b=2": "http://h.org/p/q/x?a=1&b=2", "../y": "http://h.org/p/y", "./": "http://h.org/p/q/", "?z": "http://h.org/p/q/r?z", "https://k.com/a?b&amp;c": "https://k.com/a?b&c", "/go?u=http://k.com/": "http://h.org/go?u=http://k.com/", "mailto:a@b.com": None}
    tags = ('<link rel=canonical href="{}">', '<meta http-equiv="refresh" content="0;url={}">')
    rows = [(f"http://h.org/p/q/r?s{k}#t", tag.format(link), want) for k, (tag, (link, want)) in enumerate((t, f) for t in tags for f in forms.items())]
    edges = [(r.src, r.dst) for r in urls.link_edges(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()]
    for url, _, want in rows:
        assert {b for a, b in edges if a == url} == {"https://h.org/p/q/r", *([want] if want else [])}
    assert {a for a, b in edges} <= {x for r in rows for x in (r[0], r[2])}
    bare = spark.createDataFrame([("http://h.org", '<link rel="canonical" href="a">')], "url string, html string")
    assert "http://h.org/a" in {r.dst for r in urls.link_edges(bare).collect()}
    pages = spark.createDataFrame([(1, "http://h.com/x/1", '<link rel="canonical" href="/en/1">'), (2, "http://h.com/en/1", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages).collect()} == {1: "block", 2: "block"}


LINKED = [
    (1, "https://a.info/one", '<link rel="canonical" href="http://www.z.info/p/">'),
    (2, "https://z.info/p", '<link rel=canonical href="http://k.com/en/1">'),
    (3, "http://b.info/q/r", '<link rel="canonical" href="s?x&amp;y"><LINK href=/en/none rel="canonical"/>'),
    (4, "http://b.info/q/s?x&y", '<p><meta http-equiv="refresh" content="0; URL=//b.com/en/2"></p>'),
    (5, "http://c.info/1", '<link rel="canonical" href="http://k.com/en/5"><meta http-equiv=refresh content="3;url=http://example.com/en/7">'),
    (6, "http://d.info/1", '<link rel="stylesheet" href="http://k.com/en/6">'),
    (7, "http://m.d.info/1/index.html#top", '<link rel="canonical" href="#here">'),
    (8, None, '<link rel="canonical" href="http://k.com/en/8">'),
    (9, "http://e.info/1", '<link rel="canonical" href="mailto:x@y.z">'),
    (10, "http://f.info/", '<link rel="canonical" href="?page=2">'),
    (11, "http://k.com/en/9", None),
    (12, "http://g1.info/1", '<link class="a>b" rel="nofollow canonical" href="http://k.com/en/12">'),
    (13, "http://g2.info/1", '<link rel=canonical data-href="http://example.com/en/7" href=\'http://k.com/en/13\'>'),
    (14, "http://g3.info/1", '<base target=x><base href="http://k.com/en/"><base href="/other/"><link rel=canonical href="14">'),
    (15, "http://g4.info/1", '<link rel="canonical" href="http:&#x2F;&#47;k.com&#x2f;en/15?a=&quot;&amp;lt;&#233;">'),
    (16, "http://g5.info/1", '<meta http-equiv=Refresh content="0; http://k.com/en/16">'),
    (17, "http://g6.info/1", '<!-- <link rel=canonical href="http://k.com/en/17"> --><p>text <!-- unclosed <meta http-equiv=refresh content="0;url=http://k.com/en/17">'),
    (18, "http://g7.info/1", '<meta http-equiv="refresh" content="5"><meta content="1;URL=\'http://k.com/en/18\'" http-equiv="refresh">'),
    (19, "http://g8.info/1", '<link rel="canonical" rel="other" href="http://k.com/en/19" href="http://example.com/en/7"><link rel="canonicals" href="http://example.com/en/7">'),
    (20, "http://g9.info/1", '<link rel="canonical" href="http://k.com/en/&#55296;&#0;&bogus;"><link title="\'" rel=canonical href=" http://k.com/en/20 ">'),
]


def test_links_carry_verdicts(spark, tmp_path):
    from tests import oracle

    spark.createDataFrame(LINKED, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.verdict, r.component_size) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    blocked = {k for k, (v, _) in got.items() if v == "block"}
    assert blocked == {1, 2, 3, 4, 11, 12, 13, 14, 15, 16, 18, 19, 20} and got[8] == ("allow", 1) and got[9][0] == "allow"
    one = tmp_path / "one"
    one.mkdir()
    spark.read.parquet(f"{tmp_path}/pages.parquet").toPandas().to_parquet(one / "pages.parquet")
    c = __import__("duckdb").connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{one}/pages.parquet'")
    oracle.compare(spark, c, queries.op7_url_filter, queries.ORACLE_SQL["op7_url_filter"], str(tmp_path))


def test_mixing(spark, where):
    rows = source(spark, where)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
    goal = brute.targets(sizes)
    out = mixing.sample_mix(spark.read.parquet(f"{where}/documents.parquet"), ["doc_id", "source"]).collect()
    taken, biggest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in out:
        assert r["_mix_source_size"] == sizes[r.source] and math.isclose(r["_mix_target"], goal[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["_mix_copies"] <= 2
        taken[r.source] += r["_mix_copies"] * r["_mix_size"]
        biggest[r.source] = max(biggest[r.source], r["_mix_size"])
    assert all(abs(taken[s] - goal[s]) <= biggest[s] for s in sizes)
    again = mixing.sample_mix(spark.read.parquet(f"{where}/documents.parquet").repartition(3), ["doc_id", "source"]).collect()
    assert keyed([r.asDict() for r in out], "doc_id", "_mix_size", "_mix_copies") == keyed([r.asDict() for r in again], "doc_id", "_mix_size", "_mix_copies")


@pytest.mark.parametrize("doc_id", [7, None])
@pytest.mark.parametrize("texts", [1, 40])
def test_ties_are_cut_row_by_row(spark, doc_id, texts):
    rows = [(doc_id, "a", " ".join([f"w{i % texts}"] * 20)) for i in range(1000)] + [(k, "b", "x " * 10) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = {"a": 20_000, "b": 3_000}
    for n in (1, 5):
        out = mixing.sample_mix(docs.repartition(n), ["doc_id", "source", "text"], weights=(3, 2), share=0.75).collect()
        for s, size in (("a", 20), ("b", 10)):
            mine = [r for r in out if r.source == s]
            goal = mine[0]["_mix_target"]
            assert sum(r["_mix_source_size"] for r in mine) == total[s] * len(mine)
            assert abs(sum(r["_mix_copies"] * size for r in mine) - goal) <= size / 2 + 1e-6
        taken = sorted((r.text, r["_mix_copies"]) for r in out if r.source == "a")
        assert n == 1 or taken == before
        before = taken


def test_mixing_without_a_scale(spark):
    rows = [(k, "s", "w " * (64 + k % 2)) for k in range(500)]
    out = mixing.sample_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"], weights=(1,), share=0.9999).collect()
    assert abs(sum(r["_mix_copies"] * r["_mix_size"] for r in out) - out[0]["_mix_target"]) <= 65


def test_larger_documents_are_likelier(spark):
    rows = [(i, "s", "w " * (1 if i % 2 else 9)) for i in range(4000)] + [(9999, "t", "w " * 4000)]
    out = mixing.sample_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"], weights=(1, 5), share=0.6).where("source = 's' and _mix_copies > 0").collect()
    big = sum(r["_mix_size"] == 9 for r in out) / max(1, len(out))
    assert 0.6 < big < 0.9  # 3 to 1 by the square root of the size


def test_languages(spark, sf):
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    rows = source(spark, sf)
    held = [r for r in rows if brute.rest(r["doc_id"], 5) == 0]
    assert np.mean([got[r["doc_id"]].lang_pred == r["lang"] for r in held]) > 0.9
    assert all(got[r["doc_id"]].held_out == (brute.rest(r["doc_id"], 5) == 0) for r in rows)


def test_languages_are_brute_force(spark):
    letters = langid.Letters(64)
    known = [("en", "The quick brown fox, 12 jumps!"), ("en", "over the lazy dog"), ("de", "Der schnelle Füchs  springt"), ("de", "über den faulen Hund"), ("xx", "\U00030001\U00030002 \U00030003")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(known)] + [(10, "the fox", None), (11, "  Hund und Füchse -- ", None), (12, "123 !", None), (13, None, None), (14, "\U00030002\U00030003", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.prototypes(docs, 64), 64).collect()}
    want = {}
    for lang, t in known:
        v = brute.profile(t, letters._letter)
        want[lang] = v if lang not in want else [x + y for x, y in zip(want[lang], v)]
    for r in docs.collect():
        if r.doc_id in (12, 13):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        best = max((brute.cosine(brute.profile(r.text, letters._letter), v), k) for k, v in want.items())
        assert got[r.doc_id].lang_pred == best[1] and math.isclose(got[r.doc_id].score, (1 + best[0]) / 2, abs_tol=1e-5)
    assert got[14].lang_pred != "und"


def test_language_edges(spark, odd):
    got = queries.op9_language_id(spark, odd).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_ngram_vectors_bind_permuted_letters():
    x = langid.Letters(64)
    ids, n = x.grams("aab")
    a, b, gap = x._letter(ord("a")), x._letter(ord("b")), x._letter(0)
    want = {tuple(np.roll(p, 2) * np.roll(q, 1) * r) for p, q, r in ((gap, a, a), (a, a, b), (a, b, gap))}
    assert {tuple(v) for v in x.bound(ids)} == want and n.tolist() == [1, 1, 1]


def test_decontamination(spark, where):
    rows = source(spark, where)
    items = [(r["item_id"], r["text"]) for r in source(spark, where, "benchmark")]
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute.decontaminate([r["text"] for r in rows], items))), key=repr)
    got = [r.asDict() for r in queries.op10_decontaminate(spark, where).collect()]
    assert keyed(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_repeated_rows_are_looked_up_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontam, "COPIES", 10)
    text = "one two three of some words"
    rows = [(1, text)] * 57 + [(1, "another text"), (2, text), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two three of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words, again = decontam.word_table(spark.createDataFrame(rows, "doc_id long, text string"))
    assert words.count() == 4 and sorted(r.n for r in again.collect()) == [2, 57]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_near_items) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 6, 3, 1)] * 57 + [(1, 2, 0, 0), (2, 6, 3, 1)] + [(None, 0, 0, 0)] * 2, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_proximity(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "is_small", lambda df: broadcast)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("delta epsilon", "delta x y epsilon")
    docs = spark.createDataFrame([(1, "q " + near), (2, item), (3, "alpha beta")], "doc_id long, text string")
    got = {r["_id"]: r for r in decontam.matches(decontam.word_table(docs)[0], spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].n_hit is None and got[1].n_near == 1 and got[2].n_hit == 10 and 3 not in got


def near_items(t, items):
    """Items of which a window has 4 in 5 of its words within SLOP of their places from some start."""
    w, n, found = brute.tokens10(t), decontam.SLOP, set()
    for i, x in items:
        x = brute.tokens10(x)
        for win in [x[k : k + 10] for k in range(len(x) - 9)] if len(x) >= 10 else ([x] if x else []):
            for s in range(-10, len(w) + 4) if len(set(win) & set(w)) else ():
                if sum(v in w[max(0, s + k - n) : max(0, s + k + n + 1)] for k, v in enumerate(win)) >= len(win) - len(win) // 5:
                    found.add(i)
                    break
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_proximity_is_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "is_small", lambda df: broadcast)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    draw = lambda n: [words[k] for k in np.minimum(59, rng.geometric(0.06, n))]
    items = [(i, " ".join(draw(14) if i % 4 else draw(4))) for i in range(30)] + [(30, "rare1 rare2 nowhere w1 w2 w3 w4 w5 w6 w7")]
    docs = [" ".join(draw(60)) for _ in range(30)] + ["rare1 alone here", "q rare1 rare2 other w1 w2 w3 w4 w5 w6 w7", "rare2 w1 w2 w3 w4 w5 w6 w7"]
    for i, t in items:
        x = draw(8) + t.split() + draw(8)
        for _ in range(3):
            k = int(rng.integers(len(x)))
            x[k : k + 1] = [[], [x[k], "zz"], ["zz"]][int(rng.integers(3))]
        docs.append(" ".join(x))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["_id"]: r.n_near for r in decontam.matches(decontam.word_table(frame)[0], spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: n for i, t in enumerate(docs) if (n := len(near_items(t, items)))}
    assert got == want and len(want) > 20 and 30 not in got and 31 in got and 32 in got


def test_pipeline_leaves_its_result_alone(spark, odd):
    import corpus_pipeline as c

    before = set(common._written)
    out = c.run(spark, odd)
    assert common._written - before == {out._corpus_path} and out.count() >= 0


def test_a_cluster_needs_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_pipeline_stages(spark, where):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(c.STAGES):
        before = docs
        docs = common.materialise(stage(spark, before, where), "t")
        assert docs.columns == columns if k < 4 else set(docs.columns) == {*columns, "copies"}
        if k == 0:
            kept = [r for r in docs.collect()]
            assert all(len(brute.WORD.findall(r.text)) >= 20 for r in kept)
        if k == 1:
            links, _ = brute.near([r.text for r in docs.collect()])
            rows = [r.text for r in before.collect()]
            assert docs.count() == len(set(brute.near(rows)[1]))
            del links
        if k == 2:
            items = [(r["item_id"], r["text"]) for r in source(spark, where, "benchmark")]
            rows = before.collect()
            clean = [r.doc_id for r, x in zip(rows, brute.decontaminate([r.text for r in rows], items)) if not x[4]]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(clean)
        if k == 3:
            assert all(not brute.pii(r.text)[2] and r.n_chars == len(r.text) for r in docs.collect())
        if k == 4:
            assert all(r.copies in (1, 2) for r in docs.collect())

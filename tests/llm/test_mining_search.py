"""Collocations, embedding near-duplicates and lexical search against brute force."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_corpus import empty, odd  # noqa: F401  fixtures
from touchline.llm import collocations, lexical, queries, rp_forest


def phrases(docs, least, top, longest=3):
    """lang, rank, phrase, a, l, r, n, score by the contract, for (text, lang) rows."""
    out = []
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und" if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, c[p[:k]], c[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def mixed_texts():
    rng = np.random.default_rng(3)
    words = ["de", "la", "New", "york", "éa", "_x", "a-b", "\x00", "\x85", "The"]
    texts = [" ".join(rng.choice(words, 12)) + rng.choice([".", "\n", ",", "\t", ""]) + " new york city " * int(rng.integers(0, 4)) for _ in range(160)]
    return [(t, [None, "en", "und", "é", "en"][k % 5]) for k, t in enumerate(texts)] + [(None, "en"), ("", None), (" \t", "only blanks"), ("a a a a a a a a a a a a a", "again"), ("a b " * 30_000, "long")]


@pytest.mark.parametrize(("most", "longest"), [(30, 3), (10**6, 4), (0, 4)])
def test_collocations_are_brute_force(spark, most, longest):
    """By broadcast, by shuffle, and by broadcast of the words alone."""
    docs = mixed_texts()
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), longest=longest, least=4, top=15, most=most)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases(docs, 4, 15, longest)


def test_collocations_flush_their_counts(spark, monkeypatch):
    for name in ("MOST_COUNTED", "MOST_CODES"):
        monkeypatch.setattr(collocations, name, 3)
    docs = mixed_texts()
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), least=4, top=2000)
    assert sorted(map(tuple, got.collect())) == phrases(docs, 4, 2000)


def test_scores_pass_64_bits(spark):
    big = 5_000_000_000
    levels = [spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, c long"), spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, c long")]
    assert collocations.scored(levels).first()["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_top_rows_of_a_large_group(spark):
    from touchline.llm.common import top_rows

    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("v"), "id")
    got = top_rows(rows, "k", [F.desc("v"), F.asc("id")], 50)
    assert sorted((r["rank"], r["id"]) for r in got.collect()) == [(i + 1, 6 + 7 * i) for i in range(50)]


def vectors(rows, least=0.95):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows, by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good, strict=True)]
    for i, j in itertools.combinations([i for i in range(n) if good[i]], 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            links[i], links[j] = links[i] + 1, links[j] + 1
            root[find(i)] = find(j)
    least_id = defaultdict(list)
    for i in range(n):
        least_id[find(i)].append(rows[i][0])
    first = {r: min((x for x in ids if x is not None), default=None) for r, ids in least_id.items()}
    return sorted(((rows[i][0], links[i], first[find(i)], rows[i][0] == first[find(i)]) for i in range(n)), key=repr)


def clustered(seed, groups, size, spread, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        out += [centre / np.linalg.norm(centre) * rng.uniform(0.1, 9) + rng.standard_normal(dim) * spread * rng.uniform(0, 1) for _ in range(int(rng.integers(1, size)))]
    return [(k, v.astype(float).tolist()) for k, v in enumerate(out)]


def test_vectors_are_brute_force(spark, monkeypatch):
    """Loose and dense groups, copies, a chain, odd rows, through rounds of splits and blocks of small leaves."""
    monkeypatch.setattr(rp_forest, "LEAF", 48)
    monkeypatch.setattr(rp_forest, "LEVELS", 3)
    rows = clustered(1, 60, 12, 0.08) + clustered(2, 3, 120, 0.01)
    chain = [[math.cos(a / 5), math.sin(a / 5), *[0.0] * 14] for a in range(12)]
    rows = [(k, v) for k, (_, v) in enumerate(rows + [(0, v) for v in chain + chain[:1] * 40])]
    rows += [(rows[5][0], rows[5][1]), (None, rows[7][1]), (9001, None), (9002, [0.0] * 16), (9003, [math.nan] * 16), (9004, [None] * 16), (9005, [1.0]), (9006, [1e200] * 16), (9007, [1e-200] * 16), (9008, [])]
    got = rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), recall=1 - 1e-6)
    assert sorted(map(tuple, got.collect()), key=repr) == vectors([(i, [x * 1e-198 for x in v] if v and v[0] == 1e200 else [x * 1e198 for x in v] if v and v[0] == 1e-200 else v) for i, v in rows])


def test_odd_vectors(spark, odd):  # noqa: F811
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_embedding_near_dedup"](spark, odd).collect()), key=repr) == vectors(rows)


def test_forest_reaches_its_recall(spark, monkeypatch):
    """Pairs just above the threshold, the hardest to meet in a leaf; deep trees."""
    monkeypatch.setattr(rp_forest, "LEAF", 64)
    rng = np.random.default_rng(4)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.951
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([a, c * a + math.sqrt(1 - c * c) * b]))], "vec_id long, embedding array<float>")
    assert rp_forest.near_vectors(rows).where("n_links > 0").count() >= 0.99 * 3000


def test_trees_follow_the_number_of_vectors():
    assert rp_forest.choose_trees(100) == 1
    assert rp_forest.choose_trees(10**4) < rp_forest.choose_trees(10**9) < 16


def ranked(docs, items, top=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t))
    have = [(i, Counter(cut(t))) for i, t in docs if t is not None and cut(t)]
    n_docs, length = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(w for _, c in have for w in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, c in have:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in cut(text) if w in c)
            if score > 0:
                rows.append((doc_id, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(item, k + 1, *r) for k, r in enumerate(rows[:top])]
    return sorted(out, key=repr)


def test_search_is_brute_force(spark, odd, monkeypatch):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_lexical_search"](spark, odd).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranked(docs, items)
    rng = np.random.default_rng(9)
    words = ["é", "a_b", "the", "of", "X1", "ñandú", "zz", "…", "it's"]
    docs = [(k if k % 11 else None, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for k in range(300)] + [(5, "the of"), (5, "the of"), (7, "x1 " * 400_000)]
    items = [(1, "the the of é"), (1, "the the of é"), (2, "nowhere"), (3, "x1 X1 zz it"), (None, "b ñandú"), (4, "")]
    monkeypatch.setattr(lexical, "MOST_TERMS", 5)  # several groups of items
    monkeypatch.setattr(lexical, "BLOCK", 37)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), top=6)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranked(docs, items, 6)

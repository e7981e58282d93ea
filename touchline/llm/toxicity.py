"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Each sentence has a logistic score over its words and their beginnings; a document's score is their noisy-or, 1 - prod(1 - p). Only documents
carry labels: the gradient of the noisy-or spreads a label over the sentences that explain it, and afterwards the
sentence scores locate what offends. The model is fitted on a bounded sample of labelled documents (MOST_FIT, the least
digests of doc_id, all of them where there are fewer; of several rows of one doc_id the text with the least digest);
weights nearer to 0 than LEAST_WEIGHT are left out of it. Scoring runs over every text whole.

Null and empty texts score 0 sentences: probability 0. Labels that are null, or contradict each other for one doc_id, are
not learned from. Without labels of both kinds every score is 0. Repeated rows get equal scores. An empty table gives an
empty result. labels, lang, source and doc_id are never inputs of a score; other columns are ignored. Long texts are
scored sentence by sentence; offending sentences of equal score keep their order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_number, as_text, key_hash, materialise, table

#: Labelled documents that the model is fitted on, at most.
MOST_FIT = 6000
#: A feature needs so many fitted documents to get a weight.
LEAST_DOCS = 6
STEPS, RATE, L1 = 250, 0.1, 5e-5
#: A word's features: itself, and its beginnings of these lengths.
PREFIXES = (4, 5, 6, 7)
#: A feature is fitted if documents with it are toxic more often, by so many standard errors.
LEAST_Z = 2.0
#: Smaller weights are not kept.
LEAST_WEIGHT = 0.05
#: Word scores that a task keeps.
MOST_KEPT = 500_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of doc_id as text; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def features(word: str) -> list[int]:
    """32-bit ids of a word and of its beginnings."""
    return [zlib.crc32(f.encode("utf-8", "replace")) for f in (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k))]


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            cut = [[f for w in set(WORD.findall(s)) for f in features(w)] for s in SENTENCE.findall((text or "").lower())]
            cut = [s for s in cut if s]
            rows.append((np.array([f for s in cut for f in s], np.uint32).view(np.int32), np.array([len(s) for s in cut], np.int32)))
        yield pd.DataFrame({"label": pdf["label"], "found": [x for x, _ in rows], "sizes": [x for _, x in rows]})


class NoisyOr:
    """Feature weights and a bias; fit() by proximal Adam steps on the mean log loss of the documents."""

    def __init__(self):
        self.weights: dict[int, float] = {}
        self.bias = -50.0
        self.known: dict[str, float] = {}

    def fit(self, found: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> NoisyOr:
        """found: the feature ids of a document, sentence by sentence; sizes: how many each sentence has."""
        if len(set(labels.tolist())) < 2:
            return self
        ids = np.unique(np.concatenate(found).astype(np.int32))
        if not len(ids):
            return self
        doc = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
        sent = np.repeat(np.arange(len(doc)), np.concatenate(sizes).astype(np.int64))
        word, y = np.searchsorted(ids, np.concatenate(found).astype(np.int32)), labels.astype(float)
        theta, b = np.zeros(len(ids)), -np.log(len(doc) / max(1.0, y.sum()))
        m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
        for t in range(1, STEPS + 1):
            z = b + np.bincount(sent, theta[word], len(doc))
            a = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(y)), 1e-9)
            p = 1 / (1 + np.exp(-z))
            g = p * np.where(y > 0, -1 / np.expm1(np.minimum(a, 50)), 1.0)[doc] / len(y)
            gt, gb = np.bincount(word, g[sent], len(theta)), g.sum()
            m, v = 0.9 * m + 0.1 * gt, 0.99 * v + 0.01 * gt * gt
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            scale = RATE / (np.sqrt(v / c2) + 1e-7)
            theta = theta - scale * m / c1
            theta = np.sign(theta) * np.maximum(0, np.abs(theta) - scale * L1)
            b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
        self.weights = {int(ids[k]) % 2**32: float(theta[k]) for k in np.flatnonzero(np.abs(theta) > LEAST_WEIGHT)}
        self.bias = float(b)
        return self

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """start, end, z of every sentence with words; offsets count code points."""
        known, get, out = self.known, self.weights.get, []
        if len(known) > MOST_KEPT:
            known.clear()
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a few letters lower to two characters: then lower each sentence by itself
            low = text
        for s in SENTENCE.finditer(low):
            words = set(WORD.findall(s[0].lower() if low is text else s[0]))
            if words:
                for w in words:
                    if w not in known:
                        known[w] = sum([get(f, 0.0) for f in features(w)])
                out.append((s.start(), s.end(), self.bias + sum([known[w] for w in words])))
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT) -> NoisyOr:
    """Fit on at most `most` labelled documents that are not held out."""
    agreed = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other and label in (0, 1)")
    some = agreed.where(~held_out(F.col("doc_id"), 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("lid"), F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("lid"))  # at most `most` rows
    one = rows.groupBy("lid").agg(F.min_by(F.struct("text", "label"), F.struct(key_hash(F.col("text")), F.length("text"))).alias("r"))
    rows = one.select("r.text", "r.label")
    bags = materialise(rows.mapInPandas(_sentences, "label int, found array<int>, sizes array<int>"), "bags")
    toxic, every = (int(x or 0) for x in bags.agg(F.sum("label"), F.count("*")).first())
    if not 0 < toxic < every:
        return NoisyOr()
    a, n = F.col("a") / toxic, F.col("n") / every
    z = (a - (F.col("n") - F.col("a")) / (every - toxic)) / F.sqrt(n * (1 - n) * (1 / toxic + 1 / (every - toxic)))
    seen = bags.select("label", F.explode(F.array_distinct("found")).alias("f")).groupBy("f").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    told = seen.where((F.col("n") >= LEAST_DOCS) & (F.col("n") < every)).where(z >= LEAST_Z).toPandas()["f"].to_numpy(np.int32)  # features of the bounded sample
    asked = docs.sparkSession.sparkContext.broadcast(np.sort(told))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [np.isin(x, asked.value).astype(bool) for x in pdf["found"]]
            sizes = [np.bincount(np.repeat(np.arange(len(s)), np.asarray(s, np.int64)), k, len(s)).astype(np.int32) for s, k in zip(pdf["sizes"], kept, strict=True)]
            yield pd.DataFrame({"label": pdf["label"], "found": [x[k] for x, k in zip(pdf["found"], kept, strict=True)], "sizes": sizes})

    got = bags.mapInPandas(known, bags.schema).toPandas()
    return NoisyOr().fit(list(got["found"]), list(got["sizes"]), got["label"].to_numpy())


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score and offending (start, end, score of the sentences at 0.5 or more, worst first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = NoisyOr()
        m.weights, m.bias = shared.value
        for pdf in batches:
            scores, bad = [], []
            for text in pdf["text"]:
                found = m.sentence_scores(text)
                z = np.array([x[2] for x in found])
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0)
                bad.append(sorted(((s, e, float(1 / (1 + np.exp(-q)))) for s, e, q in found if q >= 0), key=lambda x: -x[2]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "offending": [[{"start": s, "end": e, "score": p} for s, e, p in x] for x in bad]})

    return as_number(as_text(docs, "text").mapInPandas(run, "doc_id string, score double, offending array<struct<start:int,end:int,score:double>>"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("offending"))

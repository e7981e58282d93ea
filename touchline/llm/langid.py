"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
by its place; a text's vector bundles (sums) those of its n-grams; a language's prototype bundles its texts. A text gets
the language whose prototype has the largest cosine with it. N-grams are counted first, per text and per language, and
bound once for each distinct one, which gives the same sums. Prototypes come from all labelled documents that are not
held out; a language's counts merge by addition, so the number of rows moved is bounded by languages times dimensions.

Null texts, and those without a letter, are 'und' with score 0. Null languages are not learned from; without any language
all are 'und'. Of languages with equal cosines the first by code point wins. Repeated rows are treated alike. An empty table
gives an empty result. Other columns are ignored. A text's memory follows its distinct n-grams; texts are handled in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_number, as_text, slices, table
from .toxicity import held_out

N = 3
DIMENSIONS = 512
LETTERS = 1 << 21
#: Texts that are handled at a time, in prediction and in learning.
BLOCK, SLICE = 128, 512


PLANES = 0x30000


def _letter_code(c: int) -> int:
    """The lower-case letter of a code point, 0 for what is no letter."""
    if not (ch := chr(c)).isalpha():
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


def _folding() -> np.ndarray:
    """_letter_code of the code points below PLANES; the few letters beyond are looked up when met."""
    return np.array([_letter_code(c) for c in range(PLANES)], np.int64)


class Letters:
    """Vectors of letters, permuted by place, made on demand from a fixed seed."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.fold, self.made = dimensions, _folding(), {}

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Packed distinct n-grams of letters and gaps, with counts; n-grams of gaps alone do not count."""
        raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        c = self.fold[np.minimum(raw, PLANES - 1)]
        if (far := raw >= PLANES).any():
            codes, at = np.unique(raw[far], return_inverse=True)
            c[far] = np.array([_letter_code(int(x)) for x in codes])[at]
        c = c[(c > 0) | (np.concatenate(([1], c[:-1])) > 0)]  # a run of gaps is one
        c = np.concatenate(([0], c, [0]))
        g = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
        return np.unique(g[g > 0], return_counts=True) if c.any() else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _letter(self, c: int) -> np.ndarray:
        if (v := self.made.get(c)) is None:
            v = self.made[c] = np.random.default_rng(7_000_003 + c).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return v

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """A row for each packed n-gram: the product of its letters' vectors, rotated by place."""
        out = np.ones((len(grams), self.dimensions), np.float32)
        rest = grams
        for place in range(N):
            codes, at = np.unique(rest % LETTERS, return_inverse=True)
            rest = rest // LETTERS
            out *= np.stack([np.roll(self._letter(int(c)), place) for c in codes])[at] if len(codes) else out
        return out


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Bundles of each language's documents: integer sums, merged on the cluster by language and dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, total = Letters(dimensions), {}
        for pdf in slices(batches, SLICE):
            for lang, part in pdf.groupby("lang"):
                found = [letters.grams(t) for t in part["text"]]
                ids, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                for k in range(0, len(ids), 4096):
                    inside = (at >= k) & (at < k + 4096)
                    n = np.bincount(at[inside] - k, np.concatenate([c for _, c in found])[inside], min(4096, len(ids) - k))
                    total[lang] = total.get(lang, 0) + n.astype(np.float64) @ letters.bound(ids[k : k + 4096]).astype(np.float64)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "d": np.arange(dimensions), "v": np.rint(v).astype(np.int64)})

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInPandas(run, "lang string, d int, v long")
    summed = rows.groupBy("lang", "d").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("v"))
    return {r["lang"]: np.array([x["v"] for x in r["v"]], float) for r in summed.orderBy("lang").collect()}  # one row a language


def identify(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred and score ((1 + cosine) / 2) of every document."""
    names = sorted(learned)
    unit = np.stack([learned[n] / max(1e-9, np.linalg.norm(learned[n])) for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (names, unit), letters = shared.value, Letters(dimensions)
        for pdf in batches:
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            for k in range(0, len(pdf) if names else 0, BLOCK):
                found = [letters.grams(t) for t in pdf["text"].iloc[k : k + BLOCK]]
                sizes = [len(g) for g, _ in found]
                ids, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                owner, n = np.repeat(np.arange(len(found)), sizes), np.concatenate([c for _, c in found]).astype(np.float32)
                v = np.zeros((len(found), dimensions), np.float32)
                for low in range(0, len(ids), 4096):
                    inside = (at >= low) & (at < low + 4096)
                    counts = np.zeros((len(found), min(4096, len(ids) - low)), np.float32)
                    counts[owner[inside], at[inside] - low] = n[inside]
                    v += counts @ letters.bound(ids[low : low + 4096])
                cosine = v @ unit.T / np.maximum(1e-9, np.linalg.norm(v, axis=1))[:, None]
                some = np.flatnonzero(np.array(sizes) > 0)
                best = cosine.argmax(1)
                lang[k + some] = np.array(names, object)[best[some]]
                score[k + some] = np.clip((1 + cosine[some, best[some]]) / 2, 0, 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return as_number(as_text(docs, "text").mapInPandas(run, "doc_id string, lang_pred string, score double"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = prototypes(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return identify(docs, learned).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")

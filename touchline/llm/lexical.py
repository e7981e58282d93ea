"""Ranked lexical search as a blocked sparse matrix product: items by terms (how often) times terms by documents (impacts).

One pass cuts every text and writes each document's row of the term matrix, for the terms that the items ask for: 32-bit
term numbers and counts, with the document's length. Document frequencies, the number of documents and their length are sums
over these rows. A second pass puts BLOCK documents at a time together as a block of columns, turns counts into int64
impacts and forms an item's row of the product as Gustavson does: the impact rows of its terms, times their multiplicity,
are merged into one row of the block. A block, then a task, keeps the first `top` of each item; those of all tasks are cut
down in two levels.

Items go in groups of at most MOST_TERMS words, or one item, so that the item matrix and the term numbers a task holds are
bounded; the corpus is read once for each group. A null text has no terms; an item without terms, or whose terms no document
holds, has no result. Each row of the items is ranked by itself, repeated rows and null ids too; repeated documents each take
a rank. Equal scores are ordered by doc_id, null last. An empty table gives an empty result. Other columns are ignored. A long
text is one column of a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_number, as_text, materialise, table, text_runs, top_rows

TOP = 20
MOST_TERMS = 500_000
#: Documents in a block of columns.
BLOCK = 4096
#: Bytes as the cut sees them: A-Z lower-cased, ASCII that is no letter or digit as blanks, the rest as it is.
SEEN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(SEEN).split()


def item_groups(items: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items (id as text, terms) in groups of at most MOST_TERMS words; only one group is on the driver at a time."""
    group, held = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        terms = terms_of(r["text"])
        if group and held + len(terms) > MOST_TERMS:
            yield group
            group, held = [], 0
        if terms:
            group.append((r["item_id"], terms))
            held += len(terms)
    if group:
        yield group


class Items:
    """A group's item matrix by rows: the numbers of an item's distinct terms, and how often it has each."""

    def __init__(self, group: list[tuple[str | None, list[bytes]]]):
        self.ids = [i for i, _ in group]
        self.number = {w: k for k, w in enumerate(sorted({w for _, terms in group for w in terms}))}
        self.rows = []
        for _, terms in group:
            found = Counter(terms)
            self.rows.append((np.array([self.number[w] for w in found], np.int64), np.array(list(found.values()), np.int64)))


def term_rows(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), terms and counts (32-bit arrays over the numbered terms). Documents without a term
    are left out. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for pdf in batches:
            for part in text_runs(pdf):
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    rows.append((doc_id, len(words), np.array(list(found), np.int32).tobytes(), np.array(list(found.values()), np.int32).tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])

    rows = as_text(docs.where(F.col("text").isNotNull()), "text").mapInPandas(run, "doc_id string, n long, terms binary, counts binary")
    return materialise(rows, "terms")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each numbered term: tasks count by number, so each sends at most a row a term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["terms"]), np.int32), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    found = rows.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most a row a term
    out = np.zeros(n_terms, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, w: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 75 + 25 * n * n_docs // length
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def block_product(item_rows: list[tuple[np.ndarray, np.ndarray]], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[np.ndarray]:
    """Each item's row of the product, over the documents of a block. term, doc, impact: the block's entries, by term."""
    n_terms = max((int(t.max()) for t, _ in item_rows), default=-1) + 2
    start = np.searchsorted(term, np.arange(n_terms))
    for terms, often in item_rows:
        row = np.zeros(n_docs, np.int64)
        for t, k in zip(terms.tolist(), often.tolist(), strict=True):
            here = slice(start[t], start[t + 1])
            row[doc[here]] += impact[here] if k == 1 else k * impact[here]  # a term has a document once
        yield row


def first_of(score: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Where the `top` highest scores above 0 are, equal ones by `order`."""
    at = np.flatnonzero(score > 0)
    if len(at) > top:
        least = np.partition(score[at], len(at) - top)[len(at) - top]
        at = at[score[at] >= least]
    return at[np.lexsort((order[at], -score[at]))][:top]


def best_documents(rows: DataFrame, items: Items, df: np.ndarray, n_docs: int, length: int, top: int) -> DataFrame:
    """item (its row's number), doc_id, score: the first `top` of each item in each task."""
    shared = rows.sparkSession.sparkContext.broadcast((items.rows, weights(df, n_docs)))
    last = np.iinfo(np.int64).max

    def block(docs: pd.DataFrame, item_rows, w) -> pd.DataFrame:
        sizes = docs["terms"].str.len().to_numpy() // 4
        term = np.frombuffer(b"".join(docs["terms"]), np.int32)
        tf = np.frombuffer(b"".join(docs["counts"]), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        value = impacts(tf, w[term], docs["n"].to_numpy()[doc], n_docs, length)
        order = np.argsort(term, kind="stable")
        ids = docs["doc_id"].tolist()
        place = np.array([last if x is None else int(x) for x in ids], np.int64)
        out = []
        for item, row in enumerate(block_product(item_rows, term[order], doc[order], value[order], len(docs))):
            at = first_of(row, place, top)
            out.append(pd.DataFrame({"item": item, "doc_id": [ids[i] for i in at], "score": row[at], "place": place[at]}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_rows, w = shared.value
        best = None
        for pdf in batches:
            for k in range(0, len(pdf), BLOCK):
                found = block(pdf.iloc[k : k + BLOCK], item_rows, w)
                best = (found if best is None else pd.concat([best, found])).sort_values(["item", "score", "place"], ascending=[True, False, True], kind="stable").groupby("item").head(top)
        if best is not None and len(best):
            yield pd.DataFrame({"item": best["item"], "doc_id": best["doc_id"].tolist(), "score": best["score"]})

    return as_number(rows.mapInPandas(run, "item long, doc_id string, score long"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of every item. Written."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    out = None
    for group in item_groups(items):
        matrix = Items(group)
        rows = term_rows(docs, matrix.number)
        n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = best_documents(rows, matrix, document_frequencies(rows, len(matrix.number)), n_docs, max(1, length), top)
        found = top_rows(materialise(found, "found"), "item", [F.desc("score"), F.asc_nulls_last("doc_id")], top)
        names = spark.createDataFrame(list(enumerate(matrix.ids)), "item long, item_id string")
        found = found.join(names, "item").select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = materialise(found, "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))

"""Language-model scores of whole documents by a gated recurrent network, beside a unigram base.

Counts of every training token come from the whole corpus. The network predicts each token from all before it, in factors:
the class of its symbol (CLASS_SIZE symbols to a class) and the symbol within the class. The VOCABULARY most frequent words
are symbols of their own, and so is the end. Every other word, known or not, belongs to the symbol of its ending (TAILS of
them), which tells the network its language and form, and has a third factor: its share of that symbol's smoothed corpus counts.
So every token is predicted from its context, and every text has a probability.

Training is truncated backpropagation through windows of WINDOW tokens with the state carried on. Every document is written
once as token ids under one of SHARES shares, by a digest of the row; a round trains on a share, and together the rounds are
one pass over all tokens of all training documents. A round deals its documents, by digest and in its order, to streams of
about STREAM_TOKENS tokens; each stream trains by itself from the weights and step sizes of the round before, and these are
averaged by tokens, summed in the order of the streams. How many streams there are follows from the corpus alone, so the
model is the same however the input is partitioned. Scoring runs over all tokens of every text, state carried from window to window.

The counts of the KEPT most frequent words travel to the tasks (a bounded table); rarer words are joined by shuffle. Words
of equal counts are ordered by their text. Null texts are empty: one end token. Repeated rows are counted and scored each.
Without training documents all counts are 0. An empty table gives an empty result. Other columns are ignored. A long text
is one stream of windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_number, materialise, slices, table
from .toxicity import held_out

VOCABULARY = 1024
KEPT = 200_000
#: Distinct words that a task holds counts of before it passes them on.
MOST_COUNTED = 300_000
CLASS_SIZE, HIDDEN = 32, 16
WINDOW, LANES, RATE, FIRST = 20, 256, 0.15, 1e-5
SHARES = 8
#: About so many tokens are a stream of a round, and it trains on so many at a time.
STREAM_TOKENS, CHUNK_TOKENS = 120_000, 120_000
#: Weights are summed in so many parts before the last sum.
SUM_PARTS = 16
SCORED_AT_ONCE, SCORE_WINDOW = 256, 32
#: Documents that a task holds as tokens at a time, and as ids where it scores them: the longest text is a small part of many.
SLICE, SCORED_SLICE = 2048, 8192
#: Ids: the end, the TAILS symbols of endings, and from WORDS on words by frequency.
END, TAILS = 0, 127
WORDS = 1 + TAILS
SHAPES = {"x": lambda k: (k, 3 * HIDDEN), "u": lambda k: (HIDDEN, 3 * HIDDEN), "c": lambda k: (-(-k // CLASS_SIZE), HIDDEN), "cb": lambda k: (-(-k // CLASS_SIZE),), "w": lambda k: (-(-k // CLASS_SIZE), CLASS_SIZE, HIDDEN), "wb": lambda k: (-(-k // CLASS_SIZE), CLASS_SIZE)}


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text, A-Z lower-cased; null for none."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    return pc.ascii_split_whitespace(pc.if_else(pc.greater(pc.binary_length(texts), 0), texts, None))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows."""
    for b in batches:
        for k in range(0, len(b), SLICE):
            yield b.slice(k, SLICE)


def ending(word: bytes) -> int:
    """The symbol of a word without one of its own."""
    return 1 + zlib.crc32(word[-3:]) % TAILS


def unpack(flat: np.ndarray, k: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape(k)))
        out[name] = flat[at : at + n].reshape(shape(k)).astype(np.float32)
        at += n
    return out


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in SHAPES]).astype(np.float64)


def initial(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the logarithms of the classes' and words' shares."""
    k, rng = len(counts), np.random.default_rng(5)
    p = {n: (rng.standard_normal(s(k)) * 0.1).astype(np.float32) for n, s in SHAPES.items()}
    mass = np.zeros(p["wb"].size)
    mass[:k] = counts + 0.5
    mass = mass.reshape(p["wb"].shape)
    with np.errstate(divide="ignore"):
        p["wb"] = np.maximum(np.log(mass) - np.log(mass.sum(1, keepdims=True)), -1e4).astype(np.float32)
        p["cb"] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
    return p


def gates(a: np.ndarray) -> np.ndarray:
    """Rows of three gates -> an array of each gate, so that what is done to a gate runs through memory in order."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).transpose(1, 0, 2))


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: x (inputs by gate), h (state), u (by gate) -> the new state, update and reset, candidate, h @ u of the candidate."""
    g = h @ u
    zr = x[:2] + g[:2]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    c = zr[1] * g[2]
    c += x[2]
    np.tanh(c, out=c)
    new = h - c
    new *= zr[0]
    new += c
    return new, zr, c, g[2]


def cell(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """step() from rows of x and u as they are stored."""
    return step(gates(x), h, gates(u))


def softmax(a: np.ndarray, biases: np.ndarray, picked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the logits a + biases (cut at 80, which float32 still holds) at the places `picked` of a, one in a row
    with its own bias, and the sums of the rows' exponentials; these replace a."""
    logs = np.minimum(a.take(picked) + own.astype(float), 80)
    a += biases
    if a.max(initial=0) > 80:
        np.minimum(a, 80, out=a)
    np.exp(a, out=a)
    sums = a @ np.ones(a.shape[1], a.dtype)
    return logs - np.log(sums, dtype=float), sums


def output(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each id after its state; with grads, adds those of the mean log loss and returns dh. Inside,
    rows are sorted by class."""
    classes, rows, share = len(p["cb"]), np.arange(len(ids)), 1 / max(1, len(ids))
    cls = ids // CLASS_SIZE
    order = np.argsort(cls.astype(np.uint8) if classes < 256 else cls, kind="stable")
    place = np.empty_like(order)  # of each id among the sorted rows
    place[order] = rows
    ids, cls, hs = ids.take(order), cls.take(order), h.take(order, axis=0)
    cuts = np.searchsorted(cls, np.arange(classes + 1))
    parts = [(k, slice(cuts[k], cuts[k + 1])) for k in range(classes) if cuts[k] < cuts[k + 1]]

    def errors(a: np.ndarray, s: np.ndarray, at: np.ndarray) -> None:
        a *= (share / s)[:, None]
        a.reshape(-1)[at] -= share

    a, at = hs @ p["c"].T, rows * classes + cls
    logs, s = softmax(a, p["cb"], at, p["cb"].take(cls))
    dh = None
    if grads is not None:
        errors(a, s, at)
        grads["c"] += a.T @ hs
        grads["cb"] += np.ones(len(ids), a.dtype) @ a
        dh = a @ p["c"]
    a, at = np.empty((len(ids), CLASS_SIZE), h.dtype), (rows - cls) * CLASS_SIZE + ids
    for k, i in parts:
        np.matmul(hs[i], p["w"][k].T, out=a[i])
    more, s = softmax(a, p["wb"].take(cls, axis=0), at, p["wb"].take(ids))
    logs += more
    if grads is not None:
        errors(a, s, at)
        for k, i in parts:
            grads["w"][k] += a[i].T @ hs[i]
            grads["wb"][k] += np.ones(i.stop - i.start, a.dtype) @ a[i]
            dh[i] += a[i] @ p["w"][k]
        dh = dh.take(place, axis=0)
    return logs.take(place), dh


def summed_rows(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """rows (by gate) added up by id: `size` rows of the three gates."""
    out = np.zeros((size, 3, HIDDEN), rows.dtype)
    order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    out[ids[first]] = np.add.reduceat(rows.take(order, axis=1), first, axis=1).transpose(1, 0, 2)
    return out.reshape(size, 3 * HIDDEN)


def window_gradients(p: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, there: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean log loss of a window of tokens t (steps by lanes) after tokens x, from state h; the state after
    it; and the loss's sum. Steps that are not `there` count for nothing."""
    inputs, u, ended = gates(p["x"]), gates(p["u"]), x == END
    shape = (*x.shape, HIDDEN)
    before, states, c, g, back_c = (np.empty(shape, h.dtype) for _ in range(5))
    zr, dx = np.empty((2, *shape), h.dtype), np.empty((3, *shape), h.dtype)
    h = h.copy()
    for k in range(len(x)):
        h[ended[k]] = 0
        before[k] = h
        h, zr[:, k], c[k], g[k] = step(inputs.take(x[k], axis=1), h, u)
        states[k] = h
    grads = {name: np.zeros_like(v) for name, v in p.items()}
    if there.all():
        logs, dh = output(p, states.reshape(-1, HIDDEN), t.ravel(), grads)
        dh = dh.reshape(shape)
    else:
        dh = np.zeros_like(states)
        logs, dh[there] = output(p, states[there], t[there], grads)
    z, r = zr
    to_c = (1 - z) * (1 - c * c)
    to_z = (before - c) * z * (1 - z)
    to_r = g * r * (1 - r)
    back, back_of_u = np.zeros_like(h), np.ascontiguousarray(u.transpose(0, 2, 1))
    for k in reversed(range(len(x))):
        d = dh[k] + back
        dc = np.multiply(d, to_c[k], out=dx[2, k])
        np.multiply(d, to_z[k], out=dx[0, k])
        np.multiply(dc, to_r[k], out=dx[1, k])
        np.multiply(dc, r[k], out=back_c[k])
        back = d * z[k]
        for gate, over in zip((dx[0, k], dx[1, k], back_c[k]), back_of_u, strict=True):
            back += gate @ over
        back[ended[k]] = 0
    flat = before.reshape(-1, HIDDEN).T
    grads["u"] = np.concatenate([flat @ v.reshape(-1, HIDDEN) for v in (dx[0], dx[1], back_c)], axis=1)
    grads["x"] = summed_rows(x.ravel(), dx.reshape(3, -1, HIDDEN), len(p["x"]))
    return grads, h, float(-logs.sum())


def train(p: dict[str, np.ndarray], stream: np.ndarray, sums: dict[str, np.ndarray]) -> int:
    """Adagrad (its sums of squares begin at FIRST) over a stream of documents, each ended by END, dealt whole to lanes;
    changes p and sums in place. Returns how many tokens were trained on."""
    lanes = max(1, min(LANES, len(stream) // (2 * WINDOW)))
    length = -(-len(stream) // lanes)
    full = np.full(lanes * length, END, stream.dtype)
    full[: len(stream)] = stream
    y, there = full.reshape(lanes, length).T, (np.arange(lanes * length) < len(stream)).reshape(lanes, length).T
    before = np.concatenate(([END], full[:-1])).reshape(lanes, length).T
    y, there, before = map(np.ascontiguousarray, (y, there, before))
    h, done = np.zeros((lanes, HIDDEN), np.float32), 0
    for low in range(0, length, WINDOW):
        here = np.s_[low : low + WINDOW]
        if not there[here].any():
            break
        grads, h, _ = window_gradients(p, before[here], y[here], there[here], h)
        done += int(there[here].sum())
        for name, g in grads.items():
            np.clip(g, -0.25, 0.25, out=g)
            sums[name] += g * g
            size = np.sqrt(sums[name])
            size += 1e-6
            g *= RATE
            g /= size
            p[name] -= g
    return done


def log_likelihood(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each id array (ended by END), all of it. Texts are dealt whole, the longest first, to lanes of
    about equal length, where each begins with a new state behind the one before; states are carried from window to window.
    Lanes are in order of length, so that those which go on at a step are the first ones."""
    if not texts:
        return np.zeros(0)
    lanes = [(0, j, []) for j in range(min(SCORED_AT_ONCE, len(texts)))]
    for i in np.argsort([-len(t) for t in texts], kind="stable"):
        n, j, held = lanes[0]
        held.append(i)
        heapq.heapreplace(lanes, (n + len(texts[i]), j, held))
    lanes.sort(reverse=True)
    order, sizes = np.array([i for *_, held in lanes for i in held]), np.array([n for n, *_ in lanes])
    flat, begins = np.concatenate([texts[i] for i in order]), np.cumsum(sizes) - sizes
    logs = np.empty(len(flat))
    inputs, u = gates(p["x"]), gates(p["u"])
    h, last = np.zeros((len(lanes), HIDDEN), np.float32), np.full(len(lanes), END)
    for start in range(0, int(sizes[0]), SCORE_WINDOW):
        steps = np.arange(start, min(start + SCORE_WINDOW, int(sizes[0])))
        live = np.searchsorted(-sizes, -steps, side="left")  # lanes at each step
        at = np.concatenate([begins[:m] + k for k, m in zip(steps, live, strict=True)])
        ids, states = flat.take(at), np.empty((len(at), HIDDEN), np.float32)
        for m, end in zip(live, np.cumsum(live), strict=True):
            h, last = h[:m], last[:m]
            h[last == END] = 0
            h = step(inputs.take(last, axis=1), h, u)[0]
            states[end - m : end] = h
            last = ids[end - m : end]
        logs[at] = output(p, states, ids)[0]
    out, lengths = np.empty(len(texts)), np.array([len(texts[i]) for i in order])
    out[order] = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
    return out


class Corpus:
    """Totals of the training tokens, and the counts of the most frequent words."""

    def __init__(self, counts: DataFrame):
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(n), int(v)
        words = counts.where("word != ''")
        bits = F.length(F.bin("c")) - 5
        narrow = F.when(F.col("c") < 32, F.col("c")).otherwise(F.call_function("shiftright", F.col("c"), bits) + 16 * bits)
        by_count = words.groupBy(narrow.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()  # some hundred bins of counts
        room, least = KEPT, None
        for b in by_count:
            room -= b["n"]
            if room < 0:
                break
            least = b["least"]
        top = words.where(F.lit(False) if least is None else F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])  # at most KEPT rows
        self.words, self.c = [w.encode() for w in top["word"]], top["c"].to_numpy(np.int64)
        self.ends = int(counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        #: Of each network id: the symbol of an id, tokens of the corpus, and distinct words.
        self.symbols = np.concatenate([np.arange(min(WORDS + len(self.words), WORDS + VOCABULARY)), [ending(w) for w in self.words[VOCABULARY:]]]).astype(np.int32)
        self.tail_c, self.tail_v = self.tails(words)
        own = np.array([ending(w) for w in self.words[:VOCABULARY]], int)
        self.tail_c -= np.bincount(own, self.c[:VOCABULARY], WORDS).astype(np.int64)
        self.tail_v -= np.bincount(own, minlength=WORDS)

    @staticmethod
    def tails(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and distinct words of every ending."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, v = np.zeros(WORDS, np.int64), np.zeros(WORDS, np.int64)
            for pdf in batches:
                at = np.array([ending(w.encode()) for w in pdf["word"]], int)
                np.add.at(c, at, pdf["c"].to_numpy())
                v += np.bincount(at, minlength=WORDS)
            yield pd.DataFrame({"symbol": np.flatnonzero(v), "c": c[v > 0], "v": v[v > 0]})

        c, v = np.zeros(WORDS, np.int64), np.zeros(WORDS, np.int64)
        for r in words.mapInPandas(run, "symbol int, c long, v long").groupBy("symbol").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # at most TAILS rows
            c[r["symbol"]], v[r["symbol"]] = r["c"], r["v"]
        return c, v

    def network_counts(self) -> np.ndarray:
        """By the network's symbols: of the end, of the endings, and of the words that are symbols."""
        return np.concatenate(([self.ends], self.tail_c[1:], self.c[:VOCABULARY])).astype(float)


def token_table(docs: DataFrame) -> DataFrame:
    """word, c over the documents; the end token is the empty word. Tasks add up counts of MOST_COUNTED words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for b in cut(batches):
            found = word_lists(b["text"]).flatten().value_counts()
            words, n = found.field("values"), found.field("counts")
            held += [pa.table({"word": words, "c": n}), pa.table({"word": [""], "c": [len(b)]})]
            size += len(words)
            if size > 2 * MOST_COUNTED:
                held = [added()]
                size = len(held[0])
                if size > MOST_COUNTED:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from added().to_batches()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def offsets(sizes: np.ndarray) -> pa.Buffer:
    """Arrow's buffer of where items of these sizes begin and end."""
    return pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def token_ids(docs: DataFrame, corpus: Corpus, learn: Column) -> DataFrame:
    """row (its own number), doc_id, learn, key (a digest of doc_id and text), ids (32-bit, ended by END) and rare (the words
    without an id, apart by blanks) of every document, written by share."""
    known = docs.sparkSession.sparkContext.broadcast([w.decode() for w in corpus.words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(known.value, pa.string())
        for b in cut(batches):
            lists = word_lists(b["text"])
            sizes, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), lists.flatten()
            at = pc.index_in(flat, value_set=words)
            new = flat.filter(at.is_null())
            found = pc.fill_null(at, -1).to_numpy() + np.int32(WORDS)
            unknown = found < WORDS
            found[unknown] = [ending(w.encode()) for w in new.to_pylist()]
            stops = np.cumsum(sizes)  # of each text among the words
            ids = np.insert(found, stops, END).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(b), [None, offsets(4 * (sizes + 1)), pa.py_buffer(ids)])
            fresh = np.concatenate(([0], np.cumsum(unknown)))
            parts = pa.ListArray.from_arrays(np.concatenate(([0], fresh[stops])).astype(np.int32), new)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "share", "learn", "key")), data, pc.binary_join(parts, " ")], ["doc_id", "share", "learn", "key", "ids", "rare"])

    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    share = F.pmod(key, F.lit(SHARES)).cast("int").alias("share")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), share, learn.alias("learn"), key.alias("key"), "text").mapInArrow(run, "doc_id long, share int, learn boolean, key long, ids binary, rare string")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "ids", by="share")


def mean_weights(parts: DataFrame) -> tuple[float, np.ndarray | None]:
    """Tokens and the mean by tokens of rows (stream, n, p: weights as bytes), added in the order of streams in SUM_PARTS parts and
    then in one, so that the sum is the same in every layout."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[float, np.ndarray]] = {}
        for pdf in batches:
            for s, k, p in zip(pdf["stream"] % SUM_PARTS, pdf["n"], pdf["p"], strict=True):
                n, total = found.get(s, (0.0, 0.0))
                found[s] = (n + k, total + np.frombuffer(p))
        for s, (n, total) in found.items():
            yield pd.DataFrame({"stream": [s], "n": [n], "p": [total.tobytes()]})

    once = parts.repartition(SUM_PARTS, F.pmod("stream", F.lit(SUM_PARTS))).sortWithinPartitions("stream").mapInPandas(add, parts.schema)
    n, total = 0.0, 0.0
    for r in sorted(once.collect(), key=lambda r: r["stream"]):  # at most SUM_PARTS rows
        n, total = n + r["n"], total + np.frombuffer(bytes(r["p"]))
    return n, total / n if n else None


def trained(batches: Iterator[pd.DataFrame], start: Broadcast, k: int) -> Iterator[pd.DataFrame]:
    """stream, n, p of every stream: its rows come together and in order, and train CHUNK_TOKENS at a time, wherever a
    batch ends."""
    stream, held, size, n = None, [], 0, 0
    flat, symbols = start.value
    half = len(flat) // 2

    def step() -> None:
        nonlocal held, size, n  # p and sums are changed in place
        if held:
            n += train(p, symbols[np.frombuffer(b"".join(held), np.int32)], sums)
        held, size = [], 0

    def result() -> pd.DataFrame:
        step()
        return pd.DataFrame({"stream": [stream], "n": [float(n)], "p": [(np.concatenate([pack(p), pack(sums)]) * n).tobytes()]})

    for pdf in batches:
        for s, ids in zip(pdf["stream"], pdf["ids"], strict=True):
            if s != stream:
                if stream is not None:
                    yield result()
                stream, n, p, sums = s, 0, unpack(flat[:half], k), unpack(flat[half:], k)
            held.append(ids)
            size += len(ids) // 4
            if size >= CHUNK_TOKENS:
                step()
    if stream is not None:
        yield result()


def fit_network(every: DataFrame, corpus: Corpus) -> tuple[np.ndarray, int]:
    """Weights after one pass over all documents to learn from, in a round for each of their SHARES shares; and the tokens
    trained on."""
    spark, counts = every.sparkSession, corpus.network_counts()
    weights, k, done = pack(initial(counts)), len(counts), 0
    flat = np.concatenate([weights, np.full_like(weights, FIRST)])
    streams = max(1, round(corpus.n / SHARES / STREAM_TOKENS))
    for turn in range(SHARES):
        start = spark.sparkContext.broadcast((flat, corpus.symbols))
        rows = every.where((F.col("share") == turn) & F.col("learn")).select(F.pmod(F.xxhash64("key"), F.lit(streams)).cast("int").alias("stream"), "key", "ids")
        rows = rows.repartition(streams, "stream").sortWithinPartitions("stream", "key")
        n, mean = mean_weights(rows.mapInPandas(lambda batches, start=start: trained(batches, start, k), "stream int, n double, p binary"))
        start.unpersist()
        flat, done = flat if mean is None else mean, done + int(n)
    return flat[: len(weights)], done


def score_documents(every: DataFrame, corpus: Corpus, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document of token_ids()."""
    k = len(corpus.network_counts())
    logs = np.log10(np.concatenate(([corpus.ends], np.zeros(TAILS), corpus.c)) + 1.0)
    tails = np.log10(corpus.tail_c + corpus.tail_v + 1.0)
    shared = every.sparkSession.sparkContext.broadcast((logs, tails, corpus.symbols, weights))
    total, ended = np.log10(corpus.n + corpus.v + 1.0), corpus.ends > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, tails, symbols, flat = shared.value
        p = unpack(flat, k)
        for pdf in slices(batches, SCORED_SLICE):
            ids = [np.frombuffer(x, np.int32) for x in pdf["ids"]]
            inner = [symbols[x] for x in ids]
            n = np.array([len(x) for x in ids])
            base = np.array([logs[x].sum() for x in ids])
            within = []
            for x, y in zip(ids, inner, strict=True):
                there = (y != END) & (y < WORDS)
                within.append((logs[x[there]] - tails[y[there]]).sum())
            known = n - np.array([((x != END) & (x < WORDS)).sum() for x in ids]) - (not ended)
            model = log_likelihood(p, inner) / np.log(10)
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "n_tokens": n, "n_known": known, "base": base - n * total, "model": model + np.array(within)})

    rows = every.select("row", F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(run, "row long, doc_id string, n_tokens long, n_known long, base double, model double")
    rows = materialise(rows, "scores")  # a plan that changes at run time may not score twice
    less = every.where("rare != ''").select("row", F.explode(F.split("rare", " ")).alias("word")).join(counts, "word")
    less = less.groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("l"))
    out = as_number(rows).join(less, "row", "left")
    n, more = F.coalesce("n", F.lit(0)), F.coalesce("l", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + n).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op4_lm_score(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 7, 2)
    counts = materialise(token_table(docs.where(~held)), "counts")
    corpus = Corpus(counts)
    every = token_ids(docs, corpus, ~held)
    out = score_documents(every, corpus, fit_network(every, corpus)[0], counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "score")

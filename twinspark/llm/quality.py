"""Quality classifier: random-indexing word vectors, pooled, under a small network with calibrated output."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspark.llm.shared import bounded_labels, release, split_words, steps, texts_of

BUCKETS, DIMENSIONS, WINDOW, NONZERO = 1 << 14, 48, 2, 6
#: Labelled rows that the network is fit on, at most; those with the smallest hash of their id.
TRAIN_ROWS = 8192
THRESHOLD = 0.3
#: Bytes of text of a step; a step's words have a few arrays of one value each.
WORD_STEP = 1 << 20
#: Stands after a word that repeats the one before it; holds a blank, so no text holds it.
AGAIN = "\x03 again"
_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(seed: int = 7) -> np.ndarray:
    """The sparse random vector of 1 and -1 of each bucket, by dimension."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, np.where(np.arange(NONZERO) % 2, -1, 1).astype(np.float32)[None, :], axis=1)
    return np.ascontiguousarray(out.T)


def tokens_of(word: str) -> list[str]:
    """Letters in lower case, and with their case pattern; digits by number; runs of signs as they are."""
    out = [word] if word == AGAIN else []
    for part in () if out else _PART.findall(word):
        if part[0].isalpha():
            shape = "AA" if len(part) > 1 and part.isupper() else "Aa" if part[0].isupper() else "aa" if part.islower() else "aA"
            out += ["\x01" + shape, part.lower()]
        elif part[0].isdigit():
            out.append(f"\x01{min(len(part), 9)}")
        else:
            out.append("\x02" + part[:8])
    return out


class Buckets:
    """Bucket ids of words' tokens, kept for words seen."""

    def __init__(self, most: int = 80_000):
        self.known: dict[str, list[int]] = {}
        self.most = most

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the words' tokens."""
        from zlib import crc32

        known = self.known
        if len(known) > self.most:
            known.clear()
        lists = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = [crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens_of(w)]
            lists.append(ids)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return offsets, np.fromiter((i for x in lists for i in x), np.int64, int(offsets[-1]))


def _words(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """split_words, with the word AGAIN after each word that repeats the one before it."""
    offsets, codes, words = split_words(texts_of(batch, text))
    again = np.zeros(len(codes) + 1, np.int64)
    if len(codes):
        same = np.concatenate([[False], codes[1:] == codes[:-1]])
        same[offsets[:-1][offsets[:-1] < len(codes)]] = False
        np.cumsum(same, out=again[1:])
        codes = np.insert(codes, np.flatnonzero(same) + 1, len(words))
    return offsets + again[offsets], codes, [*words.to_pylist(), AGAIN]


@dataclass
class Network:
    """Two layers over standardised pooled vectors; probabilities at a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; a fifth of the rows sets the temperature.  One label alone gives its constant."""
    rng = np.random.default_rng(seed)
    y = y.astype(np.float64)
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), float(np.log(share / (1 - share))))
    if len(x) < 10 or y.min() == y.max():
        net.w2[:] = 0
        return net
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            a = z[part] @ params[0] + params[1]
            h = np.maximum(a, 0)
            out = h @ params[2] + params[3][0]
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
            gh = np.outer(g, params[2]) * (a > 0)
            grads = [z[part].T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, -logits / t * (2 * y[held] - 1)).mean() for t in temperatures]
    net.temperature = float(temperatures[int(np.argmin(loss))])
    return net


def pooled(batch: pa.RecordBatch, text: str, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean vector of each row's tokens, and the log of their number; zeros for no token."""
    offsets, codes, words = _words(batch, text)
    starts, ids = buckets.of(words)
    n = np.diff(starts)
    word = np.repeat(np.arange(len(n)), n)
    out = np.zeros((batch.num_rows, DIMENSIONS + 1))
    if not len(codes):
        return out
    of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    tokens = np.bincount(of, n[codes], batch.num_rows)
    for d in range(DIMENSIONS):
        out[:, d] = np.bincount(of, np.bincount(word, vectors[d][ids], len(n))[codes], batch.num_rows)
    out[:, :DIMENSIONS] /= np.maximum(tokens, 1)[:, None]
    out[:, DIMENSIONS] = np.log1p(tokens)
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors by dimension and bucket, at unit length, from all rows of `docs`.

    A token's vector is the sum of the index vectors of the tokens of its own word and of the
    WINDOW words on either side, over all its occurrences.  Each task sums its rows, a shuffle
    adds up the tasks' sums by bucket, and the driver gets one row for each bucket.  Sums are
    whole numbers, so their order does not matter.
    """
    names = [f"v{d}" for d in range(DIMENSIONS)]

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), Buckets()
        total = np.zeros((DIMENSIONS, BUCKETS))
        for batch in steps(batches, text, WORD_STEP):
            offsets, codes, words = _words(batch, text)
            starts, ids = buckets.of(words)
            word = np.repeat(np.arange(len(words)), np.diff(starts))
            # The code after the last word's has no vector; WINDOW of these stand between rows.
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            line = np.full(len(codes) + WINDOW * (batch.num_rows + 1), len(words))
            line[np.arange(len(codes)) + WINDOW * (row + 1)] = codes
            for d in range(DIMENSIONS):
                own = np.bincount(word, index[d][ids], len(words) + 1).astype(np.float32)[line]
                around = own.copy()
                for k in range(1, WINDOW + 1):
                    around[k:] += own[:-k]
                    around[:-k] += own[k:]
                total[d] += np.bincount(ids, np.bincount(line, around, len(words) + 1)[word], BUCKETS)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[d][used].astype(np.int64)) for d in range(DIMENSIONS)]], names=["bucket", *names])
        del total, buckets
        release()

    sums = docs.select(text).mapInArrow(contexts, "bucket int, " + ", ".join(f"{x} long" for x in names)).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    total = np.zeros((DIMENSIONS, BUCKETS))
    for d, x in enumerate(names):
        total[d, sums.column("bucket").to_numpy()] = sums.column(x).to_numpy()
    return (total / np.maximum(np.linalg.norm(total, axis=0), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all of `docs`, and a network fit on at most `rows` labelled rows where `learns` holds.

    Texts stay in the tasks: the driver gets a pooled vector for each labelled row.
    """
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in steps(batches, text, WORD_STEP):
            x = pooled(batch, text, sent.value, buckets)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    sample = bounded_labels(docs, labels, learns, label, rows, text)
    got = sample.select("label", text).mapInArrow(pool, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(len(got), DIMENSIONS + 1)
    order = np.lexsort(x.T)  # the rows' order is not fixed; the fit's is
    return vectors, train(x[order], got.column("label").to_numpy()[order])


def score_quality(docs: DataFrame, labels: DataFrame, learns: Column, text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs` with score (0 to 1) and predicted (1 if score >= threshold).

    Only texts are scored on; null counts as empty, and an empty text has the score of no tokens.
    Equal texts have equal scores.  Without labels the score is 0.5 everywhere.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learns, label, text, rows))
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    plain = docs.select(*[docs[c] for c in names])
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        buckets = Buckets()
        for batch in steps(batches, text, WORD_STEP):
            p = net.probability(pooled(batch, text, vectors, buckets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])
        del buckets
        release()

    return plain.mapInArrow(run, schema)

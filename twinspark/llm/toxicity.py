"""Toxicity from the nearest labelled examples by TF-IDF cosine, found with block-max inverted indexes."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import bounded_labels, mixed, release, segment_sums, split_words, steps, texts_of
from twinspark.llm.suffix_dedup import Hashes

#: Labelled rows that are examples, at most; those with the smallest hash of their id.
EXAMPLE_ROWS = 4096
#: Terms held as a dense matrix, at most: those of most examples; the others are lists of examples.
COMMON = 1536
#: Texts searched at a time.
SEARCHED = 256
#: Letters of the word beginnings that are terms too.
STEMS = (4, 5, 6)
#: Neighbours that vote: a 25th of the examples, within these bounds; those that are told as evidence.
NEIGHBOURS, EVIDENCE, BLOCK = (15, 100), 15, 64
#: Groups of like examples, and the blocks of the highest bounds that set a text's first limit.
GROUPS, FIRST_BLOCKS = 16, 8
THRESHOLD = 0.7
_NO_LETTERS = r"[^\p{L}]+"


def word_terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's terms, and the terms, word by word, as 64-bit hashes.

    Terms are a word's runs of letters in lower case and the beginnings of longer ones, of as many
    letters as STEMS says: inflected and compound forms share them.  A word without letters is a
    term itself.  Hashes of beginnings follow from those of prefixes of all bytes.
    """
    low = pc.utf8_lower(words.cast(pa.string()))
    lists = pc.split_pattern_regex(low, pattern=_NO_LETTERS)
    runs, word = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(runs), 0)
    runs, word = runs.filter(full), word[full.to_numpy(zero_copy_only=False)]
    bare = np.setdiff1d(np.arange(len(words)), word)
    strings = pa.concat_arrays([runs, low.take(pa.array(bare, pa.int64()))])
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8, int(offsets[-1]))
    hashes, leads = Hashes(data), (data & 0xC0) != 0x80
    at = np.append(np.flatnonzero(leads), len(data))
    rank = np.concatenate([[0], np.cumsum(leads)])
    begin, end = offsets[:-1], offsets[1:]
    found = [(np.append(word, bare), begin, end - begin, 0)]
    letters = (rank[end] - rank[begin])[: len(runs)]
    for k in STEMS:
        longer = np.flatnonzero(letters > k)
        found.append((word[longer], begin[longer], at[rank[begin[longer]] + k] - begin[longer], k))
    of = np.concatenate([f[0] for f in found])
    terms = np.concatenate([mixed(hashes.of(start, size) + np.uint64((k + 1) << 32) + size.astype(np.uint64)) for _, start, size, k in found])
    order = np.argsort(of, kind="stable")
    return np.bincount(of, minlength=len(words)), terms[order].view(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of sizes[i] values each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def counts_by_row(batch: pa.RecordBatch, text: str, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count), by row and term, of a batch; a term is its place in the sorted hashes `known`."""
    offsets, codes, words = split_words(texts_of(batch, text))
    sizes, terms = word_terms(words)
    place = np.searchsorted(known, terms)
    there = known[np.minimum(place, len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
    sizes = segment_sums(there.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
    flat = place[there]
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    row = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), n)
    term = flat[ranges((np.cumsum(sizes) - sizes)[codes], n)] if len(codes) else flat[:0]
    keys, n = np.unique(row << 32 | term, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


@dataclass
class Index:
    """Examples as whole unit vectors, dealt into blocks, with each common term's largest weight in each block.

    A term weighs (1 + log count) * idf ** 2.  The common terms of the examples are a dense matrix;
    each other term has the list of its examples.
    """

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    block: int = BLOCK
    offsets: np.ndarray | None = None
    terms: np.ndarray | None = None
    counts: np.ndarray | None = None
    filled: bool = False
    blank: float = 0.5
    steps_at: np.ndarray | None = None
    steps_to: np.ndarray | None = None

    def __getstate__(self) -> dict:
        self.empty()
        return self.__dict__

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms] ** 2
        return w / (np.linalg.norm(w) or 1.0)

    def build(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.empty()
        self.block = BLOCK
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in examples])]).astype(np.int64)
        self.terms = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in examples]]).astype(np.int32)
        counts = np.concatenate([np.zeros(0, np.int32), *[n for _, n in examples]])
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=1))))

    def example(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.offsets[k] : self.offsets[k + 1]], self.counts[self.offsets[k] : self.offsets[k + 1]].astype(np.int64)

    @property
    def neighbours(self) -> int:
        return int(np.clip((len(self.offsets) - 1) // 25, *NEIGHBOURS))

    def empty(self) -> None:
        self.weights = self.column = self.listed = self.listed_at = self.listed_weights = self.exact = self.dense = self.top = None
        self.filled = False

    def fill(self) -> None:
        """The weights, lists, dense matrix and its blocks' largest weights, made where they are used."""
        n = len(self.offsets) - 1
        self.weights = (1 + np.log(self.counts.astype(np.float64))) * self.idf[self.terms] ** 2
        norms = np.sqrt(segment_sums(self.weights**2, self.offsets))
        self.weights /= np.repeat(np.maximum(norms, 1e-12), np.diff(self.offsets))
        of = np.bincount(self.terms, minlength=len(self.idf))
        common = np.sort(np.argsort(-of, kind="stable")[:COMMON])
        self.column = np.full(len(self.idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        rare = np.flatnonzero(self.column[self.terms] < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.listed = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.offsets))[rare]
        self.listed_weights = self.weights[rare]
        self.listed_at = np.concatenate([[0], np.cumsum(np.where(self.column < 0, of, 0))])
        blocks = -(-n // self.block)
        self.exact = np.zeros((blocks * self.block, len(common)))
        for k, (a, b) in enumerate(zip(self.offsets[:-1], self.offsets[1:], strict=True)):
            at = self.column[self.terms[a:b]]
            self.exact[k, at[at >= 0]] = self.weights[a:b][at >= 0]
        self.dense = self.exact.astype(np.float32)
        self.top = self.dense.reshape(blocks, self.block, -1).max(axis=1)
        self.filled = True

    def alike(self) -> np.ndarray:
        """An order of the examples that puts like ones together, so that few blocks can hold a near one."""
        n = len(self.offsets) - 1
        if not n:
            return np.zeros(0, np.int64)
        self.fill()
        x = self.dense[:n]
        centres = x[np.linspace(0, n - 1, GROUPS).astype(int)]
        for _ in range(5):
            of = np.argmax(x @ centres.T, axis=1)
            centres = np.stack([x[of == g].sum(axis=0) for g in range(GROUPS)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        self.empty()
        return np.lexsort((self.ids, of))

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.search([(terms, counts)], [without])[0]

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the nearest examples of each text, ties by id; exact.

        The lists of rare terms are summed for all examples.  A block's bound is the largest such
        sum in it and what its common terms can add; blocks that cannot reach the last of the
        nearest in the blocks of the highest bounds are not read.  Sums are in single precision
        but for the examples that they leave, whose sums are then made in double precision.
        """
        if self.offsets is None or len(self.offsets) < 2:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in texts]
        if not self.filled:
            self.fill()
        block, (blocks, width) = self.block, self.top.shape
        common = np.zeros((len(texts), width), np.float32)
        found = np.zeros((len(texts), blocks * block), np.float32)
        rare = np.zeros((len(texts), blocks * block))
        vectors = []
        for k, (t, n) in enumerate(texts):
            q = self.vector(t, n)
            vectors.append(q)
            at = self.column[t]
            common[k, at[at >= 0]] = q[at >= 0]
            t, q = t[at < 0], q[at < 0]
            size = self.listed_at[t + 1] - self.listed_at[t]
            places = ranges(self.listed_at[t], size)
            if len(places):
                rare[k] = np.bincount(self.listed[places], self.listed_weights[places] * np.repeat(q, size), blocks * block)
            found[k] = rare[k]
            if without is not None and without[k] >= 0:
                found[k, without[k]] = -10
        bounds = found.reshape(len(texts), blocks, block).max(axis=2) + common @ self.top.T + 1e-4
        early = np.zeros(bounds.shape, bool)
        np.put_along_axis(early, np.argpartition(-bounds, min(FIRST_BLOCKS, blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows, part = np.flatnonzero(wanted[:, b]), slice(b * block, (b + 1) * block)
                found[rows, part] += common[rows] @ self.dense[part].T

        def last() -> np.ndarray:
            """What the last of the nearest has by now, at least."""
            n, wanted = found.shape[1], self.neighbours
            return np.maximum(np.partition(found, n - wanted, axis=1)[:, n - wanted], 0) - 1e-4 if n >= wanted else np.zeros(len(found))

        read(early)
        limit = last()
        late = (bounds >= limit[:, None]) & ~early
        read(late)
        limit = last()
        out = []
        for k, (t, _) in enumerate(texts):
            places = np.flatnonzero(found[k] > max(limit[k], 0))
            q = np.zeros(width)
            at = self.column[t]
            q[at[at >= 0]] = vectors[k][at >= 0]
            used = np.flatnonzero(q)
            cosines = self.exact[np.ix_(places, used)] @ q[used] + rare[k, places]
            places, cosines = places[cosines > 1e-12], cosines[cosines > 1e-12]
            order = np.lexsort((self.ids[places], -np.round(cosines, 9)))[: self.neighbours]
            out.append((places[order], cosines[order]))
        return out

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighted by the inverse of its distance."""
        if not len(places):
            return -1.0
        w = 1 / (0.05 + 1 - np.minimum(cosines, 1))
        return float((w * self.labels[places]).sum() / w.sum())

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of labels on the examples' own votes, each without itself."""
        blank = votes < 0
        self.blank = float((labels[blank].sum() + 1) / (blank.sum() + 2))
        votes, labels = votes[~blank], labels[~blank]
        pools: list[list[float]] = []
        for v, y in sorted(zip(votes.tolist(), labels.tolist(), strict=True)):
            pools.append([v, v, y, 1])
            while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
                low, high = pools[-2], pools.pop()
                low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
        share = labels.mean() if len(labels) else 0.5
        self.steps_at = np.array([x for p in pools for x in p[:2]])
        self.steps_to = np.array([s for p in pools for s in [(p[2] + share) / (p[3] + 1)] * 2])

    def score(self, vote: float) -> float:
        if vote < 0 or self.steps_at is None or not len(self.steps_at):
            return self.blank
        return float(np.interp(vote, self.steps_at, self.steps_to))


def vocabulary(sample: DataFrame, text: str = "text") -> np.ndarray:
    """The terms of the rows' texts, all of them, as sorted hashes."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in steps(batches, text):
            seen = np.union1d(seen, word_terms(split_words(texts_of(batch, text))[2])[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["term"])

    return np.sort(sample.select(text).mapInArrow(find, "term long").distinct().toArrow().column("term").to_numpy())


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "toxic", text: str = "text", rows: int = EXAMPLE_ROWS) -> tuple[Broadcast, Broadcast, Index]:
    """Vocabulary and index, sent to the tasks, of at most `rows` labelled rows where `learns` holds; and the calibrated index.

    The vocabulary is every term of those rows, told by 64-bit hashes; a term's inverse document
    frequency is over all of `docs`.  The driver gets the vocabulary, its frequencies, and the
    examples' counts of its terms; no text.
    """
    sample = bounded_labels(docs, labels, learns, label, rows, text).persist()
    terms = vocabulary(sample, text)
    spark, size = docs.sparkSession, len(terms)
    known = spark.sparkContext.broadcast(terms)
    del terms

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in steps(batches, text):
            df[:size] += np.bincount(counts_by_row(batch, text, known.value)[1], minlength=size)
            df[size] += batch.num_rows
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "n"])
        release()

    df = np.zeros(size + 1)
    of_terms = docs.select(text).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[of_terms.column("term").to_numpy()] = of_terms.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            row, term, n = counts_by_row(batch, text, known.value)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cut = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
            blobs = [pa.array([x[c].astype(np.int32).tobytes() for c in cut], pa.binary()) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *blobs], names=["doc_id", "label", "terms", "counts"])

    got = sample.mapInArrow(vectors, "doc_id long, label int, terms binary, counts binary").toLocalIterator()
    found = sorted((r["doc_id"], bytes(r["terms"]), bytes(r["counts"]), r["label"]) for r in got)
    sample.unpersist()
    blank = [r[3] for r in found if not r[1]]
    full = [r for r in found if r[1]]
    examples = [(np.frombuffer(t, np.int32), np.frombuffer(n, np.int32)) for _, t, n, _ in full]
    index = Index(idf, np.array([r[0] for r in full], np.int64), np.array([r[3] for r in full], np.float64))
    index.build(examples)
    order = index.alike()
    index.ids, index.labels = index.ids[order], index.labels[order]
    index.build([examples[k] for k in order])
    del found, full, examples
    gc.collect()
    sent = spark.sparkContext.broadcast(index)

    def own_votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, SEARCHED):
                places = batch.column("id").to_numpy()[start : start + SEARCHED].tolist()
                found = index.search([index.example(k) for k in places], places)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([index.vote(*x) for x in found], pa.float64())], names=["place", "vote"])

    votes = np.zeros(len(order))
    for k, v in spark.range(0, len(order), 1, len(order) // (2 * SEARCHED) + 1).mapInArrow(own_votes, "place long, vote double").collect():
        votes[k] = v
    index.calibrate(np.append(votes, [-1.0] * len(blank)), np.append(index.labels, blank))
    return known, sent, index


def score_toxicity(docs: DataFrame, labels: DataFrame, learns: Column, text: str = "text", label: str = "toxic", rows: int = EXAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and evidence, for every row.

    `evidence` lists the nearest EVIDENCE examples: their doc_id, cosine and label.  Null texts count as
    empty; a text without a term of any example, the empty one too, has the share of label 1
    among such examples and no evidence.  Equal texts have equal results, repeated rows too.
    Without examples of both labels, every score is that share.
    """
    known, sent, fitted = fit(docs, labels, learns, label, text, rows)
    calibrated = fitted.blank, fitted.steps_at, fitted.steps_to
    del fitted

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        index.blank, index.steps_at, index.steps_to = calibrated
        kept = {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in steps(batches, text):
            row, term, n = counts_by_row(batch, text, known.value)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            keys = [(term[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            keys = [hashlib.sha256(len(t).to_bytes(8) + t + c).digest() for t, c in keys]
            if len(kept) > 5_000:
                kept.clear()
            fresh = list({key: k for k, key in enumerate(keys) if key not in kept}.items())
            for k in range(0, len(fresh), SEARCHED):
                part = fresh[k : k + SEARCHED]
                texts = [(term[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for _, i in part]
                for (key, _), (places, cosines) in zip(part, index.search(texts), strict=True):
                    why = [{"doc_id": int(index.ids[p]), "cosine": float(c), "label": int(index.labels[p])} for p, c in zip(places[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
                    kept[key] = (index.score(index.vote(places, cosines)), why)
            scores = [kept[key][0] for key in keys]
            evidence = [kept[key][1] for key in keys]
            p = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence, kind)], names=["doc_id", "score", "predicted", "evidence"])
        index.empty()
        release()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>")

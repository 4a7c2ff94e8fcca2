"""Language-model scores: the marginal likelihood of a text over all its subword segmentations."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import cut_lineage, segment_sums, split_words, steps, texts_of

MARK = "▁"
#: Words whose counts are sent to every task; the counts of all others are joined.
HEAD_WORDS = 1 << 17
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 300_000
#: Words whose lattice value a worker keeps.
CACHE_WORDS = 400_000
#: Characters from which a word is scored on its own, with the last few places of the recursion only.
LONG = 4096
#: Edges that one vectorised recursion holds.
CELLS = 1 << 18
_LN10 = math.log(10)


class Lattice:
    """All segmentations of words into an existing vocabulary's pieces.

    The vocabulary's scores weigh the pieces.  Scores of a byte-pair vocabulary are ranks, 0 and
    down, so a piece of score s weighs 1 / (3 - s), Zipf's law for ranks, made to sum to 1; if a
    score is no whole number they are log probabilities, and the weights are their exponentials.
    A character is always also its UTF-8 bytes, so every word has a segmentation.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids = [0] * 256
        usual = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usual.append(i)
        self.size = n
        self.length = np.ones(n, np.int64)
        self.automaton = ahocorasick.Automaton()
        for i in usual:
            piece = model.id_to_piece(i)
            self.automaton.add_word(piece, i)
            self.length[i] = len(piece)
        self.automaton.make_automaton()
        self.longest = int(self.length.max())
        scores = np.array([model.get_score(i) for i in usual])
        weight = np.zeros(self.size)
        weight[usual] = 1 / (3 - scores) if (scores <= 0).all() and (scores == np.round(scores)).all() else np.exp(scores)
        weight[self.byte_ids] = weight[usual].min()
        self.logs = np.log(np.maximum(weight / weight.sum(), 1e-300))
        self.cache: dict[str, float] = {}

    def _chunks(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of words of like length, of at most CELLS edges together or one word."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            end = min(len(order), start + max(1, CELLS // int(sizes[order[start]] * self.longest)))
            while end - start > 1 and (end - start) * sizes[order[end - 1]] * self.longest > 2 * CELLS:
                end = start + (end - start) // 2
            yield order[start:end]
            start = end

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the marked words, and the log weight of the edge of each (word, end, length).

        One pass of the automaton over all words: no piece holds the mark after another character,
        so none crosses from word to word.  A lone character without a piece has its bytes' weight.
        """
        text = MARK + MARK.join(words)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(sizes) - sizes
        n, longest = int(sizes.max()), self.longest
        ends, ids = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2).T
        ends = ends + 1
        word = np.searchsorted(begin, ends - 1, side="right") - 1
        id_of = np.full((len(words), n + 1, longest + 1), -1, np.int32)
        inside = ends - begin[word] >= self.length[ids]  # a word of marks stays a word
        word, ends, ids = word[inside], ends[inside], ids[inside]
        id_of[word, ends - begin[word], self.length[ids]] = ids
        weight = np.where(id_of >= 0, self.logs[id_of], -np.inf)
        at, place = np.nonzero(id_of[:, 1:, 1] == -1)
        real = place < sizes[at]
        at, place = at[real], place[real]
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")[begin[at] + place]
        for c in np.unique(points):
            here = points == c
            weight[at[here], place[here] + 1, 1] = self.logs[self._bytes(c)].sum()
        return sizes, weight

    def _bytes(self, point: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(point).encode("utf-8", "surrogatepass")]

    def _forward(self, weight: np.ndarray) -> np.ndarray:
        m, n, longest = weight.shape[0], weight.shape[1] - 1, self.longest
        reach = np.full((m, n + 1 + longest), -np.inf)  # place p is at p + longest
        reach[:, longest] = 0.0
        for p in range(1, n + 1):
            reach[:, p + longest] = _log_sum(reach[:, p : p + longest][:, ::-1] + weight[:, p, 1:])
        return reach[:, longest:]

    def _long(self, word: str) -> float:
        """The recursion's last value for one word, of which the last `longest` places are held."""
        logs, size, longest = self.logs.tolist(), self.length.tolist(), self.longest
        text = MARK + word
        found = self.automaton.iter(text)
        end, piece = next(found, (len(text), -1))
        reach = deque([0.0], maxlen=longest)
        for place, character in enumerate(text):
            terms, alone = [], False
            while end == place:
                if size[piece] <= len(reach):
                    terms.append(reach[-size[piece]] + logs[piece])
                alone = alone or size[piece] == 1
                end, piece = next(found, (len(text), -1))
            if not alone:
                terms.append(reach[-1] + sum(logs[b] for b in self._bytes(ord(character))))
            top = max(terms)
            reach.append(top if len(terms) == 1 else top + math.log(sum(math.exp(x - top) for x in terms)))
        return reach[-1]

    def log10s(self, words: list[str]) -> np.ndarray:
        """Base-10 logarithms of words' probabilities, each summed over its segmentations."""
        out = np.zeros(len(words))
        usual = [k for k, w in enumerate(words) if len(w) < LONG]
        for part in self._chunks([words[k] for k in usual]):
            part = np.array(usual, np.int64)[part]
            sizes, weight = self._edges([words[k] for k in part])
            out[part] = self._forward(weight)[np.arange(len(part)), sizes] / _LN10
        for k in set(range(len(words))).difference(usual):
            out[k] = self._long(words[k]) / _LN10
        return out

    def kept_log10s(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = words
        values = self.log10s(new)
        here = dict(zip(new, values.tolist(), strict=True))
        out = np.fromiter((here[w] if w in here else self.cache[w] for w in words), np.float64, len(words))
        self.cache.update((w, v) for w, v in here.items() if len(w) < LONG)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(top), top + np.log(np.exp(x - top[:, None]).sum(axis=1)), -np.inf)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of each lower-cased word, counted in tasks before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in steps(batches, text):
            _, codes, words = split_words(pc.ascii_lower(texts_of(batch, text)))
            for w, n in zip(words.to_pylist(), np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                if n:
                    held[w] = held.get(w, 0) + n
            if len(held) > COUNT_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(words: DataFrame, most: int) -> dict[str, int]:
    """The commonest words, as many classes of like counts as hold `most` words at most together."""
    kind = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for k, n in sorted(words.groupBy(kind.alias("kind")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = k
    return {} if least is None else {r["word"]: r["n"] for r in words.where(kind >= least).select("word", "n").collect()}


def score_documents(docs: DataFrame, learns: Column, path: str, text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Score every row under the lattice model and a word-count base, both fit where `learns` holds.

    The model is a lattice whose edges are the vocabulary's pieces and, for words of the corpus,
    the word itself: a word that was seen c times has max(c - D, 0) / N for its own edge, and what
    all words give up, D * V / N, is dealt by the marginal over all segmentations into pieces.  D is
    n1 / (n1 + 2 * n2) for n1 words seen once and n2 seen twice.  A text's probability is that of
    its lower-cased words in turn and its end.

    Returns a row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Null texts count as empty: one end token.  Repeated rows are scored, and counted, as often as
    they occur; a null `learns` holds a row out.  If no row is learned from, every count is zero.

    Counts cover all rows.  The commonest `head_words` words are sent to the tasks; for the rest
    each row's words meet their counts in a join, so nothing that grows with the corpus passes
    through the driver.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias(text), F.coalesce(~learns, F.lit(True)).alias("held_out"))
    trained = rows.where("not held_out")
    words = cut_lineage(word_counts(trained, text))
    ends = trained.count()
    seen, distinct, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens, distinct = seen + ends, distinct + (ends > 0)
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    back_off = min(0.5, discount * distinct / tokens) if distinct else 0.5
    head = common_words(words, head_words)
    known = docs.sparkSession.sparkContext.broadcast(head)
    whole = len(head) == distinct - (ends > 0)  # no other words are known
    unit = math.log10(tokens + distinct + 1)
    end_base = math.log10(ends + 1)
    # A third of the mass is the end's where nothing was learned from.
    end_score = math.log10(max(ends - discount, 0.0) / tokens + back_off / tokens) if ends else math.log10(1 / 3)
    fields = "doc_id long, held_out boolean, row long, word string, k long, n_tokens long, n_known long, base double, score double"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = known.value, Lattice(path)
        for batch in steps(batches, text):
            offsets, codes, distinct_words = split_words(pc.ascii_lower(texts_of(batch, text)))
            names = distinct_words.to_pylist()
            here = np.bincount(codes, minlength=len(names)) > 0
            values = np.zeros(len(names))
            values[here] = own.kept_log10s([w for w, on in zip(names, here.tolist(), strict=True) if on])
            c = np.array([counts.get(w, 0) for w in names], np.int64)
            logc = np.log10(c + 1.0)
            own_edge = np.log10(np.maximum(np.maximum(c - discount, 0) / max(1, tokens), 1e-300))
            mixed = np.logaddexp(own_edge * _LN10, (values + math.log10(back_off)) * _LN10) / _LN10
            rare_here = c == 0 if not whole else np.zeros(len(c), bool)
            mixed[rare_here] = 0.0  # their counts come in the join
            n, rows_here = np.diff(offsets), batch.num_rows
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    row,
                    pc.binary_join_element_wise(pc.cast(row, pa.string()), "", " "),  # holds a blank, so it is no word
                    pa.array(np.zeros(rows_here, np.int64)),
                    pa.array(n + 1),
                    pa.array(segment_sums((c > 0)[codes].astype(np.int64), offsets) + (ends > 0)),
                    pa.array(segment_sums(logc[codes], offsets) + end_base - (n + 1) * unit),
                    pa.array(segment_sums(mixed[codes], offsets) + end_score),
                ],
                names=[f.split()[0] for f in fields.split(", ")],
            )
            rare = np.flatnonzero(rare_here[codes])
            if len(rare):
                of = np.repeat(np.arange(rows_here, dtype=np.int64), n)[rare]
                keys, k = np.unique(of << 32 | codes[rare], return_counts=True)
                at = pa.array(keys >> 32)
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), row.take(at), distinct_words.take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string()), pa.array(k), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(values[keys & 0xFFFFFFFF])],
                    names=[f.split()[0] for f in fields.split(", ")],
                )

    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, fields)
    if not whole:
        parts = parts.join(words, "word", "left")
    else:
        parts = parts.withColumn("n", F.lit(None).cast("long"))
    is_row = F.col("n_tokens").isNotNull()
    own_edge = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - F.lit(discount), F.lit(0.0)) / max(1, tokens)
    # Of long words the second term may be too small for a double; then it is negligible, or all there is.
    high = F.greatest(F.col("score") + math.log10(back_off), F.when(own_edge > 0, F.log10(own_edge)).otherwise(F.lit(-1e300)))
    low = F.least(F.col("score") + math.log10(back_off), F.when(own_edge > 0, F.log10(own_edge)).otherwise(F.lit(-1e300)))
    mixed = high + F.log10(1 + F.pow(F.lit(10.0), F.greatest(low - high, F.lit(-300.0))))
    sums = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("k"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)), F.lit(0.0))).alias("base_score"),
        F.sum(F.when(is_row, F.col("score")).otherwise(F.col("k") * mixed)).alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def sampled_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id, as text, leaves the remainder `part`."""
    return F.crc32(F.col(doc_id).cast("string")) % parts == part

"""Fill-in-the-middle by a parallel automaton scan: pieces of text give state functions and counts, their composition finds the cuts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import STEP_BYTES, cut_lineage, release, steps

#: Bytes that one lane of the scan steps through; the counts of a lane fit in a byte.
LANE = 64
#: Bytes of the longest text that is scanned as one piece; longer ones are dealt to tasks piece by piece.
PIECE_BYTES = 1 << 16
#: What a scan reads at each byte.
OTHER, LETTER, MARK_LETTER, OPENS, CLOSES, CONTINUES, PAD = range(7)
#: States: outside a word, in one, after `<`, after `<` and the letter of a mark.
OUT, WORD, OPEN, NAMED = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    out[[ord(c) for c in "PSM"]] = MARK_LETTER
    out[ord("<")], out[ord(">")] = OPENS, CLOSES
    out[0x80:0xC0] = CONTINUES
    return out


def _steps() -> np.ndarray:
    """For each class and state the next state, plus 4 where a token starts, plus 8 where a mark ends."""
    out = np.zeros((7, 4), np.uint8)
    for state in range(4):
        in_word = state in (WORD, NAMED)
        out[OTHER, state] = OUT + 4
        out[LETTER, state] = WORD + 4 * (not in_word)
        out[MARK_LETTER, state] = (NAMED if state == OPEN else WORD) + 4 * (not in_word)
        out[OPENS, state] = OPEN + 4
        out[CLOSES, state] = OUT + 4 + 8 * (state == NAMED)
        out[CONTINUES, state] = out[PAD, state] = state
    return out.ravel()


_CLASS, _STEP = _classes(), _steps()


class Scan:
    """The scan of some pieces of text, whatever the states they are entered in.

    Every lane of LANE bytes gives a function from the state it is entered in to the state it is
    left in, the tokens that start in it and whether a mark ends in it; composition, which is
    associative, is carried out by doubling within each piece.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        lanes = -(-sizes // LANE)
        self.first = np.zeros(len(sizes) + 1, np.int64)  # the first lane of each piece
        np.cumsum(lanes, out=self.first[1:])
        piece = np.repeat(np.arange(len(sizes)), lanes)
        self.start = offsets[:-1][piece] + (np.arange(self.first[-1]) - self.first[piece]) * LANE
        self.end = np.minimum(self.start + LANE, offsets[1:][piece])
        state = np.repeat(np.arange(4, dtype=np.uint8)[:, None], len(self.start), axis=1)
        tokens, marks = np.zeros(state.shape, np.uint8), np.zeros(state.shape, np.uint8)
        for k in range(LANE):
            v = _STEP[self._codes(np.arange(len(self.start)), k) + state]
            state = v & 3
            tokens += (v >> 2) & 1
            marks |= v >> 3
        self.to, self.tokens, self.marks = (x.T.astype(np.int64) for x in (state, tokens, marks))
        self._compose(self.first[piece])

    def _codes(self, lanes: np.ndarray, k: int) -> np.ndarray:
        """Rows of the step table for byte `k` of each lane."""
        at = self.start[lanes] + k
        out = _CLASS[self.data[np.minimum(at, len(self.data) - 1)]] if len(self.data) else np.zeros(0, np.uint8)
        out[at >= self.end[lanes]] = PAD
        return out * 4

    def _compose(self, first: np.ndarray) -> None:
        """From now on each lane's function covers its piece up to the lane's end."""
        index, d = np.arange(len(first)), 1
        while len(rows := np.flatnonzero(index - d >= first)):
            middle = self.to[rows - d]
            self.tokens[rows] = self.tokens[rows - d] + np.take_along_axis(self.tokens[rows], middle, 1)
            self.marks[rows] = self.marks[rows - d] | np.take_along_axis(self.marks[rows], middle, 1)
            self.to[rows] = np.take_along_axis(self.to[rows], middle, 1)
            d *= 2

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece and state of entry: the state at its end, the tokens, whether there is a mark."""
        n, some = len(self.offsets) - 1, np.diff(self.first) > 0
        to = np.tile(np.arange(4), (n, 1))
        tokens, marks = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
        last = self.first[1:][some] - 1
        to[some], tokens[some], marks[some] = self.to[last], self.tokens[last], self.marks[last]
        return to, tokens, marks

    def select(self, piece: np.ndarray, entry: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte, counted from the piece's start, at which token `k` (from 0) of each piece starts."""
        lane, high = self.first[piece].copy(), self.first[piece + 1] - 1
        while (open_ := lane < high).any():  # the first lane whose tokens so far are more than k
            middle = (lane + high) // 2
            more = self.tokens[middle, entry] > k
            high = np.where(open_ & more, middle, high)
            lane = np.where(open_ & ~more, middle + 1, lane)
        inner = lane > self.first[piece]
        before = np.where(inner, lane - 1, lane)
        state = np.where(inner, self.to[before, entry], entry).astype(np.uint8)
        left = k - np.where(inner, self.tokens[before, entry], 0)
        out = np.full(len(k), -1, np.int64)
        for step in range(LANE):
            v = _STEP[self._codes(lane, step) + state]
            starts = (v & 4) > 0
            out[starts & (left == 0)] = step
            left -= starts
            state = v & 3
        return out + self.start[lane] - self.offsets[piece]


def _scan(texts: pa.Array) -> Scan:
    values = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return Scan(data, offsets - offsets[0])


def _places(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before the middle and before the suffix."""
    return np.minimum(a % (n + 1), b % (n + 1)), np.maximum(a % (n + 1), b % (n + 1))


#: What is known of a text once it is scanned: its tokens, whether it holds a mark, and the bytes at which middle and suffix start.
CUTS = "n: long, marked: boolean, middle_at: long, suffix_at: long"


def _cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Cuts of texts that are one piece each."""
    out = [[], [], [], []]
    for batch in steps([pa.RecordBatch.from_arrays([text, a, b], names=["text", "a", "b"])], "text"):
        scan = _scan(batch.column("text"))
        _, tokens, marks = scan.pieces()
        n, sizes = tokens[:, OUT], np.diff(scan.offsets)
        for x, y in zip(out, (n, marks[:, OUT] > 0), strict=False):
            x.append(y)
        for x, k in zip(out[2:], _places(n, *(batch.column(c).to_numpy() for c in ("a", "b"))), strict=True):
            at, inside = sizes.copy(), np.flatnonzero(k < n)
            at[inside] = scan.select(inside, np.zeros(len(inside), np.int64), k[inside])
            x.append(at)
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.StructArray.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(bool)), pa.array(columns[2]), pa.array(columns[3])], names=[f.split(":")[0] for f in CUTS.split(", ")])


def _cut_pieces(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts as pieces of at most `size` bytes, some MB of them at a time."""
    names = ["key", "a", "b", "piece", "bytes"]
    for batch in batches:
        for row in range(batch.num_rows):
            key, a, b, text = (batch.column(c)[row] for c in ("key", "a", "b", "text"))
            data = text.as_buffer()
            starts = range(0, data.size, size)
            for few in (starts[k : k + max(1, STEP_BYTES // size)] for k in range(0, len(starts), max(1, STEP_BYTES // size))):
                parts = pa.array([data.slice(s, min(size, data.size - s)).to_pybytes() for s in few], pa.binary())
                number = pa.array([s // size for s in few], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(few), x.type) for x in (key, a, b)] + [number, parts], names=names)
    release()


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "bytes"):
        scan = _scan(batch.column("bytes"))
        lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in scan.pieces()]
        keep = [batch.column(c) for c in ("key", "a", "b", "piece")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(scan.offsets)), *lists], names=["key", "a", "b", "piece", "size", "to", "tokens", "marks"])


#: The piece that holds a cut (-1: the end of the text), the state it is entered in, tokens and bytes before.
PLACED = "key string, n long, marked boolean, piece int, entry long, k long, base long"


def _placed(group: pa.Table) -> pa.Table:
    """Both cuts of a text from the functions of its pieces: a row for each 64 KiB of one text, so a bounded group."""
    group = group.sort_by("piece")
    to, tokens, marks = (np.array(group.column(c).to_pylist(), np.int64) for c in ("to", "tokens", "marks"))
    state, entry, before, marked = OUT, [], [0], False
    for k in range(len(to)):
        entry.append(state)
        before.append(before[-1] + int(tokens[k, state]))
        marked |= bool(marks[k, state])
        state = int(to[k, state])
    bases = np.concatenate([[0], np.cumsum(group.column("size").to_numpy())])
    n, rows = before[-1], []
    for k in _places(np.array([n]), *(group.column(c).to_numpy()[:1] for c in ("a", "b"))):
        k = int(k[0])
        piece = int(np.searchsorted(before, k, side="right")) - 1 if k < n else -1
        rows.append((n, marked, piece, entry[piece] if k < n else 0, k - before[piece] if k < n else 0, int(bases[piece])))
    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
    return pa.table([group.column("key").slice(0, 1).combine_chunks().take(pa.array([0, 0])), *arrays], names=[f.split()[0] for f in PLACED.split(", ")])


def _selected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "bytes"):
        scan = _scan(batch.column("bytes"))
        at = scan.select(np.arange(batch.num_rows), batch.column("entry").to_numpy(), batch.column("k").to_numpy())
        keep = [batch.column(c) for c in ("key", "n", "marked")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(at + batch.column("base").to_numpy())], names=["key", "n", "marked", "at"])


def _cuts_of_large(large: DataFrame, piece_bytes: int) -> DataFrame:
    """(key, CUTS) of texts of many pieces: every piece is scanned by itself, and read once more if it holds a cut."""
    cut = large.select("key", "a", "b", "text").mapInArrow(lambda x: _cut_pieces(x, piece_bytes), "key string, a long, b long, piece int, bytes binary")
    pieces = cut_lineage(cut.repartition("key", "piece"))
    shape = "key string, a long, b long, piece int, size long, to array<long>, tokens array<long>, marks array<long>"
    functions = pieces.mapInArrow(_functions, shape).dropDuplicates(["key", "piece"])
    placed = cut_lineage(functions.groupBy("key").applyInArrow(_placed, PLACED))
    found = placed.where("piece >= 0").join(pieces.select("key", "piece", "bytes"), ["key", "piece"]).select("key", "n", "marked", "entry", "k", "base", "bytes")
    at = found.mapInArrow(_selected, "key string, n long, marked boolean, at long")
    at = at.unionByName(placed.where("piece < 0").select("key", "n", "marked", F.col("base").alias("at")))
    return at.groupBy("key", "n", "marked").agg(F.min("at").alias("middle_at"), F.max("at").alias("suffix_at"))


def _word(hash_: Column, k: int) -> Column:
    """Group `k` (from 1) of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(hash_, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "1", plain_from: int = 90, spm_below: int = 20, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    A text's tokens are its runs of ASCII letters and all other characters one by one; the hash of
    `seed`, a colon and the id says after how many of the `n` tokens the middle and the suffix
    start, and which form is written: plain, `<P>` prefix `<S>` suffix `<M>` middle (psm), or
    `<S>` suffix `<P>` prefix `<M>` middle (spm).  Texts that hold one of the marks stay plain, as
    do empty ones; null counts as empty, and a null id is hashed as no digits.  Repeated rows give
    equal rows, an empty table an empty one; no other column is read.

    Texts of up to `piece_bytes` bytes are scanned where they are, with only the cuts coming back.
    Longer ones are cut into pieces that are dealt to all tasks; a row of four states for each
    piece goes to one task a text, which says which pieces hold the cuts, and these are read again.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("hash"))
    rows = rows.select("doc_id", "text", *(_word(F.col("hash"), k).alias(c) for k, c in enumerate("abcd", 1)))
    small = rows.where(F.octet_length("text") <= piece_bytes).withColumn("cuts", F.arrow_udf(_cuts, f"struct<{CUTS}>")("text", "a", "b")).select("*", "cuts.*").drop("cuts")
    # Rows of one id and text have one key, and equal results.
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    large = rows.where(F.octet_length("text") > piece_bytes).withColumn("key", key)
    large = large.join(_cuts_of_large(large, piece_bytes), "key").drop("key")
    whole = small.unionByName(large)

    def span(start: Column, end: Column) -> Column:
        return F.substring(F.col("text").cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    m, s, end = F.col("middle_at"), F.col("suffix_at"), F.octet_length("text").cast("long")
    form = F.when((F.col("text") == "") | F.col("marked") | (F.col("c") % 100 >= plain_from), "plain").when(F.col("d") % 100 < spm_below, "spm").otherwise("psm")
    parts = whole.select("doc_id", "n", form.alias("form"), "text", span(F.lit(0), m).alias("prefix"), span(m, s).alias("middle"), span(s, end).alias("suffix"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit("<P>"), "prefix", F.lit("<S>"), "suffix", F.lit("<M>"), "middle"))
    output = output.otherwise(F.concat(F.lit("<S>"), "suffix", F.lit("<P>"), "prefix", F.lit("<M>"), "middle"))
    chars = [F.when(F.col("form") != "plain", F.char_length(c)).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return parts.select("doc_id", "n", "form", *chars, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  A mark cannot arise where parts meet: each starts with `<` and ends with `>`."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))

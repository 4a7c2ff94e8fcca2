"""Repeated passages: a hash-compared suffix sort of the places where texts may be alike."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import cut_lineage, mixed, steps

LENGTH = 400
#: Distinct regions of one anchor that one task sorts; beyond, they are dealt by what their strings share.
MOST_REGIONS = 2000
#: Places that the low bits of a hash tell apart; longer buffers are taken in parts.
PLACES = 1 << 24
#: Starts that share a key when the regions of an anchor are dealt.
DEALT_STARTS = 32
#: Classes of texts' hashes, those that hold a wanted text being broadcast: a proven bound of the side's rows.
TEXT_CLASSES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


class Hashes:
    """Polynomial hashes of a buffer's prefixes, from which that of any substring follows."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_INVERSE, n), out=self.prefix[1:])
        self.lift = _power(_BASE, n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.lift[start]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in turn."""
    size, now = 1, x
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def _least_places(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` values in turn by their upper bits, the first of equals."""
    low = np.uint64(PLACES - 1)
    out = np.empty(len(x) - width + 1, np.int64)
    for a in range(0, len(out), PLACES - width + 1):  # parts share the values of the windows between them
        part = x[a : a + PLACES]
        least = _window_min((part & ~low) | np.arange(len(part), dtype=np.uint64), width)
        out[a : a + len(least)] = (least & low).astype(np.int64) + a
    return out


def regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of `length` bytes: (text, start, span, anchor's place, anchor hash).

    A string's anchor is the substring of half its length with the least hash, the first of equals,
    so that equal strings have equal anchors at equal places.  A region is what a run of strings
    with one anchor covers.
    """
    n, anchor = len(data), length // 2
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    hashes = Hashes(data)
    x = mixed(hashes.of(np.arange(n - anchor + 1), anchor))
    least = _least_places(x, length - anchor + 1)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), starts)
    ends = np.cumsum(starts)
    start = np.arange(len(text)) - np.repeat(ends - starts, starts) + offsets[:-1][text]
    if not len(start):
        return none, none, none, none, none
    place = least[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    lo, span = start[first], start[last] - start[first] + length
    text = text[first]
    return text, lo - offsets[:-1][text], span, place[first] - lo, x[place[first]].view(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and each row's offset."""
    column = pc.cast(column, pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint8), offsets


def repeated_starts(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the suffixes share their first `length` bytes with another one of their group.

    Suffixes are dealt by group and first eight bytes, and each lot is merge-sorted.  Two are
    compared at the end of their common extension, which a binary search over the hashes of
    prefixes finds in a logarithmic number of steps.  Neighbours in the order that agree in
    `length` bytes by hash are then compared byte by byte.
    """
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    hashes = Hashes(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | padded[k : k + len(data)]
    order = np.lexsort((eight[start], group))
    s, g = start[order], group[order]
    e = eight[s]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
    lot = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(s)))
    use = np.flatnonzero(size[lot] > 1)
    order, s, lot = order[use], s[use], lot[use]
    if not len(s):
        return out
    fresh = np.ones(len(s), bool)
    fresh[1:] = lot[1:] != lot[:-1]
    lot = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(s)))

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = hashes.of(a, mid) == hashes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = extension(a, b)
        whole = n >= length
        n = np.minimum(n, length - 1)
        return np.where(whole, or_equal, data[a + n] < data[b + n])

    width, most = 1, int(size.max())
    while width < most:
        live = np.flatnonzero(size[lot] > width)
        own = lot[live]
        within = live - begin[own]
        block = within // width
        other = block ^ 1
        at = begin[own] + other * width
        count = np.clip(size[own] - other * width, 0, width)
        is_right = (block & 1).astype(bool)
        low, high = np.zeros(len(live), np.int64), count.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            # Counted among the others are those that come before: of equals, the left block's.
            comes = before(s[at[open_] + mid], s[live[open_]], is_right[open_])
            low[open_] = np.where(comes, mid + 1, low[open_])
            high[open_] = np.where(comes, high[open_], mid)
        to = begin[own] + (block - is_right) * width + (within - block * width) + low
        s_new, order_new = s.copy(), order.copy()
        s_new[to], order_new[to] = s[live], order[live]
        s, order = s_new, order_new
        width *= 2
    pair = np.flatnonzero(lot[1:] == lot[:-1])
    a, b = s[pair], s[pair + 1]
    near = hashes.of(a, length) == hashes.of(b, length)
    pair, a, b = pair[near], a[near], b[near]
    same = np.ones(len(pair), bool)
    for k in [*range(0, length - 8, 8), length - 8] if length >= 8 else []:
        same &= eight[a + k] == eight[b + k]
    out[order[pair[same]]] = True
    out[order[pair[same] + 1]] = True
    return out


def _sorted_regions(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated strings, from distinct regions that come ordered by anchor."""
    names = ["doc_id", "tie", "start", "end"]
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key = table.column("h").to_numpy()
        data, offsets = _bytes_of(table.column("bytes").combine_chunks())
        count = np.maximum(np.diff(offsets) - length + 1, 0)
        region = np.repeat(np.arange(len(count)), count)
        ends = np.cumsum(count)
        start = np.arange(len(region)) - np.repeat(ends - count, count) + offsets[:-1][region]
        hit = np.flatnonzero(repeated_starts(data, start, np.unique(key, return_inverse=True)[1][region], length) & table.column("alone").to_numpy(zero_copy_only=False)[region])
        fresh, last = np.ones(len(hit), bool), np.ones(len(hit), bool)
        fresh[1:] = (hit[1:] != hit[:-1] + 1) | (region[hit[1:]] != region[hit[:-1]])
        last[:-1] = fresh[1:]
        a, b = hit[fresh], hit[last]
        of = pa.array(region[a])
        base = table.column("lo").to_numpy()[region[a]] - offsets[:-1][region[a]]
        columns = [table.column("doc_id").take(of), table.column("tie").take(of), pa.array(base + start[a]), pa.array(base + start[b] + length)]
        return pa.RecordBatch.from_arrays([pc.cast(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, pa.int64()) for c in columns], names=names)

    for batch in steps(batches, "bytes", 1 << 20):
        if not batch.num_rows:
            continue
        key = batch.column("h").to_numpy()
        other = np.flatnonzero(key != key[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the last anchor's regions begin
        if last or (held and held[-1].column("h")[0].as_py() != key[0]):
            yield out(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield out(pa.Table.from_batches(held))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, tie, spans): ranges of bytes of each text that strings of `length` bytes cover which start anywhere else too.

    `tie` is a hash of the text, so that rows are told apart by id and text; rows that repeat both
    have one entry, as their spans are the same.

    Equal strings have equal anchors, so only regions whose anchor occurs more than once can hold
    any.  A region that occurs again as a whole, by its anchor's hash and 64 bits of its SHA-256, is
    one span.  Of the others, one of each goes to a task with those of its anchor, where their suffixes are
    sorted.  An anchor of more than MOST_REGIONS distinct regions is not sorted in one task: its
    regions are cut into blocks of DEALT_STARTS starts, equal blocks are counted, and the starts of
    one of each distinct block are counted by the digests of their strings; both are plain
    aggregations with joins that Spark can split.
    """
    source = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = "doc_id long, tie long, lo int, span int, at int, h long, own long"

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            data, offsets = _bytes_of(batch.column("text"))
            row, lo, span, at, h = regions(data, offsets, length)
            if len(row):
                of, view = pa.array(row), memoryview(data)
                begin = offsets[:-1][row] + lo
                digest = b"".join([hashlib.sha256(view[a:b]).digest()[:8] for a, b in zip(begin.tolist(), (begin + span).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of), batch.column("tie").take(of), pa.array(lo, pa.int32()), pa.array(span, pa.int32()), pa.array(at, pa.int32()), pa.array(h), pa.array(np.frombuffer(digest, np.int64))], names=[f.split()[0] for f in kind.split(", ")]
                )

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sorted_regions(batches, length)

    anchors = source.select("doc_id", "tie", "text").mapInArrow(find, kind)
    # Written first, so that both sides of the join are plain shuffles and a hot anchor's rows can be split.
    shared = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("own").alias("a"), F.max("own").alias("b")).where("n > 1").select("h", (F.col("a") == F.col("b")).alias("pure"))
    shared = cut_lineage(shared)
    again = cut_lineage(anchors.join(shared, "h"))
    several = again.where("not pure").groupBy("h", "own").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "lo", "span", "at")).alias("one"))
    several = cut_lineage(several.select("h", "own", "n", "one.*"))
    twice = several.where("n > 1").select("h", "own", F.lit(True).alias("twice"))
    whole = again.hint("merge").join(twice.hint("merge"), ["h", "own"], "left").where("pure or twice")
    whole = whole.select("doc_id", "tie", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("span")).cast("long").alias("end"))

    hot = several.groupBy("h").agg(F.count("*").alias("regions")).where(F.col("regions") > MOST_REGIONS).select("h", F.lit(True).alias("hot"))
    wanted = several.join(hot, "h", "left").groupBy(F.col("doc_id").alias("i"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("h", "lo", "span", "at", (F.col("n") == 1).alias("alone"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    # Rows that repeat id and text bring their regions more than once; none of these is alone, so that nothing follows from it.
    # Of the texts, only those whose class holds a wanted one are shuffled.
    classes = several.select(_class_of(F.col("tie")).alias("class")).distinct()
    near = source.withColumn("class", _class_of(F.col("tie"))).join(F.broadcast(classes), "class", "left_semi").drop("class")
    cut = near.join(wanted, near["doc_id"].eqNullSafe(wanted["i"]) & (near["tie"] == wanted["t"])).select("doc_id", "tie", F.encode("text", "utf-8").alias("raw"), F.explode("wanted").alias("w"))
    cut = cut.select("doc_id", "tie", F.col("w.h").alias("h"), F.col("w.alone").alias("alone"), F.col("w.hot").alias("hot"), F.col("w.lo").cast("long").alias("lo"), F.col("w.at").alias("at"), F.expr("substring(raw, w.lo + 1, w.span)").alias("bytes"))
    usual = cut.where("not hot").repartition("h").sortWithinPartitions("h").select("doc_id", "tie", "h", "alone", "lo", "bytes").mapInArrow(sort, "doc_id long, tie long, start long, end long")
    return whole.unionByName(usual).unionByName(_dealt(cut.where("hot"), length)).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _class_of(tie):
    return F.pmod(tie, F.lit(TEXT_CLASSES))


def _dealt(cut: DataFrame, length: int) -> DataFrame:
    """(doc_id, tie, start, end) of repeated strings among regions (doc_id, tie, h, alone, lo, at, bytes) of hot anchors.

    Equal strings have equal anchors at equal places, so they are in blocks of one number q.
    """

    def digest(column):
        return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)

    starts = F.octet_length("bytes") - length + 1
    last, first = F.floor(F.col("at") / DEALT_STARTS).cast("int"), F.floor((F.col("at") - starts + 1) / DEALT_STARTS).cast("int")
    blocks = cut.withColumn("q", F.explode(F.sequence(first, last)))
    blocks = blocks.withColumns({"off": F.greatest(F.lit(0), F.col("at") - (F.col("q") + 1) * DEALT_STARTS + 1), "upto": F.least(starts, F.col("at") - F.col("q") * DEALT_STARTS + 1)})
    blocks = blocks.select("doc_id", "tie", "h", "alone", (F.col("lo") + F.col("off")).alias("lo"), (F.col("at") - F.col("off")).alias("at"), F.expr(f"substring(bytes, off + 1, upto - off + {length - 1})").alias("bytes"))
    blocks = cut_lineage(blocks.withColumn("block", digest("bytes")))
    one = F.min(F.struct("doc_id", "tie", "lo")).alias("one")
    counted = cut_lineage(blocks.groupBy("h", "at", "block").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.bool_and("alone").alias("alone"), one))
    copies = blocks.where("alone").hint("merge").join(counted.where("n > 1").select("h", "at", "block").hint("merge"), ["h", "at", "block"])
    copies = copies.select("doc_id", "tie", F.col("lo").alias("start"), (F.col("lo") + F.octet_length("bytes")).alias("end"))
    string = counted.select("h", "at", (F.col("alone") & (F.col("n") == 1)).alias("alone"), "one.*", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("k"))
    string = string.select("h", (F.col("at") - F.col("k")).alias("at"), "alone", "doc_id", "tie", (F.col("lo") + F.col("k")).alias("start"), digest(F.expr(f"substring(bytes, k + 1, {length})")).alias("string"))
    string = cut_lineage(string)
    again = cut_lineage(string.groupBy("h", "at", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    found = string.where("alone").hint("merge").join(again.hint("merge"), ["h", "at", "string"])
    return copies.unionByName(found.select("doc_id", "tie", "start", (F.col("start") + length).alias("end")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, text: str, length: int) -> DataFrame:
    """`docs` with the column _spans; rows whose text's class has none are not shuffled."""
    spans = cut_lineage(repeated_spans(docs, text, length).select(F.col("doc_id").alias("_i"), F.col("tie").alias("_t"), F.col("spans").alias("_spans")))
    classes = spans.select(_class_of(F.col("_t")).alias("_class"), F.lit(True).alias("_hit")).distinct()
    tied = docs.withColumn("_tie", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    tied = tied.withColumn("_class", _class_of(F.col("_tie"))).join(F.broadcast(classes), "_class", "left")
    hit = tied.where("_hit")
    found = hit.join(spans, hit["doc_id"].eqNullSafe(spans["_i"]) & (hit["_tie"] == spans["_t"]), "left").drop("_i", "_t")
    others = tied.where("_hit IS NULL").withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))
    return found.unionByName(others).drop("_tie", "_class", "_hit")


def removed_passages(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """REMOVED of every row: sizes, and the hash of the bytes that stay.

    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in the same
    text or another.  Null texts count as empty, and texts under `length` bytes lose nothing.  Rows
    that are repeated lose all strings, as each is the other's copy; none of a passage's copies stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            rows = []
            for raw, spans in zip(pc.cast(batch.column("text"), pa.large_binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw = raw or b""
                cut = merged([(s["start"], s["end"]) for s in spans or []])
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
            n, removed, spans, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=[f.split()[0] for f in REMOVED.split(", ")])

    plain = docs.select("doc_id", F.col(text).alias("text"))
    return _with_spans(plain, "text", length).select("doc_id", "text", "_spans").mapInArrow(run, REMOVED)


def without_passages(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated passages cut out of `text`, and n_chars, where there is one, counted again.

    A character is cut out if all its bytes are; one that is covered in part stays.  Null texts
    stay null.  Rows that repeat a text of `length` bytes or more lose it, as in removed_passages:
    to keep one of them, drop copies first.  Other columns come through as they are.
    """

    @F.pandas_udf("string")
    def cut_out(raw, spans):
        import pandas as pd

        out = []
        for x, own in zip(raw, spans, strict=True):
            if own is None or x is None:
                out.append(x)
                continue
            data, at, kept = x.encode(), 0, []
            for a, b in merged([(s["start"], s["end"]) for s in own]):
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    out = _with_spans(docs, text, length).withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut_out(F.col(text), F.col("_spans")))).drop("_spans")
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import components, cut_lineage, hashed, mixed, numbered, segment_sums, split_words, steps, texts_of

WORDS, THRESHOLD = 5, 0.8
#: A pair of Jaccard 0.8 shares none of 40 bands of 5 values with a probability of 1.3e-7.
BANDS, BAND = 40, 5
HASHES = BANDS * BAND
#: A pair is dropped when the posterior probability that it reaches the threshold is below this.
TOLERANCE = 1e-7
#: Values compared before each look at the posterior.
LOOKS = (16, 32, 64, 128, HASHES)
#: Texts, and bytes of their shingles, of one side of a block of pairs.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Bits of the filter that tells which texts are worth a second look: 128 KB, however large the corpus.
FILTER_BITS = 1 << 20
_rng = np.random.default_rng(3)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the distinct sorted 64-bit hashes of each text's runs of `words` words.

    Words are what stands between ASCII white space.  A text of fewer words has one shingle, all
    of them; one without words has none.
    """
    offsets, codes, names = split_words(texts)
    n = np.diff(offsets)
    h = hashed(names.cast(pa.string()))[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][of]
    ends = offsets[1:][of]
    value = np.zeros(len(of), np.uint64)
    for k in range(words):
        inside = place + k < ends
        value = np.where(inside, value * _M + h[np.minimum(place + k, len(h) - 1)] if len(h) else value, value)
    value = mixed(value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[fresh], value[fresh]
    return np.searchsorted(of, np.arange(len(n) + 1)), value


def minhashes(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """HASHES values of each text; all ones for a text without shingles."""
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        low = (values >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(low * _A[k] + _B[k], offsets[:-1][full])
    return out


def set_keys(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set of shingles."""
    sums = []
    for salt in (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x1234567887654321)):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values ^ salt), out=total[1:])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """At each look, the matches below which the posterior of reaching the threshold is under the tolerance.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), and its
    tail beyond the threshold is that of a binomial: P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in LOOKS:
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def linked_pairs(sig: np.ndarray, offsets: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of `left` with its partners in `right`, which stand after it where both are one list."""
    least = least_matches(threshold, tolerance)
    sizes = np.diff(offsets)
    _, ids = np.unique(values, return_inverse=True)
    table = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    same = left is right
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        a, b = sizes[i], sizes[others]
        others = others[np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9]
        seen, matches = 0, np.zeros(len(others), np.int64)
        for n, m in zip(LOOKS, least, strict=True):
            if not len(others):
                break
            matches = matches + (sig[others, seen:n] == sig[i, seen:n]).sum(axis=1)
            keep = matches >= m
            others, matches, seen = others[keep], matches[keep], n
        if not len(others):
            continue
        own = ids[offsets[i] : offsets[i + 1]]
        table[own] = True
        n = sizes[others]
        ends = np.cumsum(n)
        flat = np.repeat(offsets[:-1][others] - (ends - n), n) + np.arange(int(ends[-1]))
        shared = segment_sums(table[ids[flat]].astype(np.int64), np.concatenate([[0], ends]))
        table[own] = False
        found = others[shared >= threshold * (a + n - shared) - 1e-9]
        if len(found):
            yield i, found


def _verified(threshold: float, tolerance: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        first = group.column("block").to_numpy() == key[1].as_py()
        node, seen = np.unique(group.column("node").to_numpy(), return_index=True)  # rows of one id and text repeat
        group, first = group.take(pa.array(seen)), first[seen]
        weight = group.column("copies").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        blobs = group.column("shingles").to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in blobs])])
        values = np.frombuffer(b"".join(blobs), np.uint64)
        one = key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(first)
        right = left if one else np.flatnonzero(~first)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        for i, found in linked_pairs(sig, offsets, values, left, right, threshold, tolerance):
            links[i] += weight[found].sum()
            links[found] += weight[i]
            for r in {find(i), *map(find, np.unique(root[found]).tolist())}:
                a, b = find(i), r
                root[max(a, b)] = min(a, b)
        tops = [find(x) for x in range(len(node))]
        used = np.flatnonzero(links)
        return pa.table({"node": node[used], "links": links[used], "root": node[np.array(tops, np.int64)[used]]})

    return run


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, class_size, kept.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of at least
    `threshold`; a class is what such links connect, named by its least doc_id (null if it has
    none), whose first row is `kept`.  Null texts count as empty; a text without words is similar
    to nothing, a class of its own with no links.  Repeated rows are rows of their own.
    With `row`, a column of numbers of rows, they come back as the column row.

    Equal sets are one node from the start, with a count.  Nodes that share a band of MinHash
    values are connected to the least of that band's, which gives groups that hold every candidate
    pair.  Within a group, MinHash values are compared a few at a time, pairs whose posterior
    probability falls below the tolerance are dropped, and the rest are verified on whole sets.
    Large groups are cut into blocks, and blocks of pairs go to different tasks; what comes out of
    one is a row for each linked node, its links and a connected node, so that n alike documents
    make n rows, not n * n.
    """
    source = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(row).alias("row")] if row else []))

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            offsets, values = shingles(texts_of(batch, "text"))
            sig = minhashes(offsets, values)
            keys = np.zeros((len(sig), BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(sig), b + 1, np.uint64)
                for k in range(BAND):
                    h = mixed(h * _M + sig[:, b * BAND + k])
                keys[:, b] = h
            h1, h2 = set_keys(offsets, values)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h1), pa.array(h2), pa.array(np.diff(offsets)), bands, *([batch.column("row")] if row else [])], names=["doc_id", "h1", "h2", "n", "bands", *(["row"] if row else [])])

    rows = source.mapInArrow(signed, "doc_id long, h1 long, h2 long, n long, bands array<long>" + (", row long" if row else ""))
    rows = cut_lineage(rows if row else rows.withColumn("row", F.monotonically_increasing_id()))
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("row"))).alias("first"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes)
    dealt = rows.join(nodes.select("node"), rows["row"] == nodes["node"], "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    least = dealt.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    stars = dealt.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = components(stars).select("node", F.col("label").alias("of"))
    members = cut_lineage(nodes.join(groups, "node").select("node", "of", "h1", "h2", "least_id", "copies"))

    bit = F.pmod(F.col("h1"), F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in members.select(bit.cast("int").alias("bit")).distinct().toLocalIterator()]] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(wanted.value).astype(bool)
        for batch in steps(batches, "text"):
            offsets, values = shingles(texts_of(batch, "text"))
            h1, h2 = set_keys(offsets, values)
            take = np.flatnonzero(there[h1 % FILTER_BITS] & (np.diff(offsets) > 0))
            if not len(take):
                continue
            some = pc.take(batch.column("text"), pa.array(take))
            at, own = shingles(pc.fill_null(some, ""))
            sig = minhashes(at, own)
            blobs = [own[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column("doc_id"), pa.array(take)), pa.array(h1[take]), pa.array(h2[take]), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(blobs, pa.binary())], names=["id", "h1", "h2", "sig", "shingles"]
            )

    whole = source.mapInArrow(sets, "id long, h1 long, h2 long, sig binary, shingles binary")
    full = members.join(whole, (members["h1"] == whole["h1"]) & (members["h2"] == whole["h2"]) & members["least_id"].eqNullSafe(whole["id"])).select("of", "node", "copies", "sig", "shingles")
    sizes = rows.join(members.select("node", "of"), rows["row"] == F.col("node")).groupBy("of").agg(F.count("*").alias("rows"), F.sum(F.col("n") * 8).alias("bytes"))
    sizes = sizes.select("of", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    placed = full.join(sizes, "of").withColumn("block", block).withColumn("pair", F.explode(pairs))
    checked = placed.select("of", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "node", "copies", "sig", "shingles").groupBy("of", "i", "j").applyInArrow(_verified(threshold, tolerance), "node long, links long, root long")
    checked = cut_lineage(checked)

    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(labels, "node", "left").join(links, "node", "left").select("h1", "h2", "node", "copies", "first", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = named.groupBy("label").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"))
    out = named.join(classes, "label").select("h1", "h2", F.col("best.b").alias("class_id"), F.col("best.row").alias("kept_row"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size")
    plain = rows.select("row", "doc_id", "h1", "h2", "n")
    found = plain.where("n > 0").join(out, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"), *(["row"] if row else []))
    blank = plain.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), *(["row"] if row else []))
    return found.unionByName(blank)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that similar_documents keeps, with all their columns."""
    rows = numbered(docs)
    stays = similar_documents(rows, row="_row").where("kept").select(F.col("row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*docs.columns)

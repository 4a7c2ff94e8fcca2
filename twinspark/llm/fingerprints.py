"""Document fingerprints by randomised edit embedding: shared random walks over characters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.llm.shared import components, cut_lineage, mixed, release, steps, texts_of

#: Sampled positions of a walk, a byte each.
SLOTS = 256
#: Characters below OWN have random bits of their own; the others share SHARED more rows of them, but are sampled as themselves.
OWN, SHARED = 2048, 2048
#: Steps after which the walks' shared random bits come round again.
PERIOD = 1024
#: Bands, and the sampled slots of each: a pair of likeness 0.8 shares a band with a probability of 0.99.
BANDS, BAND = 40, 10
#: Fingerprints of one band's group that a task compares with as many others.
BLOCK_ROWS = 2048
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_rng = np.random.default_rng(11)


def _stays() -> list[bytes]:
    """For each row of random bits, and each step at which it is first read, the steps until the walk has moved on."""
    more = np.random.default_rng(12).random((OWN + SHARED - 256, PERIOD))
    moves = np.tile(np.concatenate([_rng.random((256, PERIOD)), more]) < 0.5, 2)
    moves[:, -1] = True
    out = np.zeros((OWN + SHARED, 2 * PERIOD), np.uint8)
    since = np.zeros(OWN + SHARED, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        since = np.where(moves[:, j], 1, since + 1)
        out[:, j] = since
    return [row[:PERIOD].tobytes() for row in out]


def _positions() -> np.ndarray:
    """Of each slot, the positions that it takes in turn as walks get longer.

    Each is the last record of a random order of all positions: uniform over the walk, and the
    same for walks of like length but for a share of their difference.
    """
    out = np.ones((SLOTS, 64))
    for k in range(1, 64):
        out[:, k] = np.floor(out[:, k - 1] / (1 - _rng.random(SLOTS))) + 1
    return np.minimum(out, 1 << 62).astype(np.int64) - 1


_STAYS, _AT = _stays(), _positions()
_BAND = np.stack([_rng.choice(SLOTS, BAND, replace=False) for _ in range(BANDS)])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def characters(of: np.ndarray) -> list[int]:
    """The row of random bits of each character."""
    return np.where(of < OWN, of, OWN + (of * np.uint32(0x9E3779B1) >> np.uint32(12)) % np.uint32(SHARED)).tolist()


def values(of: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The byte, from 1 to 255, that a character is in a slot: two characters agree in one of 255 slots, and no two in all."""
    keys = (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + slots.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return (mixed(keys) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def walk(chars: list[int], steps_at: list[int], step: int = 0) -> int:
    """Append the step at which each character is first read, from `step` on; the step after the last.

    A walk reads a character at each step, and moves on to the next if the bit that all walks share
    for that step and character is set.  After an edit two walks meet again soon, so that what
    they read differs in few steps: edit distance becomes Hamming distance.
    """
    append, mask = steps_at.append, PERIOD - 1
    for stays in map(_STAYS.__getitem__, chars):
        append(step)
        step += stays[step & mask]
    return step


def sampled(of: np.ndarray, steps_at: list[int], length: int) -> np.ndarray:
    """The slots: what the walk reads at the sampled positions; zeros where there is no character."""
    if not len(of):
        return np.zeros(SLOTS, np.uint8)
    slots = np.arange(SLOTS)
    at = _AT[slots, (_AT < length).sum(axis=1) - 1]
    return values(of[np.searchsorted(np.array(steps_at), at, side="right") - 1], slots)


def embed(texts: list[str]) -> np.ndarray:
    """The slots of each text; the share of equal slots is the likeness of two texts."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for k, text in enumerate(texts):
        of, steps_at = points(text), []
        out[k] = sampled(of, steps_at, walk(characters(of), steps_at))
    return out


def embed_edited(texts: list[str], edited: list[str], same: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of texts and of edited ones, whose first `same` characters are the text's: these are walked once."""
    out = np.zeros((2, len(texts), SLOTS), np.uint8)
    for k, (text, other, n) in enumerate(zip(texts, edited, same, strict=True)):
        of, steps_at = points(text), []
        end = walk(characters(of), steps_at)
        out[0, k] = sampled(of, steps_at, end)
        of, steps_at, end = points(other), steps_at[:n], steps_at[n] if n < len(steps_at) else end
        out[1, k] = sampled(of, steps_at, walk(characters(of[n:]), steps_at, end))
    return out[0], out[1]


def written(slots: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in slots]


def _slots(stored: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(stored.to_pylist()), np.uint8).reshape(-1, SLOTS)


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row: 2 hex digits for each slot; null counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(written(embed(texts_of(batch, text).to_pylist())))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """FINGERPRINTS of every row: its text's, and that of the text whose last half is the next document's.

    The next document is the one with the next smaller doc_id, and after the last the first; null
    ids come last, and rows of one id are in the order of their texts' hashes.  A lone row is its
    own next.  Rows are dealt into ranges in one shuffle; each task reads its ranges in order, and
    the first row of each range comes along once more at the end of the range before it.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []), reverse=True)
    # Ranges in reading order: 0 above the largest cut; rows without an id after all others, by their texts' hashes.
    cut_column = F.array(*[F.lit(-c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    of_null = F.floor((F.lit(0.5) - F.col("tie") / float(1 << 64)) * n).cast("int")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + of_null).otherwise(F.size(F.filter(cut_column, lambda c: c <= -F.col("doc_id"))))
    rows = rows.withColumn("part", part)
    heads = rows.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("tie").alias("t"))).alias("head"))
    turn = Window.orderBy("part")  # a row for each range
    heads = heads.select(F.col("part").alias("p"), "head.*", F.coalesce(F.lag("part").over(turn), F.max("part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    first = rows.join(F.broadcast(heads), (F.col("part") == F.col("p")) & (F.coalesce("doc_id", F.lit(0)) == F.col("i")) & (F.col("tie") == F.col("t")))
    first = first.select("doc_id", "text", "tie", F.col("before").alias("part"), F.lit(True).alias("again"))

    def out(ids: list, now: list[str], following: str) -> pa.RecordBatch:
        nexts = [*now[1:], following]
        same = [len(t) - len(t) // 2 for t in now]
        edited = [t[:k] + u[: len(t) - k] for t, u, k in zip(now, nexts, same, strict=True)]
        own, changed = embed_edited(now, edited, same)
        after = np.concatenate([own[1:], embed([following])])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in now], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array(written(own)),
                pa.array(written(changed)),
                pa.array((own == changed).mean(axis=1)),
                pa.array((own == after).mean(axis=1)),
            ],
            names=[f.split()[0] for f in FINGERPRINTS.split(", ")],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, now = [], []  # the rows that wait for the text after them; all but the last of a batch have theirs
        for batch in steps(batches, "text", 1 << 20):
            for i, t, again in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("again").to_pylist(), strict=True):
                if not again:
                    ids.append(i)
                    now.append(t)
                elif ids:  # of repeated heads the first
                    yield out(ids, now, t)
                    ids, now = [], []
            if len(ids) > 1:
                yield out(ids[:-1], now[:-1], now[-1])
                ids, now = ids[-1:], now[-1:]
        release()

    dealt = rows.withColumn("again", F.lit(False)).unionByName(first).repartitionByRange(n, "part").sortWithinPartitions("part", "again", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return dealt.select("doc_id", "text", "again").mapInArrow(run, FINGERPRINTS)


def near_documents(docs: DataFrame, likeness: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row: rows linked by fingerprints of at least `likeness`.

    Equal fingerprints are one class from the start; null and empty texts are such a class, and
    repeated rows have one class.  Each band of sampled slots deals the distinct ones' numbers into groups; those of groups of
    one go no further, the others get their fingerprints, and all pairs of a group are compared; large
    groups are cut into blocks, and blocks of pairs go to different tasks.  What comes out of one is a row
    for each linked fingerprint and a connected one.  A class has its least doc_id.
    """
    prints = cut_lineage(fingerprint_documents(docs, text).select("doc_id", F.unhex("fingerprint").alias("fingerprint")))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))

    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "fingerprint"):
            slots = _slots(batch.column("fingerprint"))
            keys = np.zeros((len(slots), BANDS), np.uint64)
            for b in range(BANDS):
                for k in _BAND[b]:
                    keys[:, b] = mixed(keys[:, b] * np.uint64(257) + slots[:, k] + np.uint64(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "keys"])

    dealt = nodes.select("node", "fingerprint").mapInArrow(banded, "node long, keys array<long>").select("node", F.posexplode("keys").alias("band", "key"))
    sizes = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("band", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    placed = dealt.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("pair", F.explode(pair))
    placed = placed.select("band", "key", "pair.i", "pair.j", "block", "node").join(nodes.select("node", "fingerprint"), "node")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        slots = _slots(group.column("fingerprint"))
        first = group.column("block").to_numpy() == key[2].as_py()
        one = key[2].as_py() == key[3].as_py()
        left = np.flatnonzero(first)
        right = left if one else np.flatnonzero(~first)
        root = np.arange(len(node))
        for k, i in enumerate(left.tolist()):
            others = right[k + 1 :] if one else right
            near = others[(slots[others] == slots[i]).sum(axis=1) >= likeness * SLOTS]
            if len(near):
                tops = np.unique(np.append(root[near], root[i]))
                root[np.isin(root, tops)] = tops[0]
        used = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[used], "b": node[root[used]]})

    links = placed.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long").distinct()
    labels = components(cut_lineage(links))
    named = cut_lineage(nodes.join(labels, "node", "left").select("fingerprint", "least_id", F.coalesce("label", "node").alias("label")))
    classes = named.groupBy("label").agg(F.min("least_id").alias("class_id"))
    return prints.join(named.select("fingerprint", "label"), "fingerprint").join(classes, "label").select("doc_id", "class_id")

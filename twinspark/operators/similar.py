"""Similar fingerprints: banded candidates, interval pairs, greedy leader groups."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a band of the prints whose pairs are to be found without loss.
WIDTH = 16
#: Pairs of all that are compared in the time of one that is met in a join, or of a row that is dealt to one.  Then blocks, unless these are smaller than the least or larger than the most rows.
DENSE, DEALT, BLOCKS, LEAST_ROWS, MOST_ROWS = 10, 500, 16, 2048, 131_072
#: Rows and columns of hashes that are compared at a time.
STEP_ROWS, STEP_COLUMNS = 16, 4096
#: Least and most rows of a block of runs that meets another as a whole, blocks that a run is to reach into, and pairs that a task is to make of them.
BLOCK_ROWS, REACH, TASK_PAIRS = (1024, 16_384), 32, 4_000_000


def heads(hashes: DataFrame, id: str = "vec_id") -> DataFrame:
    """(rep, bands, n): each distinct hash with the least id that has it, and how many do."""
    return hashes.groupBy("bands").agg(F.min(id).alias("rep"), F.count("*").alias("n"))


def sure_radius(bits: int, threshold: float, width: int = WIDTH) -> int:
    """Bits by which one band of a pair at the threshold may differ at most, whatever bits differ: their mean over all bands."""
    return int((100 - threshold) / 100 * bits + 1e-9) // (bits // width)


def _words(bits: int, width: int) -> Column:
    """The array `bands` as words of 64 bits; null if a band is."""
    per = 64 // width
    at = lambda k: F.when(F.size("bands") > k, F.get("bands", F.lit(k)).cast("long")).otherwise(F.lit(0).cast("long"))
    some = lambda w: [F.shiftleft(at(per * w + j), width * j) for j in range(per)]
    words = [reduce(Column.bitwiseOR, some(w)) for w in range(-(-bits // (per * width)))]
    return F.when(reduce(Column.__and__, [w.isNotNull() for w in words]), F.array(*words))


def _coded(hashes: DataFrame, id: str, bits: int, width: int) -> DataFrame:
    """(id, size, words) of the hashes, written; those that are null or have a null band are left out."""
    most, bands = (1 << width) - 1, -(-bits // (64 // width * width)) * (64 // width)
    sound = F.forall("bands", lambda x: F.coalesce(x.between(0, most), F.lit(True))) & (F.size("bands") <= bands)
    checked = F.when(F.coalesce(sound, F.lit(True)), F.size("bands")).otherwise(F.raise_error(F.lit(f"bands have {width} bits, and an array has {bands} at most")).cast("int"))
    # Written: it is read several times, and filters on words would else be worked out from the hashes' own sources.
    return cut(hashes.where("bands IS NOT NULL").select(F.col(id).alias("id"), checked.alias("size"), _words(bits, width).alias("words"))).where("words IS NOT NULL")


def _carried(bits: int, threshold: float, words: int) -> int:
    """Words that tell most random hashes from similar ones: half of a random pair's bits differ, 32 in each word; two words more than the differing bits allow hardly let one through."""
    return min(words, int((100 - threshold) / 100 * bits) // 32 + 3)


def _bands(width: int) -> Column:
    """The bands of `size` and `words`, which bits of a word they are told by their place."""
    per, most = 64 // width, (1 << width) - 1
    every = F.flatten(F.transform("words", lambda w: F.array(*[F.shiftrightunsigned(w, width * j).bitwiseAND(F.lit(most).cast("long")) for j in range(per)])))
    return F.slice(every, F.lit(1), F.col("size"))


def _crowded(coded: DataFrame, radius: int, width: int) -> bool:
    """Whether a join by bands is the larger work: DENSE pairs of all are compared in the time of one that shares a band, DEALT in that of a row dealt by its band."""
    n = coded.count()
    alike = coded.select(F.posexplode(_bands(width)).alias("band", "value")).groupBy("band", "value").agg(F.count("*").alias("n"))
    met, bands = alike.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return met * DENSE + 2.0 * bands * (1 + sum(comb(width, r) for r in range(radius + 1))) * DEALT > float(n) * n


def _compared(coded: DataFrame, bits: int, threshold: float, radius: int, width: int) -> DataFrame:
    """(rep, rep2, similarity) of all pairs of different hashes that share a band and are at least so similar, all with all.

    A task holds a block of the hashes, and half of the other blocks pass by, so that any two blocks meet once.  Pairs are
    found where they meet, and are not shuffled.  Words are compared one after the other; what is left after the first few is compared whole.
    """
    n, words = coded.count(), -(-bits // (64 // width * width))
    blocks = max(min(BLOCKS, n // LEAST_ROWS), n // MOST_ROWS) | 1
    kind, few, most = coded.schema["id"].dataType.simpleString(), _carried(bits, threshold, words), int((100 - threshold) / 100 * bits + 1e-9) + 1
    placed = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    meets = [F.struct(F.lit(True).alias("own"), F.col("block").alias("task")), *[F.struct(F.lit(False).alias("own"), F.pmod(F.col("block") - k, F.lit(blocks)).alias("task")) for k in range(blocks // 2 + 1)]]
    sent = placed.withColumn("to", F.explode(F.array(*meets))).select("to.task", "to.own", "id", "size", "words", "block")
    dealt = sent.repartitionById(blocks, "task").sortWithinPartitions("task", F.desc("own"))

    def arrays(part: pa.RecordBatch) -> tuple:
        table = part.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(part.num_rows, words)
        return part.column("id"), part.column("size").to_numpy(), part.column("block").to_numpy(), np.ascontiguousarray(table.T)

    def near(x: tuple, y: tuple, start: int, own: bool) -> pa.RecordBatch | None:
        columns, rows = slice(start, start + STEP_COLUMNS), y[3].shape[1]
        wrong = np.zeros((rows, x[3][0, columns].size), np.uint16)
        for w in range(few):
            wrong += np.bitwise_count(x[3][w, columns][None, :] ^ y[3][w][:, None])
        j, i = np.nonzero(wrong <= most)
        i += start
        differ = x[3][:, i] ^ y[3][:, j]
        count = np.bitwise_count(differ).sum(axis=0, dtype=np.int64)
        similarity = (1 - count / bits) * 100
        shared = np.zeros(len(i), bool)
        for k in range(64 // width * words):
            band = differ[k * width // 64] >> np.uint64(k * width % 64) & np.uint64((1 << width) - 1)
            shared |= (np.bitwise_count(band) <= radius) & (k < x[1][i])
        kept = np.flatnonzero(shared & (count > 0) & (x[1][i] == y[1][j]) & (similarity >= threshold))
        if len(kept):
            return pa.RecordBatch.from_arrays([x[0].take(pa.array(i[kept])), y[0].take(pa.array(j[kept])), pa.array(similarity[kept]), pa.array(np.full(len(kept), own))], names=["x", "y", "similarity", "own"])
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, x = None, [], None
        for batch in batches:
            turns = batch.column("task").to_numpy() * 2 + ~batch.column("own").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in pairwise(cuts) if b > a):
                if part.column("task")[0].as_py() != task:
                    task, held, x = part.column("task")[0].as_py(), [], None
                if part.column("own")[0].as_py():
                    held.append(part)
                    continue
                x = x or arrays(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                for mine in (True, False):
                    some = part.filter(pa.array((part.column("block").to_numpy() == task) == mine))
                    for y in (arrays(some.slice(k, STEP_ROWS)) for k in range(0, some.num_rows, STEP_ROWS)):
                        found = (near(x, y, start, mine) for start in range(0, len(x[1]), STEP_COLUMNS))
                        yield from (f for f in found if f is not None)

    met = dealt.mapInArrow(run, f"x {kind}, y {kind}, similarity double, own boolean").where("NOT own OR x < y")  # in its own block a pair meets twice
    return met.select(F.least("x", "y").alias("rep"), F.greatest("x", "y").alias("rep2"), "similarity")


def _joined(coded: DataFrame, bits: int, threshold: float, radius: int, width: int) -> DataFrame:
    """_compared() for bands that few hashes share: these are joined.

    The words that are dealt with an id are as many as tell random hashes from similar ones, so a pair is
    dropped where it meets; what is left is compared whole.
    """
    masks = [sum(1 << k for k in at) for r in range(radius + 1) for at in combinations(range(width), r)]
    words = -(-bits // (64 // width * width))
    carried = _carried(bits, threshold, words)
    every = [F.get("words", F.lit(k)).alias(f"w{k}") for k in range(words)]
    few = [f"w{k}" for k in range(carried)]
    left = coded.select(F.col("id").alias("rep"), "size", *every[:carried], F.posexplode(_bands(width)).alias("band", "value"))
    right = left.toDF("rep2", "size2", *[f"{w}_2" for w in few], "band", "value")
    if radius:
        left = left.withColumn("value", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(m)) for m in masks])))

    def alike(names: list[str]) -> Column:
        return (1 - sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_2"))) for w in names), F.lit(0)) / bits) * 100

    met = left.hint("merge").join(right, ["band", "value"]).where((F.col("rep") < F.col("rep2")) & (F.col("size") == F.col("size2")) & (alike(few) >= threshold))
    if carried == words:
        return met.select("rep", "rep2", alike(few).alias("similarity")).distinct()
    own = coded.select(F.col("id").alias("rep"), *every)
    near = met.select("rep", "rep2").distinct().join(own.hint("merge"), "rep").join(own.toDF("rep2", *[f"w{k}_2" for k in range(words)]).hint("merge"), "rep2")
    return near.withColumn("similarity", alike([f"w{k}" for k in range(words)])).where(F.col("similarity") >= threshold).select("rep", "rep2", "similarity")


def head_pairs(distinct: DataFrame, bits: int, threshold: float, radius: int = 0, width: int = WIDTH) -> DataFrame:
    """Pairs (rep, rep2, similarity) of the distinct hashes that share a band and are at least so similar, in percent.

    A band is an integer of at most `width` bits, and an array has no more bands than `bits` need, in whole words of 64; others raise.
    A band is shared if at most `radius` bits of it differ: one side is dealt to all such values.  Where bands are so
    common that they tell little, or dealt to so many values that a join is the larger work, all are compared with all.  Hashes with a null band, or of different lengths, are no pair.
    """
    coded = _coded(distinct, "rep", bits, width)
    return (_compared if _crowded(coded, radius, width) else _joined)(coded, bits, threshold, radius, width)


def banded_pairs(hashes: DataFrame, bits: int, threshold: float, id: str = "vec_id", radius: int = 0, width: int = WIDTH) -> DataFrame:
    """Pairs (a, b, similarity) of hashes that share a band and are at least so similar, in percent.

    `hashes` has the id and `bands`, the hash as an array of bands.  Equal hashes are paired with each
    other at the end: n of them make n * (n - 1) / 2 pairs, so use similar_groups where groups are
    all that is wanted.  They are one row while pairs are sought by a join, but not where all are compared
    with all, as the pairs found would have to be joined.  With a radius of
    sure_radius(bits, threshold) no pair at the threshold is missed.
    """
    distinct = heads(hashes, id)
    coded = _coded(hashes, id, bits, width)
    if _crowded(coded, radius, width):
        many = distinct.where("n > 1").select("bands", "rep")
        members = hashes.select(F.col(id).alias("a"), "bands").join(many, "bands").select("a", "rep")
        out = _compared(coded, bits, threshold, radius, width).toDF("a", "b", "similarity")
    else:
        members = hashes.select(F.col(id).alias("a"), "bands").join(distinct.select("bands", "rep"), "bands").select("a", "rep")
        others = members.select(F.col("a").alias("b"), F.col("rep").alias("rep2"))
        out = _joined(_coded(distinct, "rep", bits, width), bits, threshold, radius, width).join(members, "rep").join(others, "rep2")
        out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    twins = members.join(members.select(F.col("a").alias("b"), F.col("rep").alias("rep2")), F.col("rep") == F.col("rep2")).where("a < b").select("a", "b", F.lit(100.0).alias("similarity"))
    return out.unionByName(twins)


def similar_groups(hashes: DataFrame, bits: int, threshold: float, id: str = "vec_id", radius: int = 0, width: int = WIDTH) -> DataFrame:
    """(member, leader): the groups of greedy_groups(banded_pairs(...)), with one row for each of many equal hashes, not pairs of them.

    Equal hashes have the same neighbours and one of them leads only if it has the least id, so
    groups of the distinct hashes' least ids are groups of all.
    """
    distinct = heads(hashes, id)
    led = leaders(head_pairs(distinct, bits, threshold, radius, width).select(F.col("rep").alias("a"), F.col("rep2").alias("b")))
    named = distinct.join(led, F.col("rep") == F.col("v"), "left").select("bands", "n", F.coalesce("leader", "rep").alias("leader"))
    grouped = named.groupBy("leader").agg(F.sum("n").alias("members")).where("members > 1").select("leader")
    named = named.join(grouped, "leader", "left_semi").select("bands", "leader")
    return hashes.select(F.col(id).alias("member"), "bands").join(named, "bands").select("member", "leader")


def running(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """`rows` with the sum of `amount` over all rows up to each in `order`, which no two rows share: sorted by ranges, summed in each, and lifted by the ranges before."""
    ranged = rows.withColumn("_amount", amount.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"_range": F.spark_partition_id()}))
    ranges = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = ranges.withColumn("_before", before).drop("_sum")
    within = F.sum("_amount").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_within", within).join(ranges, "_range").withColumn(name, F.col("_within") + F.col("_before")).drop("_amount", "_range", "_within", "_before")


def interval_runs(rows: DataFrame, tolerance: int = 2000) -> DataFrame:
    """(id, ms, place, last_place): rows numbered by value and id, and the last whose value is within the tolerance above.

    Each row pairs with those after it up to last_place: a row for each row, however many values are
    alike.  Ids are distinct; a null value pairs with nothing and is left out.
    """
    known = rows.where("ms IS NOT NULL").select("id", F.col("ms").cast("long").alias("ms"))
    # Up to a value, rows come before the probes that ask how many there are.
    probes = known.select("ms").distinct().select((F.col("ms") + tolerance).alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(known.schema["id"].dataType).alias("id"))
    marks = known.select(F.col("ms").alias("at"), F.lit(0).alias("probe"), "id").unionByName(probes)
    counted = cut(running(marks, ["at", "probe", "id"], 1 - F.col("probe"), "count"))
    ends = counted.where("probe = 1").select((F.col("at") - tolerance).alias("ms"), F.col("count").alias("last_place"))
    return counted.where("probe = 0").select("id", F.col("at").alias("ms"), F.col("count").alias("place")).join(ends, "ms").select("id", "ms", "place", "last_place")


def interval_pairs(rows: DataFrame, tolerance: int = 2000) -> DataFrame:
    """Pairs of ids whose values lie within the tolerance, the smaller id first: the runs of interval_runs() written out.

    The output has all pairs, and so may be far larger than the input.  Blocks of rows meet those
    that their runs reach into, each as one row of arrays; pairs are made where two blocks have met
    and are not shuffled.  No join key has more rows than one.
    """
    runs = cut(interval_runs(rows, tolerance))
    total, n = runs.agg(F.coalesce(F.sum(F.col("last_place") - F.col("place")), F.lit(0)), F.count("*")).first()
    size = min(max(BLOCK_ROWS[0], total // max(n, 1) // REACH), BLOCK_ROWS[1])
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))
    block = F.floor((F.col("place") - 1) / size)
    cells = runs.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "last_place", "id"))).alias("rows"), F.max(F.floor((F.col("last_place") - 1) / size)).alias("top"))
    cells = cut(cells)
    met = cells.select("block", F.explode(F.sequence("block", "top")).alias("other"))
    left = cells.select("block", F.explode(F.sequence("block", "top")).alias("other"), "rows").repartition(tasks, "block", "other")
    right = met.join(cells.select(F.col("block").alias("other"), F.col("rows.id").alias("ids")), "other").repartition(tasks, "block", "other")
    each = left.join(right, ["block", "other"]).select("other", "ids", F.explode("rows").alias("row"))
    first = F.greatest(F.col("row.place") + 1, F.col("other") * size + 1)
    last = F.least(F.col("row.last_place"), (F.col("other") + 1) * size)
    some = F.slice("ids", (first - F.col("other") * size).cast("int"), (last - first + 1).cast("int"))
    both = each.where(last >= first).select(F.col("row.id").alias("x"), F.explode(some).alias("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """(member, leader) as leaders() finds them; a leader without members is no group."""
    nodes = leaders(pairs)
    grouped = nodes.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
    return nodes.join(grouped, "leader", "left_semi").select(F.col("v").alias("member"), "leader")


def leaders(pairs: DataFrame) -> DataFrame:
    """(v, leader): in order of id, a free item leads and takes all free later ones that pair with it.

    The leaders are the first maximal independent set in order of id.  Each round decides every
    item that has no undecided smaller neighbour; rounds are cut at the checkpoint folder, so
    use it with spark.checkpoint.dir set.
    """
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("v"), F.lit(None).cast("long").alias("leader"))
    nodes = cut(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("leader", F.lit(None).cast("long")))
    while True:
        small = edges.join(nodes.select(F.col("v").alias("a"), F.col("leader").alias("of")), "a")
        around = small.groupBy(F.col("b").alias("v")).agg(F.min(F.when(F.col("of") == F.col("a"), F.col("a"))).alias("led_by"), F.count_if(F.col("of").isNull()).alias("open"), F.min(F.when(F.col("of").isNull(), F.col("a"))).alias("first_open"))
        # Taken once its smallest leading neighbour is sure: no undecided neighbour is smaller.
        sure = F.col("led_by").isNotNull() & (F.col("first_open").isNull() | (F.col("first_open") > F.col("led_by")))
        free = F.coalesce("open", F.lit(0)).eqNullSafe(F.lit(0)) & F.col("led_by").isNull()
        nodes = cut(nodes.join(around, "v", "left").select("v", F.coalesce("leader", F.when(sure, F.col("led_by")), F.when(free, F.col("v"))).alias("leader")))
        if nodes.where("leader IS NULL").isEmpty():
            return nodes


def find_similar(images: DataFrame, documents: DataFrame, bits: int, threshold: float) -> DataFrame:
    """(kind, member, leader): groups of alike images (id, bands), by greedy leaders, and of documents (id, identity) of one identity.

    A threshold says nothing about documents.  Files that are like no other are in no group.
    """
    alike = similar_groups(images, bits, threshold, "id").select(F.lit("image").alias("kind"), "member", "leader")
    first = documents.groupBy("identity").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return alike.unionByName(documents.join(first, "identity").select(F.lit("document").alias("kind"), F.col("id").alias("member"), "leader"))


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder that spark.checkpoint.dir names; without one, a folder of this machine, if all tasks run here."""
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="twinspark-")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it was not."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(context.getConf().get("spark.checkpoint.dir"), context.master))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def audio_similarity(pairs: DataFrame) -> DataFrame:
    """Percent of alike bits where two fingerprints (arrays a_print, b_print of words) align best.

    The offset with most words of fewer than half their bits different is taken, the smallest of
    equals; it has to cover four fifths of the shorter print, else the similarity is 0.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        def one(x, y) -> float:
            x, y = np.asarray(x, np.uint32), np.asarray(y, np.uint32)
            if not len(x) or not len(y):
                return 0.0
            best = (0, 0, 0.0)
            for d in range(-len(y) + 1, len(x)):
                u, v = x[max(d, 0) : d + len(y)], y[max(-d, 0) : max(-d, 0) + len(x) - max(d, 0)]
                n = min(len(u), len(v))
                wrong = np.bitwise_count(u[:n] ^ v[:n])
                like = wrong < 16
                if like.sum() > best[0]:
                    best = (int(like.sum()), d, float(wrong[like].mean()))
            return (1 - best[2] / 32) * 100 if best[0] >= 0.8 * min(len(x), len(y)) else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("similarity", score("a_print", "b_print"))

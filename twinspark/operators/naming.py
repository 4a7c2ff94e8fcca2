"""Free names for files that want the same one: numbered, never on top of another, in one order for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.operators.duplicates import KEY
from twinspark.operators.similar import cut

#: Fixed value: the last number that is tried.
LAST = 9999
#: Places of one name that are counted in one task.
SPAN = 1 << 16


def split_name(path: Column, dotfiles: bool) -> tuple[Column, Column]:
    """What a number goes between: the path up to the last dot of its name, and the rest.

    A leading dot parts a name only for `dotfiles`; without them a dot at the end is no part of either.
    """
    if dotfiles:
        return F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1)


def numbered_name(path: Column, number: Column, dotfiles: bool) -> Column:
    stem, rest = split_name(path, dotfiles)
    return F.when(number == 1, path).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), rest))


def _seats(names: DataFrame, name: str, dotfiles: bool) -> DataFrame:
    """For each of `names` the wishes that may lead to it, with the number: itself as 1, and the name without its number."""
    stem, rest = split_name(F.col(name), dotfiles)
    inner = F.struct(F.regexp_extract(stem, r" \(([1-9]\d{0,3})\)$", 1).try_cast("int").alias("n"), F.concat(F.regexp_extract(stem, r"^(.*) \([1-9]\d{0,3}\)$", 1), rest).alias("wish"))
    own = F.struct(F.lit(1).alias("n"), F.col(name).alias("wish"))
    every = names.select("*", F.inline(F.array(own, inner)))
    return every.where(F.col("n").between(1, LAST) & (numbered_name(F.col("wish"), F.col("n"), dotfiles) == F.col(name)))


def positions(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`rows` with `pos`, their place from 1 in the order of their key; a large key's rows are counted by ranges, over many tasks."""
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = cut(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = ranged.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).drop("_rows")
    return ranged.join(ranges, [*keys, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_range", "_at", "_first", "_before")


def sum_before(rows: DataFrame, key: str, at: str, amount: Column, name: str, large: bool = True) -> DataFrame:
    """`rows` with the sum of `amount` over the rows of their key whose `at` is smaller; SPAN values of `at` are one task's, or with `large` false a key's."""
    if not large:
        before = W.partitionBy(key).orderBy(F.col(at).cast("long")).rangeBetween(W.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(amount.cast("long")).over(before), F.lit(0)))
    rows = rows.withColumns({"_span": F.floor(F.col(at) / SPAN), "_amount": amount.cast("long")})
    spans = rows.groupBy(key, "_span").agg(F.sum("_amount").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_earlier", earlier).drop("_sum")
    within = F.coalesce(F.sum("_amount").over(W.partitionBy(key, "_span").orderBy(F.col(at).cast("long")).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(spans, [key, "_span"]).withColumn(name, F.col("_within") + F.col("_earlier")).drop("_span", "_amount", "_within", "_earlier")


def _state(files: DataFrame, gaps: DataFrame) -> tuple:
    """Numbers that change if what a round starts from does: who is skipped, and which names are not free."""
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    both = files.select(F.lit(0).alias("of"), total("wish", "pos", "skip").alias("t")).unionAll(gaps.select(F.lit(1), total("wish", "n", "since", "holds")))
    return tuple((r["of"], r["t"]) for r in both.collect())


def free_names(files: DataFrame, held: DataFrame, same_in_run: bool, dotfiles: bool) -> DataFrame:
    """`files` (wish, turn, size, hash, more) with the name they get: `skip`, or `number` and `path`.

    In the order of `turn`, which no two files share, each takes the first of its wish, the wish
    with (2), (3) and so on that is free.  A name is not free if `held` (path, size, hash) has it,
    or a file before took it, be it by its own wish or by another's number.  A file is skipped if
    a name that it passes holds its content, for names taken in this run only with `same_in_run`.
    Beyond LAST a file gets no name: `number` is null and it is not skipped.

    Files of one wish are placed by their rank among the free numbers.  That is exact as soon as
    names which other wishes take, and files that are skipped, are known; these are assumed, worked
    out anew from what follows, and so on until nothing changes.  Each file depends only on those
    before it, so what does not change is what one file after the other would have got.
    """
    files = positions(files, ["wish"], [F.col("turn")])
    wishes = files.select("wish").distinct()
    turn = files.schema["turn"].dataType
    fixed = _seats(held.select("path", *KEY), "path", dotfiles).join(wishes, "wish", "left_semi")
    fixed = cut(fixed.select("wish", "n", F.lit(None).cast(turn).alias("since"), *KEY, F.lit(False).alias("in_run")))
    # Only wishes that meet held names, or each other's numbers, need more than the rank.
    crossing = _seats(wishes.withColumnRenamed("wish", "other"), "other", dotfiles).where("wish <> other").join(wishes, "wish", "left_semi")
    met = cut(crossing.select(F.explode(F.array("wish", "other")).alias("wish")).unionAll(fixed.select("wish")).distinct())
    alone = files.join(met, "wish", "left_anti").withColumns({"skip": F.lit(False), "number": F.col("pos").cast("int")})
    files = files.join(met, "wish", "left_semi")
    known = fixed.select("wish", *KEY).distinct().withColumn("skip", F.lit(True))
    files = cut(files.join(known, ["wish", *KEY], "left").withColumns({"skip": F.coalesce("skip", F.lit(False)), "number": F.lit(None).cast("int")}))
    gaps = fixed.withColumn("holds", F.lit(True))
    large = (files.agg(F.max("pos")).first()[0] or 0) > SPAN  # whether any wish has more files than one task counts
    now, before = (None if met.isEmpty() else _state(files, gaps)), None
    while now != before:
        before = now
        ranks = sum_before(files.drop("number"), "wish", "pos", F.when(F.col("skip"), 0).otherwise(1), "k", large).withColumn("k", F.col("k") + 1)
        # A name that another took in this run is lost to the file that would take it only if it was taken before.
        below = sum_before(gaps, "wish", "n", F.when(F.col("holds"), 1).otherwise(0), "below", large).withColumn("_k", F.col("n") - F.col("below"))
        reached = ranks.where("not skip").select("wish", F.col("k").alias("_k"), F.col("turn").alias("reached"))
        holds = F.col("since").isNull() | F.col("reached").isNull() | (F.col("since") < F.col("reached"))
        gaps = below.join(reached, ["wish", "_k"], "left").withColumn("holds", holds).drop("reached", "below", "_k")
        # Numbers: the rank among files that are placed, moved on by the names that are not free.
        below = sum_before(gaps.where("holds").select("wish", "n"), "wish", "n", F.lit(1), "below", large)
        marks = below.select("wish", (2 * (F.col("n") - 1 - F.col("below")) + 1).cast("long").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("pos"))
        seats = ranks.select("wish", (2 * F.col("k")).cast("long").alias("at"), F.lit(0).alias("one"), "pos")
        passed = sum_before(seats.unionByName(marks), "wish", "at", F.col("one"), "passed", large).where("pos is not null").select("wish", "pos", "passed")
        placed = ranks.join(passed, ["wish", "pos"]).withColumn("number", (F.col("k") + F.col("passed")).cast("int"))
        there = gaps.where(F.lit(same_in_run) | ~F.col("in_run")).select("wish", *KEY, "n", "since")
        met = placed.join(there, ["wish", *KEY]).where("n < number and (since is null or since < turn)").select("wish", "pos").distinct().withColumn("met", F.lit(True))
        files = cut(placed.join(met, ["wish", "pos"], "left").withColumn("skip", F.coalesce("met", F.lit(False))).drop("met", "k", "passed"))
        # Names taken, where they stand in the way of other wishes.
        taken = files.where(~F.col("skip") & (F.col("number") <= LAST)).select("wish", "number", "turn", *KEY)
        taken = taken.withColumn("path", numbered_name(F.col("wish"), F.col("number"), dotfiles)).withColumnsRenamed({"wish": "own", "turn": "since"}).drop("number")
        others = _seats(taken, "path", dotfiles).where("wish <> own").join(wishes, "wish", "left_semi").withColumn("in_run", F.lit(True))
        every = fixed.unionByName(others.select(*fixed.columns))
        first = every.groupBy("wish", "n").agg(F.min_by(F.struct("since", *KEY, "in_run"), F.struct(F.col("since").isNotNull().alias("a"), F.col("since").alias("b"))).alias("f")).select("wish", "n", "f.*")
        was = gaps.select("wish", "n", "since", F.col("holds").alias("held"))
        same = (first["wish"] == was["wish"]) & (first["n"] == was["n"]) & first["since"].eqNullSafe(was["since"])
        gaps = cut(first.join(was, same, "left").select(first["*"], F.coalesce("held", F.lit(True)).alias("holds")))
        now = _state(files, gaps)
    number = F.when(~F.col("skip") & (F.col("number") <= LAST), F.col("number"))
    return files.unionByName(alone).withColumn("number", number).withColumn("path", numbered_name(F.col("wish"), F.col("number"), dotfiles)).drop("pos")

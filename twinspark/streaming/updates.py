"""Incremental catalogue updates and progress estimates over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from twinspark.operators.catalogue import changes

#: Seconds of the moving average.
TAU = 20.0


def update_from(walks: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that applies each micro-batch of walked files (repo, rel_path, size, modified_ms, hash) to the catalogue.

    `read` gives the catalogue (those columns and missing) as it is; `write` stores the next one, and has to be
    idempotent by batch id.  Only files that are new or differ are taken; one that is seen again is
    no change, so a batch that comes twice does nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        known = read()
        fresh = changes(known, batch).where("status IN ('added', 'updated')").select("repo", "rel_path")
        new = batch.dropDuplicates(["repo", "rel_path"]).join(fresh, ["repo", "rel_path"], "left_semi")
        rows = new.selectExpr("repo", "rel_path", "size", "modified_ms", "hash", "false AS missing")
        kept = known.select(*rows.columns).join(rows, ["repo", "rel_path"], "left_anti")
        write(kept.unionByName(rows), number)

    return walks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def rates(progress: DataFrame) -> DataFrame:
    """Bytes a second of each operation (operation, ms, bytes), a moving average over TAU seconds kept as state."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rate = state.get if state.exists else (None, 0.0)
        out = []
        # A micro-batch's rows of one operation come in several frames: they are put in order together.
        rows = sorted(x for frame in frames for x in zip(frame["ms"].tolist(), frame["bytes"].tolist(), strict=True))
        for ms, n in rows:
            if last is not None and ms > last:
                seconds = (ms - last) / 1000
                weight = 1 - 2.718281828459045 ** (-seconds / TAU)
                rate = rate + weight * (n / seconds - rate)
            last = ms if last is None else max(last, ms)
            out.append((key[0], int(ms), float(rate)))
        if last is not None:
            state.update((int(last), float(rate)))
        yield pd.DataFrame(out, columns=["operation", "ms", "rate"])

    return progress.groupBy("operation").applyInPandasWithState(step, "operation string, ms long, rate double", "last long, rate double", "append", GroupStateTimeout.NoTimeout)


def first_arrivals(events: DataFrame) -> DataFrame:
    """Arriving contents once each within the watermark: a second push of the same has nothing to do."""
    return events.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["size", "hash"])


def time_left(progress: DataFrame) -> DataFrame:
    """rates() rows (operation, ms, rate) with total and done bytes: seconds left at that rate; null while nothing moves."""
    from pyspark.sql import functions as F

    rest = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return progress.withColumn("seconds_left", F.when(F.col("rate") > 0, rest / F.col("rate")).when(rest == 0, F.lit(0.0)))


def read_walks(spark, folder: str, schema: str, files_at_a_time: int = 1000) -> DataFrame:
    """A stream of walked files from Parquet files, at most so many files in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def append_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Put a micro-batch into the log at `folder`, under its number: one that comes again takes its own place, and adds no line."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def log_events(events: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends what has come of `events` to the log at `folder`, each batch once."""
    return events.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark, folder: str) -> DataFrame:
    """The log's lines with the number of their batch."""
    return spark.read.option("basePath", folder).parquet(folder)

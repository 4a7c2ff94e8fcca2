"""Archives: members, what repositories hold of them, and listing of zip and tar files."""

from __future__ import annotations

import contextlib
import hashlib
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators.duplicates import KEY, live

MEMBERS = "path string, member_ord long, member_name string, size long, hash string, locked boolean"
LISTINGS = f"{MEMBERS}, capped string, last boolean"
#: Members of one archive, and its unpacked bytes for each byte packed or, if that is more, in all.
MOST_MEMBERS, MOST_RATIO, MOST_BYTES = 1_000_000, 1000, 4 << 30
#: Bytes of a member that are held at a time, and rows that are given back together.
PIECE, BATCH_ROWS = 1 << 20, 4096


class _OverBudget(Exception):
    pass


class _Budget:
    """What may still be read of one archive, and the limit that was met."""

    def __init__(self, members: int, unpacked: int) -> None:
        self.members, self.unpacked, self.hit = members, unpacked, None

    def member(self) -> bool:
        if self.members == 0:
            self.hit = self.hit or "members"
        self.members -= 1
        return self.hit is None

    def hashed(self, stream) -> tuple[int, str]:
        """Size and hash of a member, read in pieces; none beyond the budget is held or counted."""
        size, digest = 0, hashlib.sha256()
        while piece := stream.read(PIECE):
            size += len(piece)
            if size > self.unpacked:
                self.hit = "unpacked"
                raise _OverBudget
            digest.update(piece)
        self.unpacked -= size
        return size, digest.hexdigest()


def _zipped(data: io.BytesIO, budget: _Budget) -> Iterator[tuple]:
    with zipfile.ZipFile(data) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if not budget.member():
                return
            if info.flag_bits & 1:  # names and sizes can be read without the password
                yield info.filename, info.file_size, None, True
                continue
            try:
                stream = z.open(info)
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError):
                yield info.filename, info.file_size, None, False
                continue
            with stream, contextlib.suppress(zipfile.BadZipFile, zlib.error, EOFError):  # broken inside: passed over
                yield info.filename, *budget.hashed(stream), False


def _tarred(data: io.BytesIO, budget: _Budget) -> Iterator[tuple]:
    with tarfile.open(fileobj=data, mode="r:*") as t:
        for info in t:
            if info.isdir() or not info.name:
                continue
            if not budget.member():
                return
            yield info.name, *budget.hashed(t.extractfile(info) if info.isreg() else io.BytesIO()), False


def coverage(members: DataFrame, references: DataFrame) -> DataFrame:
    """Of each archive, how many members the references hold live, and whether that makes it redundant."""
    held = live(references).select(*KEY).distinct().withColumn("held", F.lit(True))
    rows = members.join(held, KEY, "left").groupBy("repo", "archive_rel").agg(F.count("*").alias("members"), F.count_if(F.coalesce("held", F.lit(False))).alias("present"), F.count_if("locked").alias("locked"))
    return rows.withColumns({"redundant": (F.col("members") > 0) & (F.col("present") == F.col("members")), "percent": F.round(F.when(F.col("members") == 0, 0.0).otherwise(F.col("present") * 100.0 / F.col("members")), 6)})


def members_by_content(members: DataFrame) -> DataFrame:
    place = F.concat_ws("/", "repo", "archive_rel", "member_name")
    return members.where("hash IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("occurrences"), F.array_join(F.sort_array(F.collect_list(place)), "|").alias("places"))


def member_places(members: DataFrame) -> DataFrame:
    """Where each content lies in archives, a row for each place, with the number of them."""
    known = members.where("hash IS NOT NULL")
    counts = known.groupBy(*KEY).agg(F.count("*").alias("occurrences"))
    return known.join(counts, KEY).select(*KEY, "occurrences", "repo", "archive_rel", "member_name")


def listings(contents: DataFrame, most_members: int = MOST_MEMBERS, most_ratio: int = MOST_RATIO, most_bytes: int = MOST_BYTES) -> DataFrame:
    """LISTINGS of zip, tar and tar.gz files (path, content): a row for each member, and one, `last`, for each archive.

    The last row tells the number and the bytes of the members listed, and in `capped` why there
    are no more: `members` or `unpacked` for the limit that was met, `unreadable` for what is no
    archive or broken, else null.  A locked member has no hash.  A member is read in pieces, and
    not beyond the budget; each archive is read in one task.  Null content is unreadable.
    """

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        budget = _Budget(most_members, max(most_ratio * len(content or b""), most_bytes))
        data, count, total, failed = io.BytesIO(content or b""), 0, 0, None
        try:
            listed = _zipped if zipfile.is_zipfile(data) else _tarred
            data.seek(0)
            for name, size, digest, locked in listed(data, budget):
                yield path, count, name, size, digest, locked, None, False
                count, total = count + 1, total + size
        except _OverBudget:
            pass
        except (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError):
            failed = "unreadable"
        yield path, count, None, total, None, None, budget.hit or failed, True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LISTINGS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in enumerate(types)], names=names)

        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in rows(path, content.as_py()):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return contents.select("path", "content").mapInArrow(run, LISTINGS)


def list_archives(contents: DataFrame) -> DataFrame:
    """MEMBERS of archives, as far as the limits allow; listings() tells which were met."""
    return listings(contents).where("not last").drop("capped", "last")

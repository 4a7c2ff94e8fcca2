"""Edits of the catalogue as new snapshots, change detection, grooming, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PATH = ["repo", "rel_path"]


class WouldEmptyIndex(ValueError):
    """A walk that found nothing would mark a whole repository as missing."""


def upsert(files: DataFrame, new: DataFrame) -> DataFrame:
    return files.join(new, PATH, "left_anti").unionByName(new)


def mark_missing(files: DataFrame, paths: DataFrame) -> DataFrame:
    hit = paths.select(*PATH).distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, PATH, "left").withColumn("missing", F.col("missing") | F.coalesce("_hit", F.lit(False))).select(*files.columns)


def remove(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select(*PATH), PATH, "left_anti")


def rename(files: DataFrame, repo: str, old: str, new: str) -> DataFrame:
    here = (F.col("repo") == repo) & (F.col("rel_path") == old)
    return files.withColumn("rel_path", F.when(here, F.lit(new)).otherwise(F.col("rel_path")))


def clone(files: DataFrame, source: str, name: str) -> DataFrame:
    return files.unionByName(files.where(F.col("repo") == source).withColumn("repo", F.lit(name)))


def prune(files: DataFrame) -> DataFrame:
    return files.where(~F.col("missing"))


def set_tags(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of paths replaced: trimmed, without blanks and repeats; no tags, no row."""
    clean = F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""))
    return annotations.join(new, PATH, "left_anti").unionByName(new.withColumn("tags", clean).where(F.size("tags") > 0))


def accepted_paths(files: DataFrame, accepted: DataFrame) -> DataFrame:
    return files.where(~F.col("missing")).join(accepted, ["repo", "size", "hash"], "left_semi")


#: Names of sounds in MP4 containers, which were once taken for videos.
MP4_SOUNDS = r"(?i)\.(m4a|m4b|m4p|m4r)$"


def is_stale(mime: Column, version: Column, path: Column | None = None) -> Column:
    """The entry version from which each kind has its fingerprint, and names of sounds their type."""
    audio = mime.startswith("audio/")
    office = mime.rlike("officedocument|opendocument|msword|ms-excel|ms-powerpoint")
    out = F.when(mime.startswith("image/"), version < 4).when(audio, version < 10).when(office, version < 5)
    out = out.when(mime.startswith("text/"), version < 6).when(mime == "message/rfc822", version < 7)
    if path is not None:
        out = out.when((mime == "video/mp4") & path.rlike(MP4_SOUNDS), version < 9)
    return F.coalesce(out.when(mime.startswith("video/"), version < 8), F.lit(False))


def stats(files: DataFrame) -> DataFrame:
    live = ~F.col("missing")
    return files.groupBy("repo").agg(F.count_if(live).alias("files"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if("missing").alias("missing_files"))


def mime_histogram(files: DataFrame) -> DataFrame:
    return files.where("NOT missing AND mime IS NOT NULL").groupBy("repo", "mime").agg(F.count("*").alias("files"))


def mime_share(files: DataFrame) -> DataFrame:
    """Percent of live files of each type; a type that is there never rounds to none."""
    total = F.sum("files").over(W.partitionBy("repo"))
    share = F.round(F.col("files") * 100 / total, 0).cast("long")
    return mime_histogram(files).withColumn("percent", F.greatest(share, F.lit(1).cast("long")))


def changes(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each path of a walk or of the catalogue: unchanged, added, updated or vanished."""
    known = files.select(*PATH, F.col("size").alias("known_size"), F.col("modified_ms").alias("known_ms"), "missing")
    both = snapshot.select(*PATH, "size", "modified_ms").join(known, PATH, "full_outer")
    same = (F.col("size") == F.col("known_size")) & (F.col("modified_ms") == F.col("known_ms"))
    status = F.when(F.col("size").isNull(), F.when(F.col("missing"), "known_missing").otherwise("vanished"))
    status = status.when(F.col("known_size").isNull(), "added").when(F.col("missing"), "updated").when(same, "unchanged").otherwise("updated")
    return both.select(*PATH, F.coalesce("size", "known_size").alias("size"), status.alias("status"))


def change_counts(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return (
        changes(files, snapshot)
        .groupBy("repo")
        .agg(count("added").alias("added"), count("updated").alias("updated"), count("unchanged").alias("unchanged"), count("vanished").alias("marked_missing"), F.coalesce(F.sum(F.when(F.col("status").isin("added", "updated"), F.col("size"))), F.lit(0)).alias("hashed_bytes"))
    )


def updated(files: DataFrame, snapshot: DataFrame, hashed: DataFrame, force: bool = False) -> DataFrame:
    """The next snapshot of the catalogue: `hashed` has whole rows for what was added or updated.

    Repositories that the walk did not touch stay; one that it found empty is refused unless forced.
    """
    walked = snapshot.select("repo").distinct()
    if not force:
        emptied = files.where("NOT missing").select("repo").distinct().join(walked, "repo", "left_anti")
        if not emptied.isEmpty():
            raise WouldEmptyIndex(emptied.first()["repo"])
    gone = changes(files, snapshot).where("status = 'vanished'")
    return mark_missing(upsert(files, hashed), gone)


def empty_directories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories (repo, dir) that hold no live file at any depth, deepest first."""
    parts = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    used = files.where("NOT missing").where(F.size(parts) > 1).select("repo", F.explode(ups).alias("dir")).distinct()
    return directories.join(used, ["repo", "dir"], "left_anti").withColumn("depth", F.size(F.split("dir", "/")).cast("long"))


def parents(files: DataFrame) -> DataFrame:
    """Every directory that a path of the catalogue, missing ones too, lies in."""
    parts = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.where(F.size(parts) > 1).select("repo", F.explode(ups).alias("dir")).distinct()


def preview(rows: DataFrame, limit: int) -> DataFrame:
    """The first paths, and how many there are in all; one row with the number is joined to them."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(*PATH, "size").orderBy(*PATH).limit(limit).crossJoin(F.broadcast(total))


def purge(files: DataFrame, expression: str | None, annotations: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """Live files that a filter matches; a blank filter, which elsewhere lets all through, matches none here."""
    from twinspark.functions.filters import matching

    return matching(files, expression, annotations, accepted) if (expression or "").strip() else files.where("false")


def refreshed(files: DataFrame, entry: DataFrame) -> DataFrame:
    """`files` with one walked file (repo, rel_path, size, hash, modified_ms, mime) taken anew; where it came from stays known."""
    new = [c for c in ("size", "hash", "modified_ms", "mime") if c in entry.columns]
    own = entry.select("repo", "rel_path", *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_seen"))
    out = files.join(F.broadcast(own), ["repo", "rel_path"], "left")
    changed = {c: F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)) for c in new}
    return out.withColumns(changed | {"missing": F.when(F.col("_seen"), F.lit(False)).otherwise(F.col("missing"))}).select(*files.columns)


def listing(files: DataFrame, repo: str, prefix: str) -> DataFrame:
    """What lies directly under a directory: its files, and directories with the files below them."""
    rest = F.expr(f"substring(rel_path, {len(prefix) + 1})")
    below = files.where(~F.col("missing") & (F.col("repo") == repo) & F.col("rel_path").startswith(prefix)).withColumn("rest", rest)
    is_dir = F.col("rest").contains("/")
    return below.groupBy(F.split("rest", "/")[0].alias("name"), is_dir.alias("is_dir")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def flat_listing(files: DataFrame, repo: str, prefix: str) -> DataFrame:
    return files.where(~F.col("missing") & (F.col("repo") == repo) & F.col("rel_path").startswith(prefix)).select("rel_path", "size")


def representations(mime: Column) -> Column:
    """The views that a file of a type can be shown in."""
    out = lambda p, *names: F.when(mime.rlike(p), F.array(*[F.lit(n) for n in names]))
    kinds = [out("^image/", "image", "metadata"), out("^audio/", "audio", "metadata"), out("^video/", "video", "metadata"), out("^text/|rfc822|json|xml", "text"), out("zip|x-tar|gzip", "archive")]
    return F.array_join(F.flatten(F.filter(F.array(*kinds), lambda k: k.isNotNull())), "|")

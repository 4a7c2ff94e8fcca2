"""Repositories and sync groups as snapshots: each edit gives the next one, and refuses what the rules forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("AddOnly", "ApplyChanges", "Mirror")


class Refused(ValueError):
    """An edit that the rules of the registry forbid."""


def _has(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).isEmpty()


def members(groups: DataFrame) -> DataFrame:
    """(name, repo, role): the main and the sinks of each group; a sink's role is its mode."""
    sinks = groups.select("name", F.explode("sinks").alias("s")).select("name", "s.repo", F.col("s.mode").alias("role"))
    return groups.select("name", F.col("main").alias("repo"), F.lit("main").alias("role")).unionByName(sinks)


def create_repo(repos: DataFrame, name: str, abs_path: str) -> DataFrame:
    """`repos` (repo, abs_path, remote, last_scan_ms) with one more, not scanned yet."""
    if not name.strip() or _has(repos, F.col("repo") == name):
        raise Refused(f"repository {name!r} exists or has no name")
    new = repos.sparkSession.range(1).select(F.lit(name).alias("repo"), F.lit(abs_path).alias("abs_path"), F.lit(False).alias("remote"), F.lit(0).cast("long").alias("last_scan_ms"))
    return repos.unionByName(new)


def rename_repo(repos: DataFrame, groups: DataFrame, old: str, new: str) -> DataFrame:
    """A repository in a group keeps its name, and no two have one."""
    _free(groups, old)
    if not _has(repos, F.col("repo") == old) or _has(repos, F.col("repo") == new):
        raise Refused(f"no repository {old!r}, or {new!r} exists")
    return repos.withColumn("repo", F.when(F.col("repo") == old, new).otherwise(F.col("repo")))


def remove_repo(repos: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    _free(groups, name)
    if not _has(repos, F.col("repo") == name):
        raise Refused(f"no repository {name!r}")
    return repos.where(F.col("repo") != name)


def relocate_repo(repos: DataFrame, name: str, abs_path: str, remote: bool | None = None) -> DataFrame:
    """Another root, and with `remote` another flag; the catalogue stays as it is."""
    own = F.col("repo") == name
    if not _has(repos, own):
        raise Refused(f"no repository {name!r}")
    out = repos.withColumn("abs_path", F.when(own, abs_path).otherwise(F.col("abs_path")))
    return out if remote is None else out.withColumn("remote", F.when(own, F.lit(remote)).otherwise(F.col("remote")))


def _free(groups: DataFrame, repo: str) -> None:
    if _has(members(groups), F.col("repo") == repo):
        raise Refused(f"{repo!r} is in a group")


def _group(groups: DataFrame, name: str) -> Column:
    if not _has(groups, F.col("name") == name):
        raise Refused(f"no group {name!r}")
    return F.col("name") == name


def create_group(groups: DataFrame, name: str, main: str) -> DataFrame:
    """A group of its main alone; a repository is in one group at most."""
    if _has(groups, F.col("name") == name):
        raise Refused(f"group {name!r} exists")
    _free(groups, main)
    none = F.array().cast("array<struct<repo: string, mode: string>>")
    return groups.unionByName(groups.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(main).alias("main"), none.alias("sinks")))


def delete_group(groups: DataFrame, name: str) -> DataFrame:
    return groups.where(~_group(groups, name))


def add_sink(groups: DataFrame, name: str, repo: str, mode: str) -> DataFrame:
    own = _group(groups, name)
    _free(groups, repo)
    if mode not in MODES:
        raise Refused(f"no mode {mode!r}")
    sink = F.struct(F.lit(repo).alias("repo"), F.lit(mode).alias("mode"))
    return groups.withColumn("sinks", F.when(own, F.array_append("sinks", sink)).otherwise(F.col("sinks")))


def _sink(groups: DataFrame, name: str, repo: str) -> Column:
    own = _group(groups, name)
    if not _has(groups, own & F.exists("sinks", lambda s: s["repo"] == repo)):
        raise Refused(f"{repo!r} is no sink of {name!r}")
    return own


def remove_sink(groups: DataFrame, name: str, repo: str) -> DataFrame:
    own = _sink(groups, name, repo)
    return groups.withColumn("sinks", F.when(own, F.filter("sinks", lambda s: s["repo"] != repo)).otherwise(F.col("sinks")))


def set_mode(groups: DataFrame, name: str, repo: str, mode: str) -> DataFrame:
    own = _sink(groups, name, repo)
    if mode not in MODES:
        raise Refused(f"no mode {mode!r}")
    changed = F.transform("sinks", lambda s: F.struct(s["repo"].alias("repo"), F.when(s["repo"] == repo, mode).otherwise(s["mode"]).alias("mode")))
    return groups.withColumn("sinks", F.when(own, changed).otherwise(F.col("sinks")))


def set_main(groups: DataFrame, name: str, repo: str) -> DataFrame:
    """A sink becomes the main, and the old main a sink that only gets additions."""
    own = _sink(groups, name, repo)
    rest = F.array_append(F.filter("sinks", lambda s: s["repo"] != repo), F.struct(F.col("main").alias("repo"), F.lit("AddOnly").alias("mode")))
    return groups.select("name", F.when(own, repo).otherwise(F.col("main")).alias("main"), F.when(own, rest).otherwise(F.col("sinks")).alias("sinks"))


def events(before: DataFrame, after: DataFrame, what: str) -> DataFrame:
    """Rows (what, change, detail as JSON) for a log: what is in one of two snapshots and not in the other."""
    rows = lambda a, b, change: a.exceptAll(b).select(F.lit(what).alias("what"), F.lit(change).alias("change"), F.to_json(F.struct(*a.columns)).alias("detail"))
    return rows(before, after, "gone").unionByName(rows(after, before, "new"))

"""Old entries, archives under a budget, walks as a data source, and the event log."""

import gzip
import hashlib
import io
import json
import os
import tarfile
import time
import zipfile

import pytest

from twinspark.operators import archives, records
from twinspark.sources import walk
from twinspark.streaming import updates


def sha(data):
    return hashlib.sha256(data).hexdigest()


def zipped(members, mode=zipfile.ZIP_DEFLATED):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", mode) as z:
        for name, data in members:
            z.writestr(name, data)
    return blob.getvalue()


def tarred(members, mode="w:gz"):
    blob = io.BytesIO()
    with tarfile.open(fileobj=blob, mode=mode) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return blob.getvalue()


def listed(spark, blobs, *limits):
    rows = archives.listings(spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in blobs.items()], "path string, content binary"), *limits).collect()
    out = {p: ([], None) for p in blobs}
    for r in rows:
        if r["last"]:
            out[r["path"]] = (out[r["path"]][0], (r["member_ord"], r["size"], r["capped"]))
        else:
            out[r["path"]][0].append((r["member_ord"], r["member_name"], r["size"], r["hash"], r["locked"]))
    return {p: (sorted(m), end) for p, (m, end) in out.items()}


def test_limits_of_archives(spark):
    ten = [(n, b"0" * 10) for n in "abc"]
    blobs = {"z": zipped(ten), "t": tarred(ten, "w"), "g": tarred(ten)}
    whole = [(k, n, 10, sha(b"0" * 10), False) for k, n in enumerate("abc")]
    for limits, kept, capped in (((100, 0, 30), 3, None), ((3, 0, 1024), 3, None), ((2, 0, 1024), 2, "members"), ((100, 0, 15), 1, "unpacked"), ((0, 0, 99), 0, "members"), ((100, 0, 9), 0, "unpacked")):
        assert listed(spark, blobs, *limits) == {p: (whole[:kept], (kept, 10 * kept, capped)) for p in blobs}
    # A bomb: what unpacks to more than a thousand times its size stops there.
    bomb = zipped([("small", b"x"), ("bomb", b"0" * 3_000_000), ("after", b"y")])
    assert len(bomb) < 4000
    members, end = listed(spark, {"b": bomb}, 100, 100, 1)["b"]
    assert [m[1] for m in members] == ["small"] and end[2] == "unpacked"
    assert [m[1] for m in listed(spark, {"b": bomb})["b"][0]] == ["small", "bomb", "after"]


def test_locked_broken_and_empty_archives(spark):
    locked = bytearray(zipped([("open", b"12345"), ("closed", b"secret")], zipfile.ZIP_STORED))
    at = locked.rindex(b"PK\x01\x02")
    locked[at + 8] |= 1  # the flag in the directory
    broken = bytearray(zipped([("good", b"fine"), ("bad", b"0123456789" * 50)], zipfile.ZIP_STORED))
    broken[broken.index(b"0123456789")] ^= 1
    cut = tarred([("a", os.urandom(5000)), ("b", os.urandom(5000))])[:6000]
    got = listed(spark, {"locked": bytes(locked), "broken": bytes(broken), "cut": cut, "junk": b"no archive", "null": None, "empty": zipped([]), "gz": gzip.compress(b"no tar")})
    assert got["locked"] == ([(0, "open", 5, sha(b"12345"), False), (1, "closed", 6, None, True)], (2, 11, None))
    assert got["broken"] == ([(0, "good", 4, sha(b"fine"), False)], (1, 4, None))
    assert [m[1] for m in got["cut"][0]] == ["a"] and got["cut"][1][2] == "unreadable"
    assert got["junk"] == got["null"] == got["gz"] == ([], (0, 0, "unreadable"))
    assert got["empty"] == ([], (0, 0, None))


ENTRY = {"size": 5, "hash": "h", "modified_ms": 7, "missing": False, "mime": "audio/mpeg", "img_size": [3, 4], "audio": {"duration_ms": 9, "chunk_hashes": ["x"]}}


def migrated(spark, *rows):
    return records.migrated(spark.createDataFrame([(f"p{k}", v, b) for k, (v, b) in enumerate(rows)], "rel_path string, version int, body string")).orderBy("rel_path").collect()


def test_every_version_reads_as_the_newest(spark):
    rows = []
    for v in range(1, 11):
        body = dict(ENTRY, img_fingerprint=5 if v == 1 else [1, 2], video_hash=[1, 2, 3] if v < 8 else [[1], [2], [3]])
        body["audio"] = {"duration_ms": 9, "chunk_hashes": ["x"]} if v < 10 else {"duration_ms": 9, "fingerprint": [6]}
        if v >= 3:
            body["origin"] = "r1"
        if v >= 4:
            body["exif"] = {"taken_ms": 11, "camera": None}
        rows.append((v, json.dumps(body)))
    for r in sorted(migrated(spark, *rows), key=lambda r: r["version"]):
        v = r["version"]
        assert r["error"] is None and (r["size"], r["hash"], r["img_w"], r["img_h"], r["duration_ms"]) == (5, "h", 3, 4, 9)
        assert r["img_words"] == (None if v < 2 else [1, 2]) and r["frame_words"] == (None if v < 8 else [[1], [2], [3]])
        assert r["audio_words"] == ([] if v < 10 else [6]) and r["stale"] == (v < 10)
        assert (r["origin"], r["taken_ms"], r["camera"]) == ("r1" if v >= 3 else None, 11 if v >= 4 else None, None)


def test_entries_that_cannot_be_read(spark):
    good = json.dumps(ENTRY)
    got = migrated(spark, (0, good), (11, good), (None, good), (3, None), (3, "{"), (3, "[1]"), (3, '{"size": "many"}'), (2, "{}"))
    assert [r["error"] for r in got] == ["version 0", "version 11", "version missing", "no entry", "no entry", "no entry", "field size", None]
    assert all(r["size"] is None and r["stale"] is None for r in got[:7]) and got[7]["stale"] is False
    assert migrated(spark, *[]) == []


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_walks_as_batch_and_stream(spark, tmp_path, levels):
    spark.dataSource.register(walk.Walk)
    root = tmp_path / "root"
    for name in ("a.txt", "d/b.txt", "d/e/c c.txt", "d/e/f/deep", "odd\\name"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    os.utime(root / "a.txt", (1, 1))  # old content, new entry
    os.symlink(root / "d", root / "link")
    os.symlink(root, root / "d" / "loop")
    time.sleep(0.05)
    batch = spark.read.format("walk").option("levels", levels).load(str(root))
    want = {(n, len(n)) for n in ("a.txt", "d/b.txt", "d/e/c c.txt", "d/e/f/deep", "odd\\name")}
    rows = batch.collect()
    assert {(r["rel_path"], r["size"]) for r in rows} == want and len(rows) == 5
    assert {r["modified_ms"] for r in rows if r["rel_path"] == "a.txt"} == {1000}

    def stream():
        query = spark.readStream.format("walk").option("levels", levels).load(str(root)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return sorted((r["rel_path"], r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert stream() == sorted(want)
    (root / "d/new.txt").write_bytes(b"12")
    time.sleep(0.05)
    assert stream() == sorted([*want, ("d/new.txt", 2)])  # only what came since


def test_unreadable_directories_are_told(tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "f").write_bytes(b"1")
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(13, "Permission denied")) if str(p).endswith("/d") else real(p))
    rows = sorted(walk._walked(str(tmp_path), walk.Directory("", True)), key=str)
    assert [(r[0], r[1], r[4]) for r in rows] == [("d", None, "Permission denied"), ("f", 1, None)]


def test_replayed_batches_add_no_line(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = spark.createDataFrame([("new", "a"), ("gone", "b")], "change string, detail string")
    updates.append_batch(batch, 0, log)
    updates.append_batch(batch.where("change = 'new'"), 1, log)
    updates.append_batch(batch, 0, log)
    assert sorted((r["batch"], r["change"]) for r in updates.read_log(spark, log).collect()) == [(0, "gone"), (0, "new"), (1, "new")]


def test_log_of_a_stream_over_restarts(spark, tmp_path):
    source, log, at = (str(tmp_path / x) for x in ("events", "log", "at"))
    for k in range(3):
        spark.createDataFrame([(k, f"e{k}")], "id long, detail string").coalesce(1).write.mode("append").parquet(source)
        updates.log_events(spark.readStream.schema("id long, detail string").parquet(source), log, at).awaitTermination(60)
        assert sorted(r["id"] for r in updates.read_log(spark, log).collect()) == list(range(k + 1))
    # The batch was written, but the stream died before it noted so: it comes again.
    last = max((tmp_path / "at" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(last)
    os.remove(last.with_name(f".{last.name}.crc"))
    updates.log_events(spark.readStream.schema("id long, detail string").parquet(source), log, at).awaitTermination(60)
    assert sorted(r["id"] for r in updates.read_log(spark, log).collect()) == [0, 1, 2]


def test_limits_of_micro_batches_and_repeated_arrivals(spark, tmp_path):
    kind = "repo string, rel_path string, size long, hash string, ts timestamp"
    rows = [("r0", f"f{k}", k % 2, f"h{k % 2}", None) for k in range(6)]
    for r in rows:
        spark.createDataFrame([r], kind).selectExpr("repo", "rel_path", "size", "hash", "timestamp'2024-01-01' AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "walks"))
    sizes = []
    query = updates.read_walks(spark, str(tmp_path / "walks"), kind, 2).writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sizes == [2, 2, 2]
    query = updates.first_arrivals(updates.read_walks(spark, str(tmp_path / "walks"), kind, 2)).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["hash"] for r in spark.table("arrivals").collect()) == ["h0", "h1"]
    left = updates.time_left(spark.createDataFrame([(10.0, 100, 50), (0.0, 100, 50), (0.0, 100, 100), (5.0, 10, 20)], "rate double, total long, done long"))
    assert [r["seconds_left"] for r in left.collect()] == [5.0, None, 0.0, 0.0]

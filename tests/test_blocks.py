"""Pairs that are made where blocks of rows meet, against all with all, and not shuffled afterwards."""

import random
from collections import Counter

import pytest

from twinspark.operators import similar, sounds


def above_pairs(frame):
    """The plan above what makes the pairs."""
    return frame._jdf.queryExecution().executedPlan().toString().partition("Generate")[0]


@pytest.mark.parametrize(("sizes", "reach"), [((1, 1), 1), ((3, 5), 2), ((1024, 4096), 32)])
def test_interval_pairs_of_blocks(spark, monkeypatch, sizes, reach):
    monkeypatch.setattr(similar, "BLOCK_ROWS", sizes, raising=False)
    monkeypatch.setattr(similar, "REACH", reach, raising=False)
    monkeypatch.setattr(similar, "TASK_PAIRS", 50, raising=False)
    rng = random.Random(sizes[0])
    rows = [(k * 7 % 60, rng.choice([0, 3, 3, 5, 9, 14, 15, 40, None])) for k in range(60)]
    pairs = similar.interval_pairs(spark.createDataFrame(rows, "id long, ms long"), 5)
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and None not in (x, y) and abs(x - y) <= 5)
    assert sorted(map(tuple, pairs.collect())) == want
    above = above_pairs(pairs)
    assert above and "Exchange" not in above and "Join" not in above


def loud(rows):
    """Pairs of sounds that share a key within two seconds: the offset with most votes and the similarity there."""
    out = {}
    known = sorted((ms, k, p) for k, ms, p in rows if ms is not None and p)
    places = [{w >> 16: len(p) - 1 - at for at, w in enumerate(reversed(p)) if w is not None} for _, _, p in known]
    for n, (ms, x, p) in enumerate(known):
        for m in range(n + 1, len(known)):
            other, y, q = known[m]
            votes = Counter(places[n][key] - places[m][key] for key in places[n].keys() & places[m].keys())
            if other - ms <= 2000 and votes:
                d = max(votes, key=lambda o: (votes[o], -abs(o), -o))
                wrong = [(a ^ b).bit_count() for a, b in zip(p[max(d, 0) :], q[max(-d, 0) :], strict=False) if None not in (a, b)]
                like = [w for w in wrong if w < 16]
                covers = like and len(like) >= 0.8 * min(len(p), len(q))
                out[x, y] = (d, (1 - sum(like) / len(like) / 32) * 100 if covers else 0.0)
    return out


@pytest.mark.parametrize(("sizes", "held", "votes"), [((3, 5), 1 << 22, 7), ((256, 4096), 1 << 22, 1 << 20), ((256, 4096), 70, 1)])
def test_sound_pairs_of_blocks(spark, monkeypatch, sizes, held, votes):
    for name, value in {"BLOCK_ROWS": sizes, "REACH": 2, "HELD_WORDS": held, "STEP_VOTES": votes, "STEP_PAIRS": 3, "OUT_PAIRS": 4}.items():
        monkeypatch.setattr(sounds, name, value, raising=False)
    rng = random.Random(5)
    words = [rng.getrandbits(32) for _ in range(12)]
    rows = [(k, rng.choice([0, 900, 2000, 2900, 5000, None]), [rng.choice([*words, None]) for _ in range(rng.randrange(20))]) for k in range(40)]
    rows += [(k, 0, words) for k in range(50, 56)] + [(60, 1000, [None, None])]
    found = sounds.sound_pairs(spark.createDataFrame(rows, "id long, ms long, print array<long>"))
    assert {(r["x"], r["y"]): (r["offset"], round(r["similarity"], 9)) for r in found.collect()} == {k: (d, round(v, 9)) for k, (d, v) in loud(rows).items()}
    plan = found._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
    assert plan[1] and "Exchange" not in plan[0] and "Join" not in plan[0]


@pytest.mark.parametrize(("dense", "blocks", "radius"), [(1 << 30, 1, 0), (1 << 30, 7, 1), (0, 7, 0), (0, 7, 1)])
def test_hashes_of_blocks(spark, monkeypatch, dense, blocks, radius):
    """Hashes whose bands have few values, some equal, short, null or with a null band."""
    for name, value in {"DENSE": dense, "DEALT": dense, "BLOCKS": blocks, "LEAST_ROWS": 3, "STEP_ROWS": 4, "STEP_COLUMNS": 5}.items():
        monkeypatch.setattr(similar, name, value, raising=False)
    rng = random.Random(6)
    rows = [[rng.choice([0, 1, 3, 7, 65535]) for _ in range(8)] for _ in range(40)]
    rows += [rows[0], rows[0], rows[1][:7], [], [None, *rows[2][1:]], None]
    want = {}
    for k, x in enumerate(rows):
        for m in range(k + 1, len(rows)):
            y = rows[m]
            if x and y and len(x) == len(y) and None not in (*x, *y):
                likeness = (1 - sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) / 128) * 100
                if likeness >= 70 and any((a ^ b).bit_count() <= radius for a, b in zip(x, y, strict=True)):
                    want[k, m] = likeness
    hashes = spark.createDataFrame(list(enumerate(rows)), "vec_id long, bands array<long>").repartition(3)
    pairs = similar.banded_pairs(hashes, 128, 70.0, radius=radius)
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, v) for (a, b), v in want.items()) and len(want) > 10
    if dense:
        above = similar.head_pairs(similar.heads(hashes), 128, 70.0, radius)._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
        assert above[1] and "Exchange" not in above[0] and "Join" not in above[0]


def test_videos_are_compared_without_a_join(spark):
    """Bands of 16 bits that may differ in one would be dealt to 17 values each."""
    rng = random.Random(7)
    rows = [[rng.getrandbits(16) for _ in range(96)] for _ in range(10)]
    rows += [[w ^ 1 for w in rows[3]], [w ^ (1 << rng.randrange(16)) if k else w ^ 2047 for k, w in enumerate(rows[4])]]
    hashes = spark.createDataFrame(list(enumerate(rows)), "rep long, bands array<long>")
    pairs = similar.head_pairs(hashes, 1536, 93.0, similar.sure_radius(1536, 93.0))
    assert [tuple(r)[:2] for r in sorted(pairs.collect())] == [(3, 10), (4, 11)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan

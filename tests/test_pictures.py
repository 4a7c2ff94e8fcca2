"""Hashes of pictures against plain loops over pixels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinspark.functions import pictures


def plain_grid(picture, side):
    """Each cell as the mean of the pixels under its tent, one cell at a time."""
    height, width = len(picture), len(picture[0])

    def tent(size, cell):
        step = size / side
        centre, reach = (cell + 0.5) * step, max(step, 1.0)
        weights = [max(0.0, 1 - abs(k + 0.5 - centre) / reach) for k in range(size)]
        return [w / sum(weights) for w in weights]

    rows, columns = [tent(height, c) for c in range(side)], [tent(width, c) for c in range(side)]
    return [[int(round(sum(picture[y][x] * r[y] * c[x] for y in range(height) if r[y] for x in range(width) if c[x]), 6) + 0.5) for c in columns] for r in rows]


def plain_turn(g):
    n = len(g)
    across = lambda g: sum(v * (x - n // 2) for row in g for x, v in enumerate(row))
    down = lambda g: sum(v * (y - n // 2) for y, row in enumerate(g) for v in row)
    if across(g) > 0:
        g = [row[::-1] for row in g]
    if down(g) > 0:
        g = g[::-1]
    return [list(c) for c in zip(*g, strict=True)] if across(g) > down(g) else g


def plain_bits(g, down):
    n = len(g)
    out = [g[y][x] > g[y][x + 1] for y in range(n - 1) for x in range(n - 1)]
    return out + ([g[y][x] > g[y + 1][x] for y in range(n - 1) for x in range(n - 1)] if down else [])


def turns(g):
    out = []
    for m in (g, [list(c) for c in zip(*g, strict=True)]):
        for _ in range(4):
            out.append(m)
            m = [list(r) for r in zip(*m[::-1], strict=True)]
    return out


def words(bits):
    return [int.from_bytes(sum(1 << k for k, b in enumerate(bits[at : at + 64]) if b).to_bytes(8, "little"), "little", signed=True) for at in range(0, len(bits), 64)]


def some(rng, width, height):
    return [[rng.randrange(256) for _ in range(width)] for _ in range(height)]


def frame(spark, made):
    return spark.createDataFrame([(k, len(p[0]), len(p), [v for row in p for v in row]) for k, p in enumerate(made)], "id long, w int, h int, p array<int>")


def test_hashes_as_plain(spark):
    rng = random.Random(1)
    made = [some(rng, w, h) for w, h in ((17, 17), (34, 34), (9, 9), (5, 40), (100, 31), (1, 1), (18, 16), (64, 48)) for _ in range(3)]
    made += [[[7] * 20] * 20, [[x * 4 for x in range(40)] for _ in range(30)]]
    out = frame(spark, made).select("id", pictures.picture_hash(F.col("p"), F.col("w"), F.col("h")).alias("words"), pictures.frame_hash(F.col("p"), F.col("w"), F.col("h")).alias("dhash")).collect()
    for r in out:
        assert list(r["words"]) == words(plain_bits(plain_turn(plain_grid(made[r["id"]], 17)), True))
        assert [r["dhash"]] == words(plain_bits(max(turns(plain_grid(made[r["id"]], 9))), False))


def test_turned_pictures_have_one_hash(spark):
    rng = random.Random(2)
    for side, hashed in ((51, pictures.picture_hash), (27, pictures.frame_hash)):
        made = [t for _ in range(6) for t in turns(some(rng, side, side))]
        rows = frame(spark, made).select("id", hashed(F.col("p"), F.col("w"), F.col("h")).alias("hash")).collect()
        of = {}
        for r in rows:
            of.setdefault(r["id"] // 8, set()).add(str(r["hash"]))
        assert [len(x) for x in of.values()] == [1] * 6 and len(set.union(*of.values())) == 6


def test_bad_pictures_have_no_hash(spark):
    rows = [(0, 2, 2, [1, 2, 3]), (1, 2, 2, [1, None, 3, 4]), (2, 2, 2, None), (3, None, 2, [1, 2]), (4, 0, 0, []), (5, -1, -1, [3]), (6, 2, 1, [300, -5]), (7, 2, 1, [255, 0])]
    frame = spark.createDataFrame(rows, "id long, w int, h int, p array<int>").repartition(1)
    got = {r["id"]: r["words"] for r in frame.select("id", pictures.picture_hash(F.col("p"), F.col("w"), F.col("h")).alias("words")).collect()}
    assert [k for k, v in sorted(got.items()) if v is None] == [0, 1, 2, 3, 4, 5] and got[6] == got[7]


def test_bands_and_brightness(spark):
    row = spark.createDataFrame([([-1, 0x0123456789ABCDEF], 255, 128, 0)], "words array<long>, r int, g int, b int")
    got = row.select(pictures.bands(F.col("words")).alias("bands"), pictures.brightness(F.col("r"), F.col("g"), F.col("b")).alias("y")).first()
    assert got["bands"] == [0xFFFF] * 4 + [0xCDEF, 0x89AB, 0x4567, 0x0123]
    assert got["y"] == (2126 * 255 + 7152 * 128) // 10000


@pytest.mark.parametrize("size", [1, 3, 16, 17, 35, 400])
def test_shares_make_up_every_cell(size):
    assert np.allclose(pictures.shares(size, 17).sum(axis=1), 1)
    assert pictures._hashed(pa.array([], pa.list_(pa.int32())), pa.array([], pa.int32()), pa.array([], pa.int32()), 17, pictures.by_moments, True).to_pylist() == []

"""The banded search against comparing all with all."""

import random

import pytest

from twinspark.operators import similar


def prints(rng, n, size):
    """Random hashes of `size` bands, some of them copies with a few bits turned."""
    out = [[rng.randrange(1 << 16) for _ in range(size)] for _ in range(n)]
    for _ in range(n):
        twin = list(rng.choice(out))
        for _ in range(rng.randrange(size * 3)):
            twin[rng.randrange(size)] ^= 1 << rng.randrange(16)
        out.append(twin)
    return out


def wrong(x, y):
    return sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))


def all_pairs(rows, bits, threshold, radius):
    out = {}
    for k, x in enumerate(rows):
        for m in range(k + 1, len(rows)):
            likeness = (1 - wrong(x, rows[m]) / bits) * 100
            if likeness >= threshold and any((a ^ b).bit_count() <= radius for a, b in zip(x, rows[m], strict=True)):
                out[k, m] = likeness
    return out


@pytest.mark.parametrize(("size", "threshold", "radius"), [(4, 70.0, 0), (4, 80.0, 1), (32, 90.0, 0), (32, 75.0, 0), (32, 90.0, 1), (6, 75.0, 0)])
def test_pairs_are_those_of_all_with_all(spark, size, threshold, radius):
    rows = prints(random.Random(size + radius), 40, size)
    rows += [rows[0], [0] * size, [65535] * size]
    hashes = spark.createDataFrame(list(enumerate(rows)), "vec_id long, bands array<long>")
    got = {(r["a"], r["b"]): r["similarity"] for r in similar.banded_pairs(hashes, size * 16, threshold, radius=radius).collect()}
    want = all_pairs(rows, size * 16, threshold, radius)
    assert got == want and len(want) > 10


def test_hashes_that_pair_with_nothing(spark):
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, None]), (3, [1, 2, 3]), (4, []), (5, None), (6, [1, 2, 3, 5]), (7, [1, 2, 3, 5])]
    hashes = spark.createDataFrame(rows, "vec_id long, bands array<long>")
    assert {(r["a"], r["b"]) for r in similar.banded_pairs(hashes, 64, 75.0).collect()} == {(1, 6), (1, 7), (6, 7)}
    assert similar.banded_pairs(hashes.limit(0), 64, 75.0).collect() == [] == similar.similar_groups(hashes.where("vec_id < 4"), 64, 75.0).collect()


@pytest.mark.parametrize("bands", [[1 << 16, 0, 0, 0], [-1, 0, 0, 0], [0] * 5])
def test_bands_that_are_too_wide_or_too_many_raise(spark, bands):
    with pytest.raises(Exception, match="bands have 16 bits"):
        similar.banded_pairs(spark.createDataFrame([(1, bands), (2, [0, 0, 0, 0])], "vec_id long, bands array<long>"), 64, 75.0).collect()

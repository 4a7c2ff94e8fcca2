"""Hashes of pictures from their pixels, that no turn or mirroring changes: many pictures at a time, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides of the grids under the hash of a picture and under that of a video's frame.
PICTURE_SIDE, FRAME_SIDE = 17, 9
#: What red, green and blue weigh in brightness, in ten-thousandths.
LUMA = (2126, 7152, 722)


def brightness(red: Column, green: Column, blue: Column) -> Column:
    return F.floor((red * LUMA[0] + green * LUMA[1] + blue * LUMA[2]) / sum(LUMA)).cast("int")


def shares(size: int, side: int) -> np.ndarray:
    """How much each of `size` pixels gives to each of `side` cells: tents over the cells' centres, as wide as a cell or a pixel."""
    step = size / side
    reach = max(step, 1.0)
    away = np.abs((np.arange(side)[:, None] + 0.5) * step - 0.5 - np.arange(size)[None, :]) / reach
    out = np.maximum(1 - away, 0)
    return out / out.sum(axis=1, keepdims=True)


def grids(pixels: np.ndarray, side: int) -> np.ndarray:
    """Pictures (count, height, width) as grids of `side` x `side` whole values of brightness."""
    _, height, width = pixels.shape
    cells = shares(height, side) @ np.clip(pixels, 0, 255) @ shares(width, side).T
    return np.floor(np.clip(cells, 0, 255).round(6) + 0.5).astype(np.int64)  # the order of sums shall not decide halves


def by_moments(cells: np.ndarray) -> np.ndarray:
    """Each grid turned so that it is brighter on the left and at the top, and more so on the left.

    A small change of brightness seldom changes the turn, and where it does the grid is nearly the
    same either way.
    """
    away = np.arange(cells.shape[1]) - cells.shape[1] // 2

    def turned(those: np.ndarray, now: np.ndarray) -> np.ndarray:
        return np.where(those[:, None, None], now, cells)

    cells = turned((cells.sum(axis=1) @ away) > 0, cells[:, :, ::-1])
    cells = turned((cells.sum(axis=2) @ away) > 0, cells[:, ::-1, :])
    return turned((cells.sum(axis=1) @ away) > (cells.sum(axis=2) @ away), cells.transpose(0, 2, 1))


def by_order(cells: np.ndarray) -> np.ndarray:
    """Of each grid's eight turns and mirrorings the one whose values, read row by row, are the greatest."""
    best = cells
    for mirrored in (cells, cells.transpose(0, 2, 1)):
        for turns in range(4):
            now = np.rot90(mirrored, turns, axes=(1, 2))
            differ = (now != best).reshape(len(cells), -1)
            first = differ.argmax(axis=1)
            rows = np.arange(len(cells))
            more = now.reshape(len(cells), -1)[rows, first] > best.reshape(len(cells), -1)[rows, first]
            best = np.where(more[:, None, None], now, best)
    return best


def falls(cells: np.ndarray, down: bool = True) -> np.ndarray:
    """Bits where a cell is brighter than the one to its right, then, if wanted, than the one below; as words of 64, lowest bit first."""
    bits = [(cells[:, :-1, :-1] > cells[:, :-1, 1:]).reshape(len(cells), -1)]
    if down:
        bits.append((cells[:, :-1, :-1] > cells[:, 1:, :-1]).reshape(len(cells), -1))
    packed = np.packbits(np.concatenate(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<i8")


def _hashed(pixels: pa.Array, width: pa.Array, height: pa.Array, side: int, turn, down: bool) -> pa.Array:
    """Words of each picture; null where a picture, a size or a pixel is missing, or the pixels are not width times height."""
    pixels, (w, h) = pixels.cast(pa.list_(pa.int64())), (x.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False) for x in (width, height))
    count = pixels.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    offsets, values = pixels.offsets.to_numpy(), pixels.values
    holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    values = values.fill_null(0).to_numpy(zero_copy_only=False)
    good = (w > 0) & (h > 0) & (count == w * h) & (holes[offsets[1:]] == holes[offsets[:-1]])
    out: list = [None] * len(count)
    for a, b in set(zip(w[good].tolist(), h[good].tolist(), strict=True)):  # pictures of one size together
        of_size = np.flatnonzero(good & (w == a) & (h == b))
        for some in np.array_split(of_size, -(-len(of_size) * a * b // (1 << 20))):
            at = offsets[some][:, None] + np.arange(a * b)
            for k, words in zip(some.tolist(), falls(turn(grids(values[at].reshape(len(some), b, a), side)), down).tolist(), strict=True):
                out[k] = words
    return pa.array(out, pa.list_(pa.int64()))


def picture_hash(pixels: Column, width: Column, height: Column) -> Column:
    """512 bits, as eight words, of a picture's pixels (brightness, row by row): neighbours compared on a grid turned by its moments."""
    return F.arrow_udf(lambda p, w, h: _hashed(p, w, h, PICTURE_SIDE, by_moments, True), "array<long>")(pixels, width, height)


def frame_hash(pixels: Column, width: Column, height: Column) -> Column:
    """64 bits, as one word, of a frame: cells compared with their right neighbours on a grid in its greatest turn."""
    words = F.arrow_udf(lambda p, w, h: _hashed(p, w, h, FRAME_SIDE, by_order, False), "array<long>")(pixels, width, height)
    return F.try_element_at(words, F.lit(1))


def bands(words: Column) -> Column:
    """Words of 64 bits as bands of 16, lowest bits first."""
    four = F.transform(words, lambda w: F.transform(F.array(*[F.lit(k) for k in (0, 16, 32, 48)]), lambda k: F.call_function("shiftrightunsigned", w, k).bitwiseAND(F.lit(0xFFFF).cast("long"))))
    return F.flatten(four)

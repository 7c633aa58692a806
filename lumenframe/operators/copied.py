"""Copied blocks of a picture: overlapping blocks with the same coarse spectrum, at a distance that many pairs share.

Each square block's two-dimensional cosine transform is cut to its lowest frequencies, divided by a quality and rounded to
bytes. The byte vectors are put in one global order, as signed bytes; equal neighbours in it are a pair, and a pair counts
if the shift between its blocks, longer than a block, occurs often enough.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import beside, positions

TILE = 64  # blocks along a tile's side; a task holds one tile and the pixels that its last blocks reach


def cosines(size: int, keep: int) -> np.ndarray:
    """The first ``keep`` rows of the orthonormal cosine transform of ``size`` values."""
    k, i = np.arange(keep)[:, None], np.arange(size)
    return np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size)) * np.cos(np.pi * k * (2 * i + 1) / (2 * size))


def _spectra(size: int, keep: int, quality: float) -> Callable:
    def run(key: tuple, px: pd.DataFrame) -> pd.DataFrame:
        left, top = int(key[0]) * TILE, int(key[1]) * TILE
        side = TILE + size - 1
        grey, there = np.zeros((side, side)), np.zeros((side, side))
        grey[px["y"] - top, px["x"] - left] = px["grey"]
        there[px["y"] - top, px["x"] - left] = 1
        view = np.lib.stride_tricks.sliding_window_view
        full = view(there, (size, size)).sum(axis=(2, 3)) == size * size
        y, x = np.nonzero(full)
        c = cosines(size, keep)
        d = np.einsum("ui,bij,vj->buv", c, view(grey, (size, size))[y, x], c) / quality
        made = np.clip(np.rint(np.round(d, 6)), 0, 255).astype(np.uint8).reshape(len(y), keep * keep)
        return pd.DataFrame({"x": x + left, "y": y + top, "spectrum": [m.tobytes() for m in made]})

    return run


def block_spectra(pixels: DataFrame, size: int, keep: int, quality: float) -> DataFrame:
    """(x, y, spectrum): the low frequencies, as bytes row by row, of each block of ``size`` pixels a side that is wholly there."""
    grey = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b") + 500) / 1000)
    tiles = lambda c: F.sequence(F.floor(F.greatest(F.col(c) - (size - 1), F.lit(0)) / TILE), F.floor(F.col(c) / TILE))  # noqa: E731  those whose blocks reach the pixel
    dealt = pixels.select("x", "y", grey.alias("grey")).withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))
    return dealt.groupBy("tx", "ty").applyInPandas(_spectra(size, keep, quality), "x int, y int, spectrum binary")


def signed_bytes(data: str) -> Column:
    """The bytes as numbers from -128 to 127, in an array: its order is that of the vectors of signed bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("int")
    n = F.octet_length(data)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i))))


def block_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with pos, from 1: by spectrum as signed bytes, then row by row."""
    return positions(blocks, [], [signed_bytes("spectrum"), F.col("y"), F.col("x")])


def copied_blocks(blocks: DataFrame, size: int, more_than: int) -> DataFrame:
    """x, y, to_x, to_y, shift_x, shift_y, n: neighbours in the order that are equal, shifted further than a block, and whose shift n > ``more_than`` pairs have."""
    pairs = beside(blocks.withColumn("at", F.struct("x", "y")), ["spectrum"], [F.col("y"), F.col("x")], "at").where("after is not null")
    pairs = pairs.select("x", "y", F.col("after.x").alias("to_x"), F.col("after.y").alias("to_y"))
    pairs = pairs.withColumn("shift_x", F.abs(F.col("to_x") - F.col("x"))).withColumn("shift_y", F.abs(F.col("to_y") - F.col("y")))
    pairs = pairs.where(F.col("shift_x") * F.col("shift_x") + F.col("shift_y") * F.col("shift_y") > size * size)
    often = pairs.groupBy("shift_x", "shift_y").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return pairs.join(often, ["shift_x", "shift_y"]).select("x", "y", "to_x", "to_y", "shift_x", "shift_y", "n")

"""Rows that differ in formatting only, collapsed with their number of copies.

Rows get a canonical key; its 64-bit hash goes into two Bloom filters per partition, of hashes seen once and of hashes
seen again. Filters are merged pairwise: what two partitions both saw once, they saw again. Only rows that the merged
filter of repeats holds are shuffled for exact grouping on the whole key; the others have no copy and stay where they
are. A wrong positive costs one shuffled row and changes no result.

The filters have 16 bits a row. Where that is more than max_bits, hashes are cut into as many ranges as it takes, each written to
a folder of its own and filtered by itself, so that a filter never fills up and the driver never holds more than one of max_bits.
Filters travel compressed, so that a part that saw little costs little.

A null key part counts as empty. An empty table gives no rows. Ties: the smallest id leads its group. Columns of the
table besides the id and the key parts aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.session import Scratch, attach

BLOCK = 1 << 17  # bytes of a filter that travel together


def bits_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Three positions for each hash, by double hashing."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1) for i in range(3)]).astype(np.int64)


def contains(filled: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = bits_of(h, bits)
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def add(filled: np.ndarray, h: np.ndarray, bits: int) -> None:
    at = bits_of(h, bits).ravel()
    np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))


def repeats_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of hashes that may occur twice or more in the column h. Its size is bits / 8 bytes."""
    size = bits // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again, any_row = np.zeros(size, np.uint8), np.zeros(size, np.uint8), False
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            any_row = any_row or len(h) > 0
            add(again, h[(n > 1) | contains(once, h, bits)], bits)
            add(once, h, bits)
        if any_row:
            yield blocks(once, again)

    def blocks(once: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        k = [i for i in range(0, size, BLOCK) if once[i : i + BLOCK].any()]
        pack = lambda x: [zlib.compress(x[i : i + BLOCK].tobytes(), 1) for i in k]
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(pack(once), pa.binary()), pa.array(pack(again), pa.binary())], names=["block", "once", "again"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = again = None
        for b in batches:
            for x, y in zip(b.column("once"), b.column("again")):
                x, y = (np.frombuffer(zlib.decompress(v.as_py()), np.uint8) for v in (x, y))
                once, again = (x.copy(), y.copy()) if once is None else (once | x, again | y | (once & x))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], names=["block", "again"])

    parts = hashes.mapInArrow(build, "block bigint, once binary, again binary")
    merged = parts.groupBy("block").applyInArrow(merge, "block bigint, again binary")
    filled = np.zeros(size, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all
        filled[row["block"] : row["block"] + BLOCK] = np.frombuffer(zlib.decompress(bytes(row["again"])), np.uint8)
    return filled


def filter_bits(rows: int) -> int:
    return 1 << max(13, (16 * max(rows, 1) - 1).bit_length())


def split_by_repeats(keyed: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """keyed, with a column h, as the rows that may have a copy and those that have none, by a filter of so many bits."""
    shared = keyed.sparkSession.sparkContext.broadcast(repeats_filter(keyed.select("h"), bits))

    @F.pandas_udf("boolean")
    def may_repeat(h):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(contains(shared.value, h.to_numpy(), bits))

    flagged = keyed.withColumn("maybe", may_repeat("h"))
    return flagged.filter("maybe").drop("maybe"), flagged.filter("not maybe").drop("maybe")


def collapse(rows: DataFrame, row_id: str, key: list[Column], max_bits: int = 1 << 29) -> tuple[DataFrame, DataFrame]:
    """(groups, members): group_id and copies of every class of rows; group_id and row_id of every row that has copies.

    The keys are those of the canonical form; the hash of theirs only decides what is shuffled.
    """
    keep = Scratch(rows.sparkSession).keep
    names = [f"k{i}" for i in range(len(key))]
    keyed = keep(rows.select(F.col(row_id).alias("row"), *[F.coalesce(k, F.lit("")).alias(n) for k, n in zip(key, names)]).withColumn("h", F.xxhash64(*names)))
    n = keyed.count()
    ranges = -(-filter_bits(n) // max_bits)
    if ranges == 1:
        maybe, alone = split_by_repeats(keyed, filter_bits(n))
    else:
        part = F.pmod(F.shiftrightunsigned("h", 40), F.lit(ranges)).cast("int")
        keyed = keep(keyed.withColumn("range", part), "range")
        # by ranges of hashes; all copies of a row are in one
        halves = [split_by_repeats(keyed.filter(F.col("range") == i).drop("range"), max_bits) for i in range(ranges)]
        maybe, alone = (functools.reduce(DataFrame.unionByName, side) for side in zip(*halves))
    maybe = keep(maybe.drop("h"))
    groups = keep(maybe.groupBy(*names).agg(F.min("row").alias("group_id"), F.count(F.lit(1)).alias("copies")))
    all_groups = groups.select("group_id", "copies").unionByName(alone.select(F.col("row").alias("group_id"), F.lit(1).cast("bigint").alias("copies")))
    members = attach(maybe, groups.filter("copies > 1"), names, "copies").select("group_id", F.col("row").alias("row_id"))
    return all_groups, members

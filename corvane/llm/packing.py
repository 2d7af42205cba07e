"""Filling containers of a fixed capacity with whole items.

Each partition packs its items by best fit, the largest first, and emits the containers that are nearly full. What
is left, with its content, is an item of the next round on an eighth of the partitions, up to a single one, which emits
everything. No task ever holds more than `step` items at once: beyond that the fuller half of its underfull containers goes on
to the next round as it is. Items, which are narrow rows without their texts, are spread by hash before every round, so that each task sees
all sizes in their shares, whatever their order; a round that leaves 99 % of more than `step` items unmerged shows that the others won't fit together either, and ends the packing.
Every round is written to the shared folder.

Items larger than the capacity are cut into full containers and a rest. Items of size 0 take no space; like all others
they are in one container each, of at most `capacity` items. Null texts count as empty. An empty table gives no containers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.session import Scratch, cores, spread

TOKENIZER = os.environ.get("CORVANE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
STEP = 100_000
ITEM = pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("tokens", pa.int32())])
BINS = pa.schema([("done", pa.bool_()), ("size", pa.int32()), ("items", pa.list_(ITEM))])
BINS_SQL = "done boolean, size int, items array<struct<doc_id: bigint, part: int, tokens: int>>"


def token_counts(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of texts (doc_id, text), under a tokenizer file of the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            for i in range(0, len(texts), 256):
                n += [len(e) for e in t.encode_batch_fast([x or "" for x in texts[i : i + 256]], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(texts).mapInArrow(run, "doc_id bigint, tokens bigint")


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Containers of (size, contents), from items of the same form, the largest first into the fullest that has room."""
    room: dict[int, list[int]] = {}
    have = 0  # bit r is set if a container has r left
    sizes: list[int] = []
    held: list[list] = []
    for size, content in sorted(items, key=lambda x: (-x[0], x[1][0]["doc_id"], x[1][0]["part"])):
        fits = have >> size
        k = None
        while fits:
            left = size + (fits & -fits).bit_length() - 1
            k = room[left][-1]
            if len(held[k]) + len(content) <= capacity:
                room[left].pop()
                if not room[left]:
                    have &= ~(1 << left)
                break
            k, fits = None, fits & (fits - 1)
        if k is None:
            sizes.append(size)
            held.append(list(content))
            k = len(sizes) - 1
        else:
            sizes[k] += size
            held[k] += content
        left = capacity - sizes[k]
        room.setdefault(left, []).append(k)
        have |= 1 << left
    return list(zip(sizes, held))


def pack_round(bins: DataFrame, capacity: int, nearly: float, last: bool, step: int) -> DataFrame:
    def emit(packed: list[tuple[int, list]], done: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([done] * len(packed), pa.bool_()), pa.array([s for s, _ in packed], pa.int32()), pa.array([c for _, c in packed], pa.list_(ITEM))], schema=BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, list]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            packed = best_fit(waiting, capacity)
            full = [b for b in packed if b[0] >= nearly * capacity]
            waiting = [b for b in packed if b[0] < nearly * capacity]
            if full:
                yield emit(full, True)
            if len(waiting) > step // 2:  # these don't fit together: the fuller ones meet others in the next round
                waiting.sort(key=lambda b: b[0])
                yield emit(waiting[step // 4 :], last)
                waiting = waiting[: step // 4]

        for batch in batches:
            for size, content in zip(batch.column("size").to_pylist(), batch.column("items").to_pylist()):
                waiting.append((size, content))
                if len(waiting) >= step:
                    yield from settle()
        if waiting:
            yield from settle()
        if waiting:
            yield emit(waiting, last)

    return bins.select("size", "items").mapInArrow(run, BINS_SQL)


def pack(sizes: DataFrame, capacity: int, nearly: float = 0.995, fan_in: int = 8, step: int = STEP) -> DataFrame:
    """(container, doc_id, position, part, tokens) from sizes (doc_id, tokens); part counts the pieces of a cut item."""
    spark = sizes.sparkSession
    keep = Scratch(spark).keep
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = (F.col("tokens") % capacity).cast("int")
    size_of = lambda k: F.when(k < whole, F.lit(capacity)).otherwise(rest).cast("int")
    parts = F.sequence(F.lit(0), F.greatest(whole - F.when(rest == 0, 1).otherwise(0), F.lit(0)))
    long = sizes.select("doc_id", F.explode(F.transform(parts, lambda k: F.struct(k.cast("int").alias("part"), size_of(k).alias("tokens")))).alias("x"))
    items = long.select(F.col("x.tokens").alias("size"), F.array(F.struct("doc_id", "x.part", "x.tokens")).alias("items"))
    done = [items.filter(F.col("size") == capacity).select("items")]
    left, n = items.filter(F.col("size") < capacity), cores(spark)
    before = None
    while True:
        out = keep(pack_round(left.repartition(n, F.xxhash64("items")), capacity, nearly, n == 1 and before is not None, step))
        done.append(out.filter("done").select("items"))
        left = out.filter("not done")
        count = left.count()
        if not count:
            break
        if before is not None and count > 0.99 * before and count > step:
            done.append(left.select("items"))
            break
        before = count
        n = max(1, n // fan_in, -(-count // step))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    numbered = keep(every.select(F.monotonically_increasing_id().alias("container"), "items"))
    return numbered.select("container", F.posexplode("items").alias("position", "x")).select("container", "x.doc_id", "position", "x.part", "x.tokens")

"""Passages of evaluation items in documents.

Items are looked for at two sizes: in passages, which are windows of `words` words, or the whole item if it has fewer; and at
their own size, by the first and the last window of the longest class of lengths that fits the item (classes grow by half
from `words` on). Documents are cut into windows of every length that an item has.

Each window gets a 64-bit SimHash of its words. Fingerprints are cut into four blocks of 16 bits. Two fingerprints within
radius r differ in at most r // 4 bits in one block, so the index holds each block of an item's window with up to r // 4 bits flipped
and meets every fingerprint within the radius, each pair in the first such block only. Pairs within the radius are verified on
their five-word shingles, weighted by their counts. Windows that are alike in this sense have more than a passage's words in a row in
common, so that those of an item's own size are looked for in texts with a passage only.

The items are a stated query set: their windows go in blocks of at most BLOCK to every task, one pass over the documents for
each block, and nothing of the documents is shuffled. Words are the longest runs of letters and digits, in lower case. Texts are
taken whole, of any length, in steps. Null and empty texts have no windows. An item that repeats another is reported beside it.
A passage that occurs twice in a document counts once.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.session import Scratch, spread

STEP = 1 << 13  # words whose fingerprints are made at once, so that their sums stay in a core's cache
BLOCK = 100_000
SHINGLE, ALIKE = 5, 0.8
#: Bits that may differ: in passages, which are mostly sought for equal ones, and at an item's own size.
RADIUS = (3, 11)
_ASCII = re.compile("[a-z0-9]+")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each text's words, code of each word, the words by code)."""
    import regex

    run = regex.compile(r"[\p{L}\p{Nd}]+")
    lists = [(_ASCII if t.isascii() else run).findall(t.lower()) if t else [] for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    codes, names = pd.factorize(np.array([w for x in lists for w in x], object))
    return counts, codes, names


def word_bits(names: np.ndarray) -> np.ndarray:
    """One row of 64 bits a word."""
    h = pd.util.hash_array(np.asarray(names, object), categorize=False).astype(">u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(bits: np.ndarray, codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """The SimHash of each window of each length, by sums of 1, 2, 4 and more words."""
    one = bits[codes]
    sums = {1: one.astype(np.uint8 if max(lengths) < 256 else np.uint32)}
    k = 1
    while 2 * k <= max(lengths):
        s = sums[k]
        sums[2 * k] = s[: len(s) - k] + s[k:] if len(s) > k else s[:0]
        k *= 2
    out = {}
    for n in lengths:
        m = len(codes) - n + 1
        if m <= 0:
            out[n] = np.zeros(0, np.uint64)
            continue
        total, at = None, 0
        for k in sorted(sums, reverse=True):
            if n & k:
                part = sums[k][at : at + m]
                total, at = part if total is None else total + part, at + k
        out[n] = np.packbits(total > n // 2, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def own_length(n: int, words: int) -> int:
    """The class of lengths of an item of n words, which has more than `words`."""
    length = words
    while length + (length + 1) // 2 <= n:
        length += (length + 1) // 2
    return length


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """(item_id, n, passage, start, fp, words) of items (id, text): their passages and the windows of their own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, codes, names = words_of(batch.column(1).to_pylist())
            table, ends = word_bits(names) if len(names) else np.zeros((0, 64), np.uint8), np.cumsum(counts)
            for item, count, end in zip(batch.column(0).to_pylist(), counts.tolist(), ends.tolist()):
                if not count:
                    continue
                own, n = codes[end - count : end], min(count, words)
                ways = [(n, True, range(count - n + 1))]
                if count > words:
                    m = own_length(count, words)
                    ways.append((m, False, sorted({0, count - m})))
                for n, passage, starts in ways:
                    fp = fingerprints(table, own, [n])[n]
                    rows = [(item, n, passage, s, int(fp[s].astype(np.int64)), names[own[s : s + n]].tolist()) for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _WINDOW)], schema=_WINDOW)

    return items.mapInArrow(run, "item_id bigint, n int, passage boolean, start int, fp bigint, words array<string>")


_WINDOW = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("passage", pa.bool_()), ("start", pa.int32()), ("fp", pa.int64()), ("words", pa.list_(pa.string()))])
LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n", pa.int32()), ("passage", pa.bool_()), ("start", pa.int32()), ("same", pa.bool_()), ("similarity", pa.float64())])
LEAK_SQL = "doc_id bigint, item_id bigint, n int, passage boolean, start int, same boolean, similarity double"


def shingles(words: list[str]) -> Counter:
    k = min(SHINGLE, len(words))
    return Counter(zip(*[words[i:] for i in range(k)]))


class Index:
    """Item windows of one length and radius, by the four blocks of their fingerprints and what lies near these."""

    def __init__(self, rows: list, radius: int) -> None:
        self.rows, self.radius, self.near = rows, radius, radius // 4
        self.fp = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
        self.parts: list[Counter | None] = [None] * len(rows)
        flips = np.array([sum(1 << i for i in c) for k in range(self.near + 1) for c in combinations(range(16), k)], np.uint64)
        self.blocks = []
        for b in range(4):
            key = ((self.fp >> np.uint64(16 * b)) & np.uint64(0xFFFF))[:, None] ^ flips
            order = np.argsort(key.ravel(), kind="stable")
            first = np.searchsorted(key.ravel()[order], np.arange((1 << 16) + 1, dtype=np.uint64))
            self.blocks.append((np.diff(first) > 0, first.astype(np.int64), (order // len(flips)).astype(np.int32)))

    def meet(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in fp, windows) of all pairs within the radius, each once."""
        at, who = [], []
        for b, (held, first, windows) in enumerate(self.blocks):
            key = fp.view(np.uint16)[b::4] if sys.byteorder == "little" else (fp >> np.uint64(16 * b)).astype(np.uint16)
            some = np.flatnonzero(held[key])
            key = key[some].astype(np.int64)
            begin, n = first[key], first[key + 1] - first[key]
            pos = np.repeat(some, n)
            win = windows[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
            x = fp[pos] ^ self.fp[win]
            ok = np.bitwise_count(x) <= self.radius
            pos, win, x = pos[ok], win[ok], x[ok]
            for c in range(b):  # met in an earlier block
                ok = np.bitwise_count((x >> np.uint64(16 * c)) & np.uint64(0xFFFF)) > self.near
                pos, win, x = pos[ok], win[ok], x[ok]
            at.append(pos)
            who.append(win)
        return np.concatenate(at), np.concatenate(who)

    def similarity(self, window: int, words: list[str]) -> float:
        """Weighted Jaccard: shared over all counts of the shingles."""
        if self.parts[window] is None:
            self.parts[window] = shingles(self.rows[window]["words"])
        mine, theirs = self.parts[window], shingles(words)
        common = sum(min(n, mine[s]) for s, n in theirs.items() if s in mine)
        return common / (sum(mine.values()) + sum(theirs.values()) - common)


def common_run(n: int, alike: float) -> int:
    """How many words in a row two windows of n words have in common at least, if they are that alike.

    So many shingles may differ on either side; where what they share breaks off inside a window, SHINGLE - 1 of them do.
    """
    differ = int((n - SHINGLE + 1) * (1 - alike) / (1 + alike) + 1e-9)
    return (n - differ) // (1 + differ // (SHINGLE - 1)) if n > SHINGLE else n


_BUILT: dict[str, dict] = {}  # a worker's index of the latest block


def in_documents(documents: DataFrame, block: list, words: int, radius: tuple[int, int], alike: float) -> DataFrame:
    """The windows of documents that are alike a window of the block.

    Windows of an item's own size are looked for in texts with a passage of the block only, where being alike implies one.
    """
    groups: dict[tuple[int, bool], list] = {}
    for r in block:
        groups.setdefault((r["n"], r["passage"]), []).append(r.asDict())
    sent, name = documents.sparkSession.sparkContext.broadcast(groups), uuid.uuid4().hex
    # a block may hold an item's own window and not its passages
    whole = {r["item_id"] for r in block if r["passage"]} >= {r["item_id"] for r in block if not r["passage"]}
    later = {(n, p) for n, p in groups if not p and whole and n > words and common_run(n, alike) >= words}

    def built() -> dict[tuple[int, bool], Index]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = {k: Index(rows, radius[not k[1]]) for k, rows in sent.value.items()}
        return _BUILT[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = built()
        for batch in batches:
            counts, codes, names = words_of(batch.column(1).to_pylist())
            ids, owner = batch.column(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
            table = word_bits(names) if len(names) else np.zeros((0, 64), np.uint8)
            found: dict[tuple, tuple] = {}

            def scan(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray, keys: set[tuple[int, bool]]) -> np.ndarray:
                """Which texts have windows within the radius; puts those that are alike into found."""
                met = np.zeros(len(counts), bool)
                lengths = sorted({n for n, _ in keys})
                step = max(STEP, 4 * lengths[-1]) if lengths else 1
                for at in range(0, len(codes) if lengths else 0, step):
                    made = fingerprints(table, codes[at : at + step + lengths[-1] - 1], lengths)
                    for n, passage in sorted(keys):
                        ix = index[n, passage]
                        pos, win = ix.meet(made[n][:step])
                        start = at + pos
                        inside = start + n <= ends[start]
                        start, win = start[inside], win[inside]
                        met[owner[start]] = True
                        for s, w in zip(start.tolist(), win.tolist()):
                            own = names[codes[s : s + n]].tolist()
                            same = own == ix.rows[w]["words"]
                            near = 1.0 if same else ix.similarity(w, own)
                            if near >= alike:
                                key = (owner[s], n, passage, w)
                                if key not in found or found[key] < (same, near):
                                    found[key] = (same, near)
                return met

            ends = np.repeat(np.cumsum(counts), counts)
            met = scan(codes, owner, ends, set(index) - later)
            use = met[owner]
            if later and use.any():
                some = np.where(met, counts, 0)
                scan(codes[use], owner[use], np.repeat(np.cumsum(some), some), later)
            rows = [(ids[o], ix["item_id"], n, p, ix["start"], *v) for (o, n, p, w), v in found.items() for ix in [index[n, p].rows[w]]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), LEAK)] if rows else [pa.array([], f.type) for f in LEAK], schema=LEAK)

    return documents.mapInArrow(run, LEAK_SQL)


def leaks(documents: DataFrame, items: DataFrame, words: int = 13, radius: tuple[int, int] = RADIUS, alike: float = ALIKE) -> DataFrame:
    """(doc_id, item_id, n, passage, start, same, similarity): the windows of items, from word `start` on, that documents hold alike.

    Both inputs are (id, text). similarity is that of the most similar window of the document; same: it has the same words in a row.
    """
    spark = documents.sparkSession
    texts = spread(documents.filter("text is not null and text <> ''"))
    index = Scratch(spark).keep(item_windows(items, words))
    found, block = spark.createDataFrame([], LEAK_SQL), []
    for row in index.toLocalIterator():  # a block at a time
        block.append(row)
        if len(block) == BLOCK:
            found, block = found.unionByName(in_documents(texts, block, words, radius, alike)), []
    return found.unionByName(in_documents(texts, block, words, radius, alike)) if block else found

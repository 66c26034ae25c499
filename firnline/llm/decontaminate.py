"""Benchmark passages in documents, found by spaced seeds and verified in place.

A seed is a fixed mask over consecutive tokens: it hashes the marked positions and
ignores the others, so a substituted token spoils only the seeds that look at it. The
masks below hit every run of 13 tokens in which at most two differ. Items too short to
hold such a run get masks of their own length besides, chosen so that every set of
substitutions they may have leaves a mask untouched. Seeds of test
items and documents meet in an equi-join; each hit names a diagonal, and on it the
best segment around the hit is scored token by token.

A bitmap of the items' seeds drops hopeless document seeds before the join. It is one
megabyte whatever the number of items; when it fills up, more seeds pass and the join
does the work.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Marked positions of each mask.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 1, 2, 3, 5))
#: Longest items that get masks of their own, and marked positions of those.
SHORT, MARKS = 15, 5
BITMAP_BITS = 23


def demanded(length: int, identity: float) -> int:
    """Least number of equal tokens among ``length``."""
    return math.ceil(identity * length - 1e-9)


@cache
def own_masks(length: int, identity: float) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item of ``length`` tokens that, with ``MASKS`` at all places,
    leave no allowed set of substitutions without an untouched mask. Each one is the
    mask that most of the sets still open do not touch, the first in order if several."""
    changes = length - demanded(length, identity)
    placed = [frozenset(at + o for o in mask) for mask in MASKS for at in range(length - mask[-1])]
    missed = [set(spoiled) for spoiled in combinations(range(length), changes) if not any(p.isdisjoint(spoiled) for p in placed)]
    offered, chosen = list(combinations(range(length), min(MARKS, length - changes))), []
    while missed:
        mask = max(offered, key=lambda m: sum(spoiled.isdisjoint(m) for spoiled in missed))
        missed = [spoiled for spoiled in missed if not spoiled.isdisjoint(mask)]
        chosen.append(mask)
    return tuple(chosen)


def seeds(hashes: np.ndarray, first: np.ndarray, short: tuple[int, ...], identity: float):
    """(seed hash, index of the window's first token) arrays for each mask, and for each
    length in ``short`` the masks of windows of that length."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = [(length, number, mask) for length in short for number, mask in enumerate(own_masks(length, identity))]
    for length, number, mask in [*((m[-1] + 1, k, m) for k, m in enumerate(MASKS)), *((n, 1000 * n + k, m) for n, k, m in own)]:
        n = len(hashes) - length + 1
        if n <= 0:
            continue
        total = np.full(n, W.mix(np.array([number], np.uint64))[0])
        for k, offset in enumerate(mask):
            total += hashes[offset : offset + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64))
        at = np.flatnonzero(owner[:n] == owner[length - 1 :])
        yield W.mix(total[at]), at


def _tokens(column):
    return W.split_words(*W.buffer_of(column), fold=True, separators=W.NOT_WORD)


def _items(batches):
    for batch in batches:
        words = _tokens(batch.column(1))
        packed = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts, pa.int64()), pa.array(packed, pa.binary())], ["item_id", "n_tokens", "tokens"])


def _item_seeds(identity: float):
    def run(batches):
        for batch in batches:
            for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(tokens, np.uint64)
                first = np.array([0, len(tokens)])
                for found, at in seeds(tokens, first, (len(tokens),) if 0 < len(tokens) <= SHORT else (), identity):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(at), item), pa.int64()), pa.array(at, pa.int64())], ["seed", "item_id", "item_at"])

    return run


def _document_seeds(bitmap: np.ndarray, short: tuple[int, ...], identity: float):
    def run(batches):
        wanted = np.unpackbits(bitmap).view(bool)
        for whole in batches:
            for batch in W.slices(whole):
                words = _tokens(batch.column(1))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for found, at in seeds(words.hashes, words.first, short, identity):
                    hit = wanted[found >> np.uint64(64 - BITMAP_BITS)]
                    found, at = found[hit], at[hit]
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array(at - words.first[owner], pa.int64())], ["seed", "doc_id", "doc_at"])

    return run


def best_segment(same: np.ndarray, penalty: float = 2.0) -> tuple[int, int]:
    """Bounds of the segment with the highest score when a match counts 1 and a
    mismatch takes off ``penalty``."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -penalty))])
    gain = score - np.minimum.accumulate(score)
    stop = int(np.argmax(gain))
    return int(np.argmin(score[: stop + 1])), stop


def _verify(least: int, identity: float):
    def run(batches):
        names = ["doc_id", "item_id", "start", "stop", "matched"]
        for whole in batches:
            for batch in W.slices(whole):
                words = _tokens(batch.column(1))
                rows = []
                for i, candidates in enumerate(batch.column(2).to_pylist()):
                    own, best = words.hashes[words.first[i] : words.first[i + 1]], {}
                    for c in candidates:
                        item = np.frombuffer(c["tokens"], np.uint64)
                        low, high = max(0, c["diagonal"]), min(len(own), c["diagonal"] + len(item))
                        same = own[low:high] == item[low - c["diagonal"] : high - c["diagonal"]]
                        for a, b in (best_segment(same), (0, len(same))):
                            matched = int(same[a:b].sum())
                            if matched >= min(least, demanded(len(item), identity)) and matched >= demanded(b - a, identity) and matched > best.get(c["item_id"], (0,))[0]:
                                best[c["item_id"]] = (matched, low + a, low + b)
                    rows += [(batch.column(0)[i].as_py(), item, a, b, matched) for item, (matched, a, b) in best.items()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _bitmap(seeds_of_items: DataFrame) -> np.ndarray:
    """Bits that the items' seeds set; at most 2**BITMAP_BITS numbers are fetched."""
    bits = seeds_of_items.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).cast("int").alias("bit")).distinct()
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    for batch in bits.toLocalIterator(prefetchPartitions=True):
        bitmap[batch.bit] = True
    return np.packbits(bitmap)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 11, identity: float = 0.8) -> DataFrame:
    """Passages of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): one row per
    document and item found with doc_id, item_id, start and stop (token positions in
    the document, stop excluded) and matched (equal tokens between them).

    Tokens are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. An
    item is aligned with a document without gaps and counts as found where the best
    segment (a mismatch outweighs two matches) or all that is aligned is equal in at
    least ``identity`` of its tokens, and in ``least`` tokens or ``identity`` of the
    item's if those are fewer; the one with more equal tokens is reported. Items of up
    to ``SHORT`` tokens are found with any substitutions that leave ``identity`` of them.
    Null or empty items and texts match nothing, and rows without an id take no part. Rows
    that share a doc_id give one row per item and row. Ties go to the first segment. Other
    columns are not looked at; an empty table on either side gives an empty result.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = tests.mapInArrow(_items, "item_id long, n_tokens long, tokens binary").where("n_tokens > 0")
    # One row per short length, so at most SHORT rows come back.
    short = tuple(sorted(r[0] for r in items.where(F.col("n_tokens") <= SHORT).select("n_tokens").distinct().collect()))
    test_seeds = items.select("item_id", "tokens").mapInArrow(_item_seeds(identity), "seed long, item_id long, item_at long")
    train_seeds = texts.mapInArrow(_document_seeds(_bitmap(test_seeds), short, identity), "seed long, doc_id long, doc_at long")
    hits = train_seeds.join(test_seeds, "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    candidates = hits.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "tokens")).alias("candidates"))
    near = texts.join(candidates, "doc_id").select("doc_id", "text", "candidates")
    return near.mapInArrow(_verify(least, identity), "doc_id long, item_id long, start long, stop long, matched long")

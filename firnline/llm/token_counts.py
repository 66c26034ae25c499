"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

A text is cut into pre-tokens. Each run of documents inserts its distinct pre-tokens in
a trie of bytes. The forward score of a node is the least cost of cutting the prefix it
stands for into vocabulary pieces: the least over all pieces that end there of the
score of the node where the piece begins plus the piece's cost. It is computed once per
node, so once for every prefix that pre-tokens share, a whole depth of the trie at a
time. The node where a pre-token ends stores its number of pieces, and a document's
count is the sum over its pre-tokens. There is no shuffle.

Below depth ``SHARED`` a pre-token (a text in a script without spaces, a long run of
marks) hardly shares a prefix with another: the trie is a plain path there. The
pieces that end at each position of a path are found for many positions at once, and
the scores of the last positions are carried from block to block, so the work is
linear in the length and the memory bounded by the block.

The vocabulary is a public file of ranked byte strings that holds all single bytes, so
every text can be cut. A piece of rank r costs log(r + 2), Zipf's law for its
probability, rounded to thousandths; cuts of equal cost are decided by fewer pieces.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Depth up to which pre-tokens share trie nodes, and positions of a path looked up at once.
SHARED, STRETCH = 256, 1 << 16
#: Low bits of a score that count pieces: of a node (depth at most SHARED), of a path.
COUNT_BITS, PATH_BITS = 20, 40

_KIND = np.full(256, 3, np.uint8)  # other marks
_KIND[W.SPACES] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Cost in thousandths of each piece of a file with one base64 piece and its rank
    per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(piece): round(1000 * math.log(int(rank) + 2)) for piece, rank in pairs}


def pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pre-tokens of texts: runs of letters (with all non-ASCII bytes),
    digits, other marks or white space; a run takes a single space before it along."""
    kind = _KIND[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = True
    # A space that a run of another kind follows in the same text goes with that run.
    lead = (data[:-1] == 32) & (kind[1:] != 0)
    lead[edges - 1] = False
    at = np.flatnonzero(lead)
    begins[at], begins[at + 1] = True, False
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


class Pieces:
    """Vocabulary by piece length, as sorted hashes with their costs."""

    def __init__(self, costs: dict[bytes, int]):
        by_length: dict[int, list] = {}
        for piece, cost in costs.items():
            by_length.setdefault(len(piece), []).append((piece, cost))
        self.tables = {}
        for length, entries in sorted(by_length.items()):
            flat = np.frombuffer(b"".join(p for p, _ in entries), np.uint8)
            starts = np.arange(len(entries)) * length
            hashes = W._BYTES.runs(W.EXACT[flat], starts, starts + length)
            order = np.argsort(hashes)
            price = (np.array([c for _, c in entries], np.int64) << COUNT_BITS) + 1
            self.tables[length] = hashes[order], price[order]

    def price(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces of this length, and their prices."""
        known, price = self.tables[length]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        return hit, price[at[hit]]


def path_count(start: int, end: int, before: list[int], pieces: Pieces, hashed) -> int:
    """Number of pieces of the byte string at [start - len(before) + 1, end) whose first
    part, up to ``start``, is scored: ``before`` has the scores of its last positions, in
    order, the last one being that of ``start``. ``hashed`` gives the hashes of many
    stretches."""
    keep = max(pieces.tables)
    mask = (1 << COUNT_BITS) - 1
    scores = [((s >> COUNT_BITS) << PATH_BITS) + (s & mask) for s in before]
    for low in range(start, end, STRETCH):
        high = min(low + STRETCH, end)
        base = low - len(scores) + 1  # position of the first score kept
        found = []
        for length in pieces.tables:
            stops = np.arange(max(low + 1, base + length), high + 1)
            hit, price = pieces.price(length, hashed(stops - length, stops))
            found.append((stops[hit] - base, np.full(len(hit), length), price))
        stop, length, price = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(stop, kind="stable")
        stop, length, price = stop[order], length[order], price[order]
        scores += [1 << 120] * (high - low)
        for at, back, cost in zip(stop.tolist(), (stop - length).tolist(), (price >> COUNT_BITS).tolist()):
            score = scores[back] + (cost << PATH_BITS) + 1
            if score < scores[at]:
                scores[at] = score
        scores = scores[-keep:]
    return scores[-1] & ((1 << PATH_BITS) - 1)


def count_pieces(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Number of pieces of each of many distinct byte strings flat[start:end]."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    values = W.EXACT[flat]
    longest = max(pieces.tables)
    out = np.zeros(len(starts), np.int64)
    # Scores of the nodes of recent depths, and the node in which each string is there.
    scores, nodes = {0: np.zeros(1, np.int64)}, {0: np.zeros(len(starts), np.int64)}
    prefix = np.zeros(len(flat) + 1, np.uint64)
    W._BYTES.grow(len(flat))
    np.cumsum(values * W._BYTES.powers[: len(flat)], dtype=np.uint64, out=prefix[1:])

    def hashed(low, high):
        return W.mix((prefix[high] - prefix[low]) * W._BYTES.inverses[low] + (high - low).astype(np.uint64))

    for depth in range(1, min(int(lengths[0]), SHARED) + 1 if len(lengths) else 1):
        n = int(np.searchsorted(-lengths, -depth, side="right"))
        _, first, node = np.unique(hashed(starts[:n], starts[:n] + depth), return_index=True, return_inverse=True)
        best = np.full(len(first), np.iinfo(np.int64).max)
        end = starts[first] + depth
        for length in pieces.tables:
            if length > depth:
                break
            hit, price = pieces.price(length, hashed(end - length, end))
            before = scores[depth - length][nodes[depth - length][first[hit]]]
            best[hit] = np.minimum(best[hit], before + price)
        scores[depth], nodes[depth] = best, node
        scores.pop(depth - longest, None), nodes.pop(depth - longest, None)
        done = lengths[:n] == depth
        out[:n][done] = best[node[done]] & ((1 << COUNT_BITS) - 1)
    for i in np.flatnonzero(lengths > SHARED):
        before = [int(scores[depth][nodes[depth][i]]) for depth in sorted(scores)]
        out[i] = path_count(int(starts[i]) + SHARED, int(starts[i] + lengths[i]), before, pieces, hashed)
    result = np.empty(len(out), np.int64)
    result[order] = out
    return result


def _count(costs: dict[bytes, int]):
    def run(batches):
        pieces = Pieces(costs)
        for whole in batches:
            for batch in W.slices(whole, limit=8 << 20):
                data, bounds = W.buffer_of(batch.column(1))
                starts, ends = pretokens(data, bounds) if len(data) else (np.zeros(0, np.int64),) * 2
                hashes = np.zeros(len(starts), np.uint64)
                low = 0
                while low < len(starts):
                    high = max(low + 1, int(np.searchsorted(ends, starts[low] + W.BLOCK, side="right")))
                    base = starts[low]
                    hashes[low:high] = W._BYTES.runs(W.EXACT[data[base : ends[high - 1]]], starts[low:high] - base, ends[low:high] - base)
                    low = high
                _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
                size = ends[first] - starts[first]
                begin = np.cumsum(size) - size
                flat = data[np.repeat(starts[first] - begin, size) + np.arange(size.sum())]
                counts = count_pieces(flat, begin, begin + size, pieces)[of] if len(first) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(counts)])
                edges = np.searchsorted(starts, bounds)
                columns = [batch.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(np.diff(total[edges]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pretokens and n_tokens.

    ``vocabulary`` is a file on the driver. Null and empty texts have no tokens. Every
    byte of a text belongs to one pre-token, white space included; counts are exact
    however long it is. Null and repeated ids are right, as rows are
    counted one by one. Other columns are not looked at; an empty table gives an empty
    result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(load(vocabulary)), "doc_id long, n_pretokens long, n_tokens long")

"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. Sketch: each text becomes the set of its distinct word shingles; 42 bands of
   six minima give its bucket keys, and the two low bits of all 252 minima its
   packed signature. A pair with the least similarity that counts, 0.8, misses
   every band with probability (1 - 0.8**6)**42 = 3e-6.
2. Texts with equal sets form one class and go on as its smallest document. A class
   is named by a number of its own, since rows that repeat a doc_id may make it the
   smallest of several classes.
3. Bands: every class is linked to the smallest one in each of its buckets. That
   is one row per bucket member, however large the bucket, and two classes that
   share a bucket end up in the same loose group.
4. Confirmation inside a loose group, in pairs of bounded blocks: signatures rule
   out pairs whose collision-corrected similarity is hopeless, all others are
   counted on whole sets. A block pair returns a spanning forest of its links, not
   the links, so output is linear in its rows; the forests connect what all links
   would connect.
5. Components of the forests are the near-duplicate groups.

A loose group of g classes costs g / BLOCK shipments of each of its sets. Copies do
not count there (step 2); only different texts that resemble each other do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, cut

BANDS, ROWS, BITS = 42, 6, 2
#: Rows and shingles that a block of a loose group holds, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Signatures rule out pairs this far below the threshold (over 7 standard errors).
SLACK = 0.25

_HASHES = BANDS * ROWS
_ODD = (W.mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def shingle_sets(batch: pa.RecordBatch, length: int):
    """Sorted distinct shingle hashes of each text of a batch: windows of ``length``
    words, or the whole sequence of a shorter text; none for no words."""
    data, bounds = W.buffer_of(batch.column(batch.schema.get_field_index("text")))
    words = W.split_words(data, bounds, fold=True)
    hashes, at = W.windows(words.hashes, words.first, length)
    edges = np.searchsorted(at, words.first)
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        if high > low:
            yield np.unique(hashes[low:high])
        else:
            yield W.sequences(words.hashes, words.first[i : i + 2])[: int(words.counts[i] > 0)]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(short), 512):
        np.minimum(least, (short[low : low + 512, None] * _ODD).min(axis=0), out=least)
    return least


def pack(least: np.ndarray) -> bytes:
    """The low bits of scrambled minima, two to each hash function."""
    low = (W.mix(least.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
    return np.packbits(np.stack([low >> 1, low & 1], axis=1).ravel()).tobytes().ljust(64, b"\0")


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of all pairs of packed signatures, corrected for the chance that
    different minima agree in their low bits."""
    agree = np.zeros((len(a), len(b)))
    odd = np.uint64(0x5555555555555555)
    for i in range(a.shape[1]):
        differ = a[:, i, None] ^ b[None, :, i]
        agree -= np.bitwise_count((differ | (differ >> np.uint64(1))) & odd)
    agree = (agree + _HASHES) / _HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def class_of(shingles: bytes) -> bytes:
    """Digest of a shingle set."""
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sketch(length: int):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole):
                rows = []
                for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch, length)):
                    if not len(shingles):
                        rows.append((doc, 0, None, None, None))
                        continue
                    least = minima(shingles)
                    bands = W._WORDS.runs(least.astype(np.uint64), np.arange(0, _HASHES, ROWS), np.arange(ROWS, _HASHES + 1, ROWS))
                    bands = W.mix(bands + np.arange(BANDS, dtype=np.uint64))
                    rows.append((doc, len(shingles), class_of(shingles.tobytes()), bands.view(np.int64).tolist(), pack(least)))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_shingles", "class", "bands", "signature"])

    return run


def _sets(length: int):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole):
                sets = [s.tobytes() for s in shingle_sets(batch, length)]
                names = [class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["class", "shingles"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the
    shingles that occur on both sides, some thousand at a time."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    counts = np.zeros((len(left), len(right)), np.float32)

    def positions(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    if len(both):
        sides = [(*positions(left), len(left)), (*positions(right), len(right))]
        for low in range(0, len(both), 4096):
            dense = []
            for at, row, n in sides:
                a, b = np.searchsorted(at, (low, low + 4096))
                matrix = np.zeros((n, 4096), np.float32)
                matrix[row[a:b], at[a:b] - low] = 1
                dense.append(matrix)
            counts += dense[0] @ dense[1].T
    return counts


def linked_pairs(left: list, right: list, left_bits: list, right_bits: list, percent: int) -> np.ndarray:
    """Matrix of links between two lists of sets: 100 * common >= percent * union,
    confirmed on whole sets where the signatures leave a chance."""
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    bits = [np.stack([np.frombuffer(x, np.uint64) for x in side]) for side in (left_bits, right_bits)]
    hopeful = estimated(*bits) >= percent / 100 - SLACK
    rows, columns = np.flatnonzero(hopeful.any(axis=1)), np.flatnonzero(hopeful.any(axis=0))
    out = np.zeros((len(left), len(right)), bool)
    if len(rows):
        common = intersections([left[i] for i in rows], [right[i] for i in columns]).astype(np.int64)
        union = n[rows, None] + m[None, columns] - common
        out[np.ix_(rows, columns)] = (100 * common >= percent * union) & hopeful[np.ix_(rows, columns)]
    return out


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        first = table.column("block").to_numpy() == table.column("i").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        bits = table.column("signature").to_pylist()
        rows = np.flatnonzero(first)
        columns = rows if table.column("i")[0] == table.column("j")[0] else np.flatnonzero(~first)
        pairs = []
        if len(rows) and len(columns):
            links = linked_pairs([sets[i] for i in rows], [sets[i] for i in columns], [bits[i] for i in rows], [bits[i] for i in columns], percent)
            parent = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i, j in np.argwhere(links):
                a, b = root(rows[i]), root(columns[j])
                if a != b:
                    parent[a] = b
                    pairs.append((key[rows[i]], key[columns[j]]))
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id
    (smallest doc_id of its group) and kept (doc_id = component_id).

    Words are lower-cased in A-Z and end at ASCII white space. Two texts are linked
    when 100 * common >= ``percent`` * union of their distinct ``length``-word
    shingles; a shorter text is one shingle. Texts that are null or hold no word
    are linked with nothing and kept. A row without doc_id takes no part: its
    component_id is null and it is kept. Rows that repeat a doc_id are judged one by
    one. Other columns are not looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(texts.mapInArrow(_sketch(length), "doc_id long, n_shingles long, class binary, bands array<long>, signature binary"))
    known = sketch.where("doc_id is not null and class is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "signature", "n_shingles"), "doc_id").alias("s"))
    # Numbers of classes, fixed by the checkpoint.
    classes = cut(classes.select("class", "rep", F.monotonically_increasing_id().alias("key"), "s.*"))

    members = classes.select("key", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub < last").select("bucket", "hub")
    loose = cut(components(members.join(hubs, "bucket").where("key > hub").select("key", "hub").distinct()))

    group = classes.join(loose.select(F.col("node").alias("key"), F.col("component").alias("loose")), "key").select("key", "class", "rep", "loose", "signature", "n_shingles")
    blocks = group.groupBy("loose").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n"))
    wanted = cut(group.join(blocks, "loose").withColumn("block", F.pmod(F.xxhash64("key"), "n").cast("int")))
    sets = texts.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(length), "class binary, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    paired = wanted.select("*", other).select("key", "class", "loose", "signature", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    confirmed = paired.join(sets, "class").drop("class").groupBy("loose", "i", "j").applyInArrow(_confirm(percent), "a long, b long")
    groups = cut(components(confirmed).join(classes.select(F.col("key").alias("node"), "class", "rep"), "node").select("class", "rep", "component"))

    smallest = groups.groupBy("component").agg(F.min("rep").alias("smallest"))
    linked = groups.join(smallest, "component").select("class", "smallest")
    # a class without a link outside itself goes by its own smallest document
    named = classes.select("class", "rep").join(linked, "class", "left").select("class", F.coalesce("smallest", "rep").alias("smallest"))
    found = sketch.join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

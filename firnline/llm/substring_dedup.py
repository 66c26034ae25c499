"""Removal of word passages that an earlier document already holds.

Every window of fixed length gets a Rabin-Karp hash of 64 bits. Windows travel packed:
one row holds what a run of some thousand documents sends to one hash bucket, eight
bytes to a window. Before they are sent, each run keeps of equal windows only the one
in its smallest document; the others are settled on the spot. So a passage in a third
of all documents sends one entry for each run, not for each document. A bucket finds
the smallest document of each hash and returns to every larger one the hashes that
repeat, packed again by the homes where the texts are dealt; there the windows that
carry them merge into maximal intervals.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import partitions_for

#: Windows that a task gathers before it sends them: bounds its memory.
RUN = 2 << 20


def later_copies(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over entries: the first entry of each (hash, smallest document), and
    entries whose hash also belongs to a smaller document."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    first, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order], later[order] = new, d > least
    return first, later


def home(docs: np.ndarray, homes: int) -> np.ndarray:
    """Where a document's text is dealt; HOME is the same as a column expression."""
    return (docs ^ (docs >> 16)) % homes


HOME = "cast(pmod(doc_id ^ shiftright(doc_id, 16), {homes}) as long)"


def packed(place: np.ndarray, places: int, hashes: np.ndarray, docs: np.ndarray):
    """(place, ids and counts, hashes) for every place with entries: the documents of
    its entries with the number of each, and the hashes in that order."""
    order = np.lexsort((docs, place))
    edges = np.searchsorted(place[order], np.arange(places + 1))
    for at in np.flatnonzero(np.diff(edges)):
        part = order[edges[at] : edges[at + 1]]
        ids, counts = np.unique(docs[part], return_counts=True)
        yield int(at), ids.tobytes() + counts.astype(np.int32).tobytes(), hashes[part].tobytes()


def unpacked(who: list[bytes], what: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of packed rows."""
    docs = [np.repeat(np.frombuffer(x, np.int64, len(x) // 12), np.frombuffer(x, np.int32, len(x) // 12, len(x) // 12 * 8)) for x in who]
    return np.frombuffer(b"".join(what), np.uint64), np.concatenate([np.zeros(0, np.int64), *docs])


def _send(length: int, buckets: int):
    def rows(hashes, docs):
        first, later = later_copies(hashes, docs)
        out = [(place, True, *rest) for place, *rest in packed(home(docs[later], buckets), buckets, hashes[later], docs[later])]
        hashes, docs = hashes[first], docs[first]
        out += [(place, False, *rest) for place, *rest in packed((hashes % np.uint64(buckets)).astype(np.int64), buckets, hashes, docs)]
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        yield from pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "settled", "docs", "hashes"]).to_batches(1000)

    def run(batches):
        hashes, docs, held = [], [], 0
        for whole in batches:
            for batch in W.slices(whole):
                words = W.split_words(*W.buffer_of(batch.column(1)))
                found, at = W.windows(words.hashes, words.first, length)
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                owner = np.searchsorted(words.first, at, side="right") - 1
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                hashes.append(found[known[owner]])
                docs.append(ids[owner][known[owner]])
                held += len(found)
                if held >= RUN:
                    yield from rows(np.concatenate(hashes), np.concatenate(docs))
                    hashes, docs, held = [], [], 0
        if held:
            yield from rows(np.concatenate(hashes), np.concatenate(docs))

    return run


def _settle(homes: int):
    def run(table: pa.Table) -> pa.Table:
        settled = table.column("settled").to_numpy()
        who, what = table.column("docs").to_pylist(), table.column("hashes").to_pylist()
        out = [(table.column("bucket")[0].as_py(), who[i], what[i]) for i in np.flatnonzero(settled)]
        open_rows = np.flatnonzero(~settled)
        hashes, docs = unpacked([who[i] for i in open_rows], [what[i] for i in open_rows])
        _, later = later_copies(hashes, docs)
        out += packed(home(docs[later], homes), homes, hashes[later], docs[later])
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.binary(), pa.binary()])], ["home", "docs", "hashes"])

    return run


def intervals(covered: np.ndarray) -> list[dict]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _remove(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["doc_id", "n_words", "removed", "kept_text"]

    def cleaned(batch, known):
        data, bounds = W.buffer_of(batch.column(1))
        words = W.split_words(data, bounds)
        hashes, at = W.windows(words.hashes, words.first, length)
        edges = np.searchsorted(at, words.first)
        texts, spans = [], []
        for i, doc in enumerate(batch.column(0).to_pylist()):
            own = bytes(data[bounds[i] : bounds[i + 1]]).split()
            removed = []
            if doc in known:
                low, high = edges[i], edges[i + 1]
                begin = at[low:high][np.isin(hashes[low:high], known[doc])] - words.first[i]
                covered = np.zeros(len(own) + 1, np.int64)
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + length, -1)
                covered = np.cumsum(covered)[:-1] > 0
                removed = intervals(covered)
                own = list(compress(own, ~covered))
            texts.append(b" ".join(own))
            spans.append(removed)
        columns = [batch.column(0), pa.array(words.counts, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        hashes, docs = unpacked(repeats.column("docs").to_pylist(), repeats.column("hashes").to_pylist())
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
        ids, begin = np.unique(docs, return_index=True)
        known = dict(zip(ids.tolist(), np.split(hashes, begin[1:])))
        parts = [cleaned(part, known) for batch in texts.select(["doc_id", "text"]).to_batches() for part in W.slices(batch)]
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", kind), ("kept_text", pa.string())])
        return pa.Table.from_batches(parts, schema)

    return run


def remove_repeats(docs: DataFrame, length: int = 13, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, removed (maximal
    intervals of word positions, stop excluded) and kept_text, the words left over
    joined by one space.

    A word goes if a window of ``length`` consecutive words covers it whose word
    sequence also starts in a document with a smaller doc_id; windows are judged on
    the input. Words end at ASCII white space and are compared byte by byte through
    64-bit hashes. Null text has no words. A row without doc_id takes no part and
    loses nothing; rows that share a doc_id are one document to the rule, so they
    take nothing from each other. Other columns are not looked at; an empty table
    gives an empty result. ``bucket_bytes`` is about the text behind one bucket or home
    and sets the memory of a task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = partitions_for(texts, each=bucket_bytes)
    sent = texts.mapInArrow(_send(length, buckets), "bucket long, settled boolean, docs binary, hashes binary")
    back = sent.groupBy("bucket").applyInArrow(_settle(buckets), "home long, docs binary, hashes binary")
    place = F.coalesce(F.expr(HOME.format(homes=buckets)), F.pmod(F.xxhash64("text"), F.lit(buckets)))
    dealt = texts.withColumn("home", place).groupBy("home").cogroup(back.groupBy("home"))
    return dealt.applyInArrow(_remove(length), "doc_id long, n_words long, removed array<struct<start: long, stop: long>>, kept_text string")

"""Fill-in-the-middle: documents cut at line ends and put into a new order.

A text is cut into n lines; two cut points drawn from a hash of the doc_id make prefix,
middle and suffix. Where the cuts lie is worked out from chunks, not by walking lines:

* A rolling hash over 16 bytes ends a chunk wherever its top bits are zero, so a passage
  that several documents hold falls into the same chunks wherever it stands.
* What a chunk adds to a document is its summary: line ends, code points, whether it
  holds a control string, and the bytes at its two ends, in which a control string
  across a boundary shows. Summaries are kept by content: a lookup compares the bytes,
  so chunks with equal hashes are never taken for each other.
* Running sums of a document's summaries give n and the chunk of each cut; only these
  one or two chunks are searched for the line end itself.

The store of summaries lives as long as a task and holds a bounded number of bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes that the hash sees; mean and largest chunk.
SPAN, MEAN_BITS, LARGEST = 16, 9, 8192
_CONTINUED = bytes(range(0x80, 0xC0))


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted ends of all chunks of the texts between ``bounds``; every text ends one."""
    found = [bounds]
    for low in range(0, len(data), W.BLOCK):
        start = max(low - SPAN + 1, 0)
        hashed = W.EXACT[data[start : low + W.BLOCK]]
        reach = 1
        while reach < SPAN:  # sums over 2, 4, 8, ... bytes, older ones shifted further
            older = hashed[:-reach] << np.uint64(reach)
            hashed[reach:] += older
            reach *= 2
        at = np.flatnonzero(hashed >> np.uint64(64 - MEAN_BITS) == 0) + start + 1
        at = at[at > low]
        text = bounds[np.searchsorted(bounds, at, side="left") - 1]
        found.append(at[at - text >= SPAN])  # bytes of the text before do not count
    ends = np.unique(np.concatenate(found))
    wide = np.flatnonzero(np.diff(ends) > LARGEST)
    more = [np.arange(ends[i] + LARGEST, ends[i + 1], LARGEST) for i in wide]
    return np.unique(np.concatenate([ends, *more])) if more else ends


def code_points(content: bytes) -> int:
    return len(content.translate(None, _CONTINUED))


class Summaries:
    """Summary by chunk content: (line ends, code points, holds a control string). Two
    generations, so that what is still in use survives when the older one is dropped."""

    def __init__(self, limit: int = 8 << 20):
        self.limit, self.used, self.young, self.old = limit, 0, {}, {}

    def of(self, content: bytes) -> tuple[int, int, bool]:
        known = self.young.get(content)
        if known is None:
            known = self.old.get(content) or (content.count(b"\n"), code_points(content), any(m in content for m in _MARKS))
            if self.used + len(content) > self.limit:
                self.old, self.young, self.used = self.young, {}, 0
            self.young[content] = known
            self.used += len(content) + 150
        return known


class Chunked:
    """One text as its chunks' contents and the running sums of their summaries."""

    def __init__(self, chunks: list[bytes], store: Summaries):
        told = [store.of(c) for c in chunks]
        self.chunks = chunks
        self.starts = [0, *accumulate(map(len, chunks))]
        self.ends = [0, *accumulate(t[0] for t in told)]
        self.points = [0, *accumulate(t[1] for t in told)]
        self.marked = any(t[2] for t in told) or self._marked_between()
        self.lines = self.ends[-1] + (bool(chunks) and not chunks[-1].endswith(b"\n"))

    def _marked_between(self) -> bool:
        tail = b""
        for chunk in self.chunks:
            seam = tail + chunk[:2]
            if any(m in seam for m in _MARKS):
                return True
            tail = (tail + chunk)[-2:] if len(chunk) < 2 else chunk[-2:]
        return False

    def after(self, line: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``line`` lines."""
        if line > self.ends[-1]:  # the last line has no line end
            return self.starts[-1], self.points[-1]
        if line == 0:
            return 0, 0
        i = bisect_left(self.ends, line) - 1
        offset = int(np.flatnonzero(np.frombuffer(self.chunks[i], np.uint8) == 10)[line - self.ends[i] - 1]) + 1
        return self.starts[i] + offset, self.points[i] + code_points(self.chunks[i][:offset])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from a hash of the id; null draws as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _transform(seed: int, rate: int, spm_rate: int):
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "n_chunks": pa.int64(), "output": pa.binary()}

    def one(doc, chunks, store):
        text = Chunked(chunks, store)
        n, whole = text.lines, b"".join(chunks)
        h = draws(doc, seed)
        if not whole or text.marked or h[2] % 100 >= rate:
            return doc, n, "plain", None, None, len(chunks), whole
        (first, before), (second, until) = map(text.after, sorted((h[0] % (n + 1), h[1] % (n + 1))))
        parts = {b"<P>": whole[:first], b"<M>": whole[first:second], b"<S>": whole[second:]}
        form, order = ("spm", (b"<S>", b"<P>", b"<M>")) if h[3] % 100 < spm_rate else ("psm", (b"<P>", b"<S>", b"<M>"))
        return doc, n, form, before, until - before, len(chunks), b"".join(m + parts[m] for m in order)

    def run(batches):
        store = Summaries()
        for batch in batches:
            for part in W.slices(batch):
                data, bounds = W.buffer_of(part.column(1))
                ends, raw, rows = chunk_ends(data, bounds), data.tobytes(), []
                places = np.searchsorted(ends, bounds).tolist()
                cuts = ends.tolist()
                for i, doc in enumerate(part.column(0).to_pylist()):
                    edges = cuts[places[i] : places[i + 1] + 1]
                    rows.append(one(doc, [raw[a:b] for a, b in zip(edges, edges[1:])], store))
                columns = list(zip(*rows)) or [()] * len(kinds)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values())]
                yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.string())], list(kinds))

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (lines, a last one without
    line end included), form, prefix_chars, middle_chars (code points), n_chunks and
    output, the whole text in its new form.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of these with
    the suffix first. A text that is null, empty or holds a control string stays plain,
    with null lengths. Rows that share a doc_id are cut at the same draws, those without
    one too; each row is transformed by itself, however long its text. Other columns are
    not looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_transform(seed, rate, spm_rate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_chunks long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a form came from. Control strings cannot arise where a part meets
    one, as none of them continues another, so the first of each kind is the one put in."""

    def split(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.length(head) + F.lit(len(mark) + 1))

    inner = F.substr(F.col(output), F.lit(len(PREFIX) + 1))
    prefix, rest = split(inner, SUFFIX)
    suffix, middle = split(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = split(inner, PREFIX)
    prefix, middle = split(rest, MIDDLE)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)

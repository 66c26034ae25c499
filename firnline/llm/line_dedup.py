"""Line deduplication: later documents lose the blocks they share with earlier ones.

Lines are counted over all documents by hash. A shared line tells that two documents
overlap if it is rare, or too long to be boilerplate however often it occurs; a run of
consecutive short lines that is as long together tells the same. Each telling line or
run links its document to its first holder, so there are three pairs at most per line
of a document and never a pair per two holders. The two documents of
a pair are aligned by patience diff, on line hashes, and every common block that holds
a telling line leaves the later document. Telling lines that the alignment cannot place,
as they are repeated or in another order, leave with the longest common stretch around
them. What goes is always still there in the first document that had it.

Of the earlier document a pair gets only the stretch that an alignment could reach, so
a very long first holder is not copied to each of thousands of later documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import words as W
from .common import cut

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        if at:
            before[i] = piles[at - 1]
        if at == len(piles):
            piles.append(i)
            tops.append(value)
        else:
            piles[at], tops[at] = i, value
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _numbered(lines: list[int]) -> list[tuple[int, int]]:
    """Each line with the number of times it stood before."""
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: equal ends, then the longest ordered chain
    of lines unique on both sides, then the same in every gap between them. In a gap
    without such a line the k-th occurrences of each line are paired instead, so no gap
    is left in which both sides have a line in common."""
    matches, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matches.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matches.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        counts = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if counts[1][x] == 1}
        pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place and counts[0][x] == 1]
        if not pairs:
            place = {x: j for j, x in enumerate(_numbered(b[b0:b1]), b0)}
            pairs = [(i, place[x]) for i, x in enumerate(_numbered(a[a0:a1]), a0) if x in place]
        chain = [pairs[k] for k in increasing([j for _, j in pairs])]
        if chain:
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            matches += chain
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:])]
    return sorted(matches)


def standing(own: list[int], other: list[int]) -> list[int]:
    """For each place of ``own`` the length of the longest stretch that ends there and
    stands in ``other`` too, by the suffix automaton of ``other``."""
    steps, links, longest, last = [{}], [-1], [0], 0
    for x in other:
        new, at = len(steps), last
        steps.append({}), links.append(0), longest.append(longest[last] + 1)
        while at >= 0 and x not in steps[at]:
            steps[at][x] = new
            at = links[at]
        if at >= 0:
            target = steps[at][x]
            if longest[target] > longest[at] + 1:
                twin = len(steps)
                steps.append(dict(steps[target])), links.append(links[target]), longest.append(longest[at] + 1)
                links[target] = twin
                while at >= 0 and steps[at].get(x) == target:
                    steps[at][x] = twin
                    at = links[at]
                target = twin
            links[new] = target
        last = new
    out, at, length = [], 0, 0
    for x in own:
        while at and x not in steps[at]:
            at = links[at]
            length = longest[at]
        if x in steps[at]:
            at, length = steps[at][x], length + 1
        out.append(length)
    return out


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    for start, stop in spans:
        edges[start] += 1
        edges[stop] -= 1
    return np.cumsum(edges[:n]) > 0


def _places(lines: list[int], runs: set[tuple[int, ...]]) -> list[tuple[int, int]]:
    """Bounds of every place where one of the runs stands."""
    kinds: dict[int, dict[int, set]] = {}
    for run in runs:
        kinds.setdefault(run[0], {}).setdefault(len(run), set()).add(run)
    return [(i, i + n) for i, x in enumerate(lines) for n, known in kinds.get(x, {}).items() if tuple(lines[i : i + n]) in known]


def shared_blocks(later: list[int], earlier: list[int], telling: set[int], runs: set[tuple[int, ...]] = frozenset()) -> list[int]:
    """Positions in ``later`` of the aligned blocks that hold a telling line or a whole
    telling run. Those that the alignment leaves out, as they are repeated or stand in
    another order, go with the longest stretch around them that ``earlier`` has as well."""
    places = _places(later, {*runs, *((x,) for x in telling)})
    blocks, last = [], None
    for i, j in patience(later, earlier):
        if last == (i - 1, j - 1):
            blocks[-1] = blocks[-1][0], i + 1
        else:
            blocks.append((i, i + 1))
        last = i, j
    starts, spans = [start for start, _ in blocks], []
    for start, stop in places:
        block = blocks[bisect_right(starts, start) - 1] if blocks else (0, 0)
        if block[0] <= start and stop <= block[1]:
            spans.append(block)
    out = _covered(spans, len(later))
    rest = [(start, stop) for start, stop in places if not out[start:stop].all()]
    if rest:
        before = standing(later, earlier)
        after = standing(later[::-1], earlier[::-1])[::-1]
        out |= _covered([(stop - before[stop - 1], start + after[start]) for start, stop in rest], len(later))
    return np.flatnonzero(out).tolist()


def _runs(lines: W.Words, low: np.ndarray, high: np.ndarray, long_words: int):
    """Runs of lines as (hash, start, stop) arrays, where a line has the words low:high
    of its batch: for each short line the shortest runs of ``long_words`` words that
    start and that end with it, and texts that have fewer words, if in several lines.
    A stretch of that many words is covered by the runs that lie in it."""
    owner = lines.owner()
    short = np.flatnonzero((high > low) & (high - low < long_words))
    stop = np.searchsorted(high, low[short] + long_words)
    start = np.searchsorted(low, high[short] - long_words, side="right") - 1
    ahead, back = stop < lines.first[owner[short] + 1], start >= lines.first[owner[short]]
    starts, stops = np.concatenate([short[ahead], start[back]]), np.concatenate([stop[ahead], short[back]]) + 1
    yield W.salted(W._WORDS.runs(lines.hashes, starts, stops), 1), starts, stops

    filled, n_words = (np.concatenate([[0], np.cumsum(x)]) for x in (high > low, high - low))
    filled, n_words = (x[lines.first[1:]] - x[lines.first[:-1]] for x in (filled, n_words))
    whole = np.flatnonzero((filled > 1) & (n_words < long_words))
    starts, stops = lines.first[whole], lines.first[whole + 1]
    yield W.salted(W._WORDS.runs(lines.hashes, starts, stops), 2), starts, stops


def _lines(long_words: int):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole):
                data, bounds = W.buffer_of(batch.column(1))
                lines = W.split_words(data, bounds, separators=_NEWLINE)
                words = W.split_words(data, bounds)
                low, high = (np.searchsorted(words.starts, x) for x in (lines.starts, lines.ends))
                one = np.flatnonzero(high > low)
                found = [(lines.hashes[one], one, one + 1), *_runs(lines, low, high, long_words)]
                keys, starts, stops = (np.concatenate(x) for x in zip(*found))
                long = np.concatenate([high[one] - low[one] >= long_words, np.ones(len(keys) - len(one), bool)])
                owner = lines.owner()[starts]
                order = np.lexsort((starts, keys, owner))
                fresh = np.ones(len(order), bool)  # the first place of a key in its text
                fresh[1:] = (np.diff(owner[order]) != 0) | (np.diff(keys[order]) != 0)
                order = order[fresh]
                owner, starts = owner[order], starts[order]
                fields = [keys[order].view(np.int64), starts - lines.first[owner], stops[order] - starts, long[order]]
                each = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["line", "at", "size", "long"])
                offsets = pa.array(np.searchsorted(owner, np.arange(len(batch) + 1)), pa.int32())
                packed = [lines.hashes[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])]
                columns = [batch.column(0), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(offsets, each)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", "keys"])

    return run


def _align(batches):
    for batch in batches:
        out = []
        for later, earlier, begin, telling in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            a, b = (np.frombuffer(x, np.int64).tolist() for x in (later, earlier))
            runs = {tuple(b[k["there"] - begin : k["there"] - begin + k["size"]]) for k in telling}
            out.append(shared_blocks(a, b, set(), runs))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "removed"])


@F.arrow_udf(StringType())
def without_lines(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without the lines at given places, counted over lines that are not empty."""
    out = []
    for text, places in zip(texts.to_pylist(), removed.to_pylist()):
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if line]
        drop = {filled[k] for k in places or () if k < len(filled)}
        out.append("\n".join(line for i, line in enumerate(lines) if i not in drop) if drop else text)
    return pa.array(out, pa.string())


def shared_lines(docs: DataFrame, rare: int = 50, long_words: int = 8) -> DataFrame:
    """Lines that documents of ``docs`` (doc_id, text) share with earlier ones: one row
    for each doc_id that loses any, with removed, their places counted from 0 over its
    lines that are not empty.

    A line is what stands between line feeds, compared byte by byte. It is telling if
    at most ``rare`` documents hold it or it has ``long_words`` words or more, and a run
    of consecutive lines is telling if it has as many words together, or is a whole text
    of several lines. A document is aligned with the first holder (smallest doc_id) of
    each of its telling lines and runs, and loses each aligned block of consecutive lines
    that holds one, and every other occurrence of one with the stretch around it that
    both have. So each stretch of ``long_words`` words that an earlier document has goes,
    however many hold it. Shorter stretches of lines that many documents hold go only as
    part of such a block, or where they are the whole of both texts. Empty lines do not
    interrupt a block; lines of white space alone tell nothing. Null and empty texts
    and rows without doc_id take no part. Rows that share a doc_id take nothing from
    each other, and what one of them loses by place the others lose too: ids should be
    unique. Other columns are not looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, packed binary, keys array<struct<line: long, at: long, size: long, long: boolean>>"
    lined = cut(texts.where("doc_id is not null").mapInArrow(_lines(long_words), kinds))
    held = lined.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.*")
    counted = held.groupBy("line").agg(F.count("*").alias("holders"), F.min(F.struct("doc_id", "at")).alias("first"))
    known = counted.where("holders > 1").select("line", "holders", F.col("first.doc_id").alias("earlier"), F.col("first.at").alias("there"))
    telling = held.join(known, "line").where((F.col("doc_id") > F.col("earlier")) & (F.col("long") | (F.col("holders") <= rare)))
    ends = F.max(F.col("there") + F.col("size") - 1)
    pairs = telling.groupBy("doc_id", "earlier").agg(F.min("there").alias("low"), ends.alias("high"), F.collect_set(F.struct("there", "size")).alias("telling"))

    size = F.expr("octet_length(packed) div 8")
    later = lined.select("doc_id", F.col("packed").alias("later"), size.alias("n"))
    earlier = lined.select(F.col("doc_id").alias("earlier"), "packed")
    begin = F.greatest(F.col("low") - F.col("n"), F.lit(0))
    reach = F.substring("packed", begin * 8 + 1, (F.col("high") + F.col("n") + 1 - begin) * 8)
    stretches = pairs.join(later, "doc_id").join(earlier, "earlier").select("doc_id", "later", reach.alias("reach"), begin.alias("begin"), "telling")
    removed = stretches.mapInArrow(_align, "doc_id long, removed array<long>")
    return removed.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")).where("size(removed) > 0")


def remove_shared_lines(docs: DataFrame, rare: int = 50, long_words: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (lines that are not empty),
    n_removed and text, what is left by ``shared_lines``. Null and empty texts stay as
    they are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = texts.join(shared_lines(docs, rare, long_words), "doc_id", "left")
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\n]+")), F.lit(0)).cast("long")
    left = F.when(F.col("removed").isNull(), F.col("text")).otherwise(without_lines("text", "removed"))
    return both.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), left.alias("text"))

"""Exact similarity join of documents on n-gram sets, by a prefix tree.

Two sets of a and b members that satisfy percent * union <= 100 * common hold at most
a - ceil(percent * a / 100) members the other one lacks. Everything here follows from that
bound, so no link is lost, whatever the data:

1. Screen. Equal sets become one class. Each class sends its first members in hash order,
   the number that it may lack plus a twentieth of its size. Of these, a twentieth (of
   the smaller partner's size) must be found in a partner, so classes with fewer members
   that any other class sent too are out. Unique texts end here, after a fifth of their
   members were counted once.
2. Order. Members of the classes that are left get one global order, rarest first. A
   class and its partner share a member among the first ones of either, one more than
   it may lack (its prefix). Prefix members that stand in no other prefix are dropped.
3. Blocks. Classes that prefix members connect are dealt to blocks of bounded size,
   those with the same commonest prefix member together. Two blocks meet only if some
   member stands in prefixes of both and their set sizes allow a link. A meeting is a
   row per class, so a member that very many classes share costs no pairs of classes.
4. Tree. The sets of one block, commonest member first, form a prefix tree with runs of
   members on its edges. It is walked once for all sets of the other block: the overlap
   with a path is added up once for all sets below it, and a set leaves a subtree when
   its overlap so far plus what either side has left cannot reach the threshold.
5. Each class comes back with its number of links, and each pair of blocks with a
   spanning forest of its links, whose components are the components of all links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import words as W
from .common import components, cut
from .near_dedup import shingle_sets

#: Classes and set members that a block holds, about.
BLOCK, BLOCK_MEMBERS = 256, 1 << 19
#: A class sends 1 / MARGIN of its members beyond those that a partner may lack.
MARGIN = 20
#: Hash buckets of doc_ids by which texts are sieved before they are shuffled: the number
#: of rows that are broadcast has this bound, whatever the input. Where nearly all buckets
#: are taken the sieve lets every text through and the join after it decides alone.
BUCKETS = 1 << 20
#: Cells of the membership table that a walk holds at once.
_CELLS = 1 << 23


def may_lack(n, percent: int):
    """How many of ``n`` members a partner may lack, for numbers and columns."""
    if isinstance(n, Column):
        return F.floor(n * (100 - percent) / 100).cast("long")
    return n * (100 - percent) // 100


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder; readers take the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sketch(length: int, percent: int):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole):
                rows = []
                for doc, members in zip(batch.column(0).to_pylist(), shingle_sets(batch, length)):
                    n = len(members)
                    digest = hashlib.blake2b(members.tobytes(), digest_size=16).digest() if n else None
                    sent = members[: may_lack(n, percent) + -(-n // MARGIN)]
                    rows.append((doc, n, digest, sent.view(np.int64)))
                columns = list(zip(*rows)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_shingles", "digest", "sent"])

    return run


def _members(length: int):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole):
                sets = list(shingle_sets(batch, length))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "members"])

    return run


class Tree:
    """Prefix tree over increasing number sequences, kept as the sorted sequences and the
    length that each shares with the one before. A node is a range of sequences."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        self.sequences = [sequences[i] for i in order]
        self.lengths = np.array([len(s) for s in self.sequences])
        self.sizes = sizes[self.order]
        self.shared = np.zeros(len(order) + 1, np.int64)
        for i in range(1, len(order)):
            a, b = self.sequences[i - 1], self.sequences[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared[i] = differ[0] if len(differ) else n

    def walk(self, held: np.ndarray, probe_sizes: np.ndarray, percent: int):
        """(probe, sequence) index pairs of all links, given the 0/1 table of the members
        that each probe holds. 100 * common >= percent * union reads
        (100 + percent) * common >= percent * (a + b)."""
        found = []
        left = np.zeros((held.shape[0], held.shape[1] + 1), np.int32)  # members from a place on
        left[:, :-1] = np.cumsum(held[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]
        whole, part = 100 + percent, percent
        stack = [(0, len(self.sequences), 0, np.arange(len(held)), np.zeros(len(held), np.int64))]
        while stack:
            low, high, depth, probes, common = stack.pop()
            first = self.sequences[low]
            end = int(self.shared[low + 1 : high].min()) if high - low > 1 else len(first)
            run = first[depth:end]
            if len(run):
                common = common + held[probes[:, None], run[None, :]].sum(axis=1, dtype=np.int64)
            place = int(first[end - 1]) + 1 if end else 0
            if len(first) == end:  # sorts before those that go on; equal sequences stand together
                last = low
                while last < high and self.lengths[last] == end:
                    hit = whole * common >= part * (probe_sizes[probes] + self.sizes[last])
                    found.append((probes[hit], np.full(int(hit.sum()), self.order[last])))
                    last += 1
                low = last
            if low == high:
                continue
            cuts = [low, *(np.flatnonzero(self.shared[low + 1 : high] == end) + low + 1).tolist(), high]
            for a, b in zip(cuts, cuts[1:]):
                longest, smallest = self.lengths[a:b].max() - end, self.sizes[a:b].min()
                reach = common + np.minimum(left[probes, place], longest)
                stay = whole * reach >= part * (probe_sizes[probes] + smallest)
                if stay.any():
                    stack.append((a, b, end, probes[stay], common[stay]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links_between(left: list[np.ndarray], right: list[np.ndarray], left_sizes: np.ndarray, right_sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of linked sets. Sets are arrays of places in the global
    order, those that only one of all the sets holds left out; sizes are of whole sets."""
    every = np.unique(np.concatenate([*left, *right]))
    if not len(every):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = Tree([np.searchsorted(every, s) for s in right], right_sizes)
    a, b = [], []
    step = max(_CELLS // len(every), 1)
    for low in range(0, len(left), step):
        held = np.zeros((min(step, len(left) - low), len(every)), np.uint8)
        for i in range(len(held)):
            held[i, np.searchsorted(every, left[low + i])] = 1
        probes, sets = tree.walk(held, left_sizes[low : low + step], percent)
        a.append(probes + low)
        b.append(sets)
    return np.concatenate(a), np.concatenate(b)


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, sizes = table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
        column = table.column("member").combine_chunks()
        keys = np.empty(len(column.flatten()), [("holders", np.int64), ("member", np.int64)])
        for name in keys.dtype.names:
            keys[name] = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # commonest first; a member that only one of these sets holds can be in no overlap
        _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        lengths = column.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sets = []
        for low, high in zip(ends[:-1], ends[1:]):
            own = place[low:high]
            sets.append(np.sort(len(counts) - 1 - own[counts[own] > 1]))
        first = table.column("block").to_numpy() == table.column("i").to_numpy()
        rows = np.flatnonzero(first)
        columns = rows if first.all() else np.flatnonzero(~first)
        linked = np.zeros((len(node), len(node)), bool)
        if len(rows):
            a, b = links_between([sets[i] for i in rows], [sets[i] for i in columns], sizes[rows], sizes[columns], percent)
            linked[rows[a], columns[b]] = True
            linked[columns[b], rows[a]] = True
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        new, forest = np.ones(len(node), bool), []
        for start in some.tolist():
            open_ends = [start] if new[start] else []
            new[start] = False
            while open_ends:
                x = open_ends.pop()
                met = np.flatnonzero(linked[x] & new).tolist()
                new[met] = False
                open_ends += met
                forest += [(node[x], node[y]) for y in met]
        a = [*node[some].tolist(), *(int(x) for x, _ in forest)]
        b = [*[None] * len(some), *(int(y) for _, y in forest)]
        n = [*linked[some].sum(axis=1).tolist(), *[0] * len(forest)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _survivors(classes: DataFrame, percent: int) -> DataFrame:
    """Classes of which enough sent members were sent by others too: node, doc_id,
    n_shingles, digest."""
    sent = classes.select("node", F.explode("sent").alias("member"))
    shared = sent.groupBy("member").agg(F.count("*").alias("holders")).where("holders > 1").select("member")
    met = sent.join(shared, "member").groupBy("node").agg(F.count("*").alias("met"))
    # the partner may be smaller, and its own margin is what is sure to be met
    smallest = F.ceil(F.col("n_shingles") * percent / 100)
    return classes.select("node", "doc_id", "n_shingles", "digest").join(met, "node").where(F.col("met") >= F.ceil(smallest / MARGIN)).drop("met")


def _ordered(left: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """node, n_shingles, the members that another class holds too in the global order,
    their holders, and alone, the number of members left out."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    wanted = F.broadcast(left.select(bucket).distinct())  # at most BUCKETS rows
    sieved = texts.select("*", bucket).join(wanted, "bucket", "left_semi")
    held = sieved.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    # rows that repeat a doc_id with another text fall out by their digest
    sets = held.select("text").mapInArrow(_members(length), "digest binary, members array<long>").groupBy("digest").agg(F.first("members").alias("members"))
    members = sets.join(left.select("node", "digest"), "digest").select("node", F.explode("members").alias("member"))
    holders = members.groupBy("member").agg(F.count("*").alias("holders")).where("holders > 1")
    order = F.array_sort(F.collect_list(F.struct("holders", "member")))
    ordered = members.join(holders, "member").groupBy("node").agg(order.alias("m")).select("node", "m.holders", "m.member")
    return ordered.join(left.select("node", "n_shingles"), "node").withColumn("alone", F.col("n_shingles") - F.size("member"))


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """(node, n_shingles, holders, member, hub) of prefix members that stand in another prefix
    too. Members that no other class holds come first in the order."""
    length = may_lack(F.col("n_shingles"), percent) + 1 - F.col("alone")
    start = [F.slice(c, 1, F.greatest(length, F.lit(0)).cast("int")) for c in ("holders", "member")]
    first = ordered.select("node", "n_shingles", F.explode(F.arrays_zip(start[0].alias("holders"), start[1].alias("member"))).alias("m"))
    rows = first.select("node", "n_shingles", "m.*")
    shared = rows.groupBy("member").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("member", "hub")
    return rows.join(shared, "member")


def _blocks(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, n_shingles, block. A group of classes that prefix members connect is one
    block if it is small enough; in a larger one the classes with the same commonest
    prefix member stand together, and where these are too many they are spread."""
    needed = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_MEMBERS)).cast("int")
    home = prefixes.groupBy("node", "n_shingles").agg(F.max(F.struct("holders", "member")).alias("m")).select("node", "n_shingles", F.col("m.member").alias("home"))
    placed = home.join(groups.select("node", "component"), "node")
    placed = placed.join(placed.groupBy("component").agg(needed.alias("parts")), "component")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("home"), "parts")).drop("parts", "home")
    placed = placed.join(placed.groupBy("component", "part").agg(needed.alias("parts")), ["component", "part"])
    return placed.select("node", "n_shingles", F.xxhash64("component", "part", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def _meetings(prefixes: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (i, j) of blocks, i <= j, some member of which stands in prefixes of both and
    whose set sizes allow a link."""
    ranges = placed.groupBy("block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    stands = prefixes.join(placed.select("node", "block"), "node").select("member", "block").distinct()
    # a member's blocks: some 1 / BLOCK of its classes
    together = stands.groupBy("member").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    pairs = together.select(F.explode("blocks").alias("i"), "blocks").select("i", F.explode("blocks").alias("j")).where("i <= j").distinct()
    i, j = (ranges.select(F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    sized = pairs.join(i, "i").join(j, "j")
    return sized.where(f"100 * high_i >= {percent} * low_j and 100 * high_j >= {percent} * low_i").select("i", "j")


def similar(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (size of its set),
    component_id (smallest doc_id reachable by links, its own included) and n_links
    (other sets, different from its own, that it links to).

    Words are lower-cased in A-Z and end at ASCII white space. A text's set holds its
    distinct ``length``-word shingles, or its whole sequence if it is shorter; two texts
    link when 100 * common >= ``percent`` * union. Texts that are null or hold no word
    have no set and link with nothing. A row without doc_id takes no part: its
    component_id is null. Rows that repeat a doc_id are judged one by one. Other columns
    are not looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(texts.mapInArrow(_sketch(length, percent), "doc_id long, n_shingles long, digest binary, sent array<long>"), "join-sketch")
    known = sketch.where("doc_id is not null and digest is not null")
    first = F.min_by(F.struct("n_shingles", "sent"), "doc_id").alias("s")
    merged = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), first).select("digest", "doc_id", "rows", "s.*")
    # equal digests are equal sets; the numbers are fixed by being written
    classes = stored(merged.withColumn("node", F.monotonically_increasing_id()), "join-classes")

    ordered = stored(_ordered(cut(_survivors(classes, percent)), texts, length), "join-ordered")
    prefixes = cut(_prefixes(ordered, percent))
    groups = components(prefixes.where("node > hub").select("node", "hub").distinct())
    placed = cut(_blocks(prefixes, groups))
    meetings = cut(_meetings(prefixes, placed, percent))
    sides = meetings.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(sides, "block").join(ordered.select("node", "holders", "member"), "node")
    found = cut(rows.select("i", "j", "block", "node", "n_shingles", "holders", "member").groupBy("i", "j").applyInArrow(_joined(percent), "a long, b long, n long"))

    joined = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    members = joined.join(classes.select("node", "doc_id"), "node")
    named = members.join(members.groupBy("component").agg(F.min("doc_id").alias("least")), "component").join(links, "node").select("node", "least", "n_links")
    # classes of one row without links need no join: they are their own component
    told = classes.select("node", "digest", "doc_id", "rows").join(named, "node", "left").where("rows > 1 or least is not null")
    told = told.select("digest", F.coalesce("least", "doc_id").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = sketch.select("doc_id", "n_shingles", "digest").join(told, "digest", "left")
    has_id = F.col("doc_id").isNotNull()
    return every.select("doc_id", "n_shingles", F.when(has_id, F.coalesce("least", "doc_id")).alias("component_id"), F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))

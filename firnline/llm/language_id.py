"""Language of texts by a linear-chain conditional random field over their words.

Each word is scored for each language by features of its spelling: byte bigrams and
trigrams, affixes of three and four bytes, and its entry in a lexicon of frequent
words. Learned transitions tie neighbouring words together, and forward-backward gives
every word its probability of each language, so a text that switches language gets
labels word by word. A text's language is the one its words add up to.

The field is fitted on stretches of a bounded sample of labelled documents, joined at
random so that the transitions see switches. Prediction reads whole texts. Sequences
are cut into chunks whose transfer matrices link them, which is exact: all chunks go
forward and backward in step, and a very long text is just many chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

#: Hash buckets of spelling features; entries of the lexicon follow them.
BUCKETS = 1 << 17
CHUNK = 64
UNDECIDED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Field:
    """A fitted field: language names, feature weights, log transitions, and the
    sorted word hashes of the lexicon. ``spellings`` tells which spelling features the
    training pieces hold, ``usual`` what share of a piece's features the others hold."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    spellings: np.ndarray
    usual: float


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spelling features of words given by bounds in ``data``: bucket numbers, words
    one after the other, and where each word's begin."""
    n = ends - starts
    size = n + 2  # one mark before and one after
    begin = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.full(begin[-1], 3, np.uint32)
    flat[begin[:-1]] = 2
    flat[np.repeat(begin[:-1] + 1, n) + inner] = _FOLD[data[np.repeat(starts, n) + inner]]
    last = np.zeros(len(flat), bool)
    last[begin[1:] - 1] = True
    padded = np.concatenate([flat, np.zeros(4, np.uint32)])

    def gram(at, length, kind):
        code = np.full(len(at), kind, np.uint32)
        for k in range(length):
            code = code * np.uint32(0x01000193) + padded[at + k]
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)

    every = np.arange(len(flat))
    word = np.repeat(np.arange(len(n)), size)
    pairs, triples = every[~last], every[every + 2 < begin[word + 1]]
    parts = [(gram(pairs, 2, 1), word[pairs]), (gram(triples, 3, 2), word[triples])]
    for length in (3, 4):
        fits = np.flatnonzero(n >= length)
        parts.append((gram(begin[fits] + 1, length, 2 * length), fits))
        parts.append((gram(begin[fits + 1] - 1 - length, length, 2 * length + 1), fits))
    owner = np.concatenate([o for _, o in parts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([g for g, _ in parts])[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(n)))


def looked_up(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Weight row of each word's lexicon entry; words it lacks share the last row."""
    at = np.searchsorted(lexicon, hashes)
    known = lexicon[np.minimum(at, len(lexicon) - 1)] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    return BUCKETS + np.where(known, at, len(lexicon))


def scores(field: Field, data: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word for each language, and the share of its spelling features
    that the training pieces hold; each spelling is scored once."""
    known, first, of = np.unique(words.hashes, return_index=True, return_inverse=True)
    features, begin = spelling(data, words.starts[first], words.ends[first])
    own = np.add.reduceat(field.weights[features], begin, axis=0)
    met = np.add.reduceat(field.spellings[features].astype(np.float64), begin) / np.diff(np.append(begin, len(features)))
    return (own + field.weights[looked_up(field.lexicon, known)])[of], met[of]


def usual_share(features: np.ndarray, begin: np.ndarray, of: np.ndarray, owner: np.ndarray) -> float:
    """Median over pieces of the share of a piece's spelling features that another piece
    holds too. Word i of piece owner[i] has the features of spelling of[i]."""
    each = np.diff(np.append(begin, len(features)))[of]
    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    held, piece = features[np.repeat(begin[of], each) + inner], np.repeat(owner, each)
    pairs = np.unique(piece * BUCKETS + held)
    holders = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    total = np.bincount(piece)
    shares = np.bincount(piece, holders[held] > 1) / np.where(total > 0, total, 1)
    return float(np.median(shares[total > 0])) if total.any() else 0.0


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label for each word of sequences first[i]:first[i + 1], and
    the expected number of each pair of neighbouring labels."""
    n, k = emission.shape
    pairs = np.zeros((k, k))
    if not n:
        return emission, pairs
    move = np.exp(transitions)
    weight = np.exp(emission - emission.max(axis=1, keepdims=True))
    chunks = -(-np.diff(first) // CHUNK)
    of = np.repeat(np.arange(len(chunks)), chunks)
    ordinal = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[of] + ordinal * CHUNK
    length = np.minimum(first[of + 1] - begin, CHUNK)
    order = np.argsort(-length, kind="stable")  # so that the chunks still going on come first
    begin, length, of, ordinal = begin[order], length[order], of[order], ordinal[order]
    going = np.searchsorted(-length, -np.arange(1, CHUNK + 1), side="right")
    unit = lambda x: x / x.sum(axis=-1, keepdims=True)

    transfer = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t, m in enumerate(going[: length[0]]):
        step = (transfer[:m].reshape(-1, k) @ move).reshape(m, k, k) * weight[begin[:m] + t][:, None, :]
        transfer[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.full((len(begin), k), 1.0 / k), np.ones((len(begin), k))
    place = np.zeros(len(begin), np.int64)
    place[np.lexsort((ordinal, of))] = np.arange(len(begin))
    where = np.argsort(place)  # chunk at each place in reading order
    by_ordinal = np.argsort(ordinal, kind="stable")
    levels = np.searchsorted(ordinal[by_ordinal], np.arange(ordinal.max() + 2))
    for step in range(1, len(levels) - 1):
        now = by_ordinal[levels[step] : levels[step + 1]]
        before = where[place[now] - 1]
        enter[now] = unit(np.einsum("ni,nij->nj", enter[before], transfer[before]))
    for step in range(len(levels) - 2, 0, -1):
        now = by_ordinal[levels[step] : levels[step + 1]]
        before = where[place[now] - 1]
        leave[before] = unit(np.einsum("nij,nj->ni", transfer[now], leave[now]))

    out = np.empty((n, k))
    state = enter
    for t, m in enumerate(going[: length[0]]):
        state = unit((state[:m] @ move) * weight[begin[:m] + t])
        out[begin[:m] + t] = state
    back = leave.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        m = going[t]
        at = begin[:m] + t
        out[at] *= back[:m]
        ahead = back[:m] * weight[at]
        before = out[at - 1] if t else enter[:m] * (ordinal[:m] > 0)[:, None]
        both = before[:, :, None] * move * ahead[:, None, :]
        sums = both.sum(axis=(1, 2))
        pairs += (both / np.where(sums > 0, sums, 1)[:, None, None]).sum(axis=0)
        back[:m] = unit(ahead @ move.T)
    return unit(out), pairs


def _stretches(per_document: int, stretch: int):
    """Training pieces: ``per_document`` runs of words of each text, at places that a
    hash of the text chooses."""

    def run(batches):
        for whole in batches:
            for batch in W.slices(whole, limit=W.BLOCK):
                data, bounds = W.buffer_of(batch.column(1))
                words = W.split_words(data, bounds)
                rows = []
                for i, language in enumerate(batch.column(0).to_pylist()):
                    low, n = words.first[i], int(words.counts[i])
                    for part in range(per_document if n else 0):
                        a = int(W.salted(words.hashes[low : low + 1] + np.uint64(n), part)[0] % np.uint64(max(1, n - stretch + 1)))
                        b = min(a + stretch, n)
                        rows.append((language, bytes(data[words.starts[low + a] : words.ends[low + b - 1]])))
                columns = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["lang", "piece"])

    return run


def train(pieces: list[tuple[str, bytes]], rounds: int = 60, least: int = 3, seed: int = 7) -> Field:
    """Fit a field to labelled pieces by likelihood of their label sequences."""
    languages = sorted({language for language, _ in pieces})
    k, rng = len(languages), np.random.default_rng(seed)
    # Every sequence is one to four pieces of any languages, so that labels switch.
    order = rng.permutation(len(pieces))
    column = pa.array([pieces[i][1] for i in order], pa.binary())
    data, bounds = W.buffer_of(column)
    words = W.split_words(data, bounds, fold=True)
    label = np.repeat(np.array([languages.index(pieces[i][0]) for i in order]), words.counts)
    joined = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 5, len(pieces)))]))
    first = words.first[np.concatenate([joined[joined < len(pieces)], [len(pieces)]])]

    known, at, of, counts = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    lexicon = known[counts >= least]
    features, begin = spelling(data, words.starts[at], words.ends[at])
    own = looked_up(lexicon, known)
    rows = np.repeat(np.arange(len(known)), np.diff(np.concatenate([begin, [len(features)]])))
    truth = np.zeros((len(label), k))
    truth[np.arange(len(label)), label] = 1
    inside = np.ones(len(label), bool)
    inside[first[:-1]] = False
    follows = np.flatnonzero(inside)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[follows - 1], label[follows]), 1)
    # Rates of the observed switches, smoothed, are where the transitions start.
    transitions = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    weights, moved = np.zeros((BUCKETS + len(lexicon) + 1, k)), np.ones((k, k))
    memory = np.full_like(weights, 1e-2)
    for _ in range(rounds):
        emission = np.add.reduceat(weights[features], begin, axis=0) + weights[own]
        guess, expected = marginals(emission[of], first, transitions)
        error = np.zeros((len(known), k))
        difference = truth - guess
        for c in range(k):
            error[:, c] = np.bincount(of, difference[:, c], len(known))
        slope = np.empty_like(weights)
        for c in range(k):
            slope[:, c] = np.bincount(features, error[rows, c], len(weights)) + np.bincount(own, error[:, c], len(weights))
        slope -= 0.05 * weights
        memory += slope**2
        weights += 0.3 * slope / np.sqrt(memory)
        gap = seen - expected
        moved += gap**2
        transitions += 0.02 * gap / np.sqrt(moved)
    spellings = np.zeros(BUCKETS, bool)
    spellings[features] = True
    return Field(languages, weights.astype(np.float32), transitions, lexicon, spellings, usual_share(features, begin, of, words.owner()))


def fit(docs: DataFrame, documents: int = 3000, per_document: int = 2, stretch: int = 25, rounds: int = 60) -> Field:
    """Fit on at most ``documents`` rows of ``docs`` (doc_id, text, lang) in equal
    shares by language, the smallest by a hash of doc_id, and ``per_document``
    stretches of ``stretch`` words from each. Rows without lang or text are left
    out; rows that share a doc_id, or have none, count as one. The sample is fetched by the driver, and this bound is all that it holds."""
    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("draw"), "text")
    ranked = labelled.select("lang", "draw").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    # Round robin over the languages, so a rare one is not crowded out.
    drawn = ranked.where(F.col("n") <= documents).orderBy("n", "lang").limit(documents).select("lang", "draw")
    # One text a draw, also where many rows share an id or have none.
    chosen = labelled.join(F.broadcast(drawn), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")
    pieces = chosen.mapInArrow(_stretches(per_document, stretch), "lang string, piece binary").collect()
    return train(sorted((r.lang, bytes(r.piece)) for r in pieces), rounds) if pieces else Field([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros(BUCKETS, bool), 0.0)


def predicted(field: Field, text: str = "text") -> Column:
    """struct<lang_pred: string, score: double, familiar: double> for a text column: the
    language with the largest sum of word probabilities, ties to the first by name, its
    share of that sum, and the share of the words' spelling features that the training
    pieces hold, over what is usual among these, at most 1. A field labels every word
    with some language; how familiar the spelling is tells text in none of them. Words
    without a letter have no say. A text that is null or has no letter, and every text
    if the field knows no language, gets ``und``, score 0 and familiar 0."""
    speaks = np.zeros(256, bool)
    speaks[65:91] = speaks[97:123] = speaks[128:] = True

    @F.arrow_udf("struct<lang_pred: string, score: double, familiar: double>")
    def label(texts: pa.Array) -> pa.Array:
        names, shares, met = [], [], []
        for batch in W.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            data, bounds = W.buffer_of(batch.column(0))
            words = W.split_words(data, bounds, fold=True)
            votes, known = np.zeros((batch.num_rows, max(1, len(field.languages)))), np.zeros(batch.num_rows)
            if len(words.hashes) and field.languages:
                scored, share = scores(field, data, words)
                found, _ = marginals(scored, words.first, field.transitions)
                letters = np.concatenate([[0], np.cumsum(speaks[data])])
                silent = letters[words.ends] == letters[words.starts]
                found[silent], share[silent] = 0, 0
                sums = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found, axis=0)])
                votes = sums[words.first[1:]] - sums[words.first[:-1]]
                sums = np.concatenate([[0], np.cumsum(share)])
                known = sums[words.first[1:]] - sums[words.first[:-1]]
            total, best = votes.sum(axis=1), votes.argmax(axis=1)
            some = np.where(total > 0, total, 1)  # each word that speaks has one vote in all
            names += [field.languages[b] if t > 0 else None for b, t in zip(best, total)]
            shares.append(np.clip(np.where(total > 0, votes[np.arange(len(best)), best] / some, 0.0), 0, 1))
            met.append(np.clip(known / some / (field.usual or 1.0), 0, 1))
        columns = [pa.array(names, pa.string()), *(pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (shares, met))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "familiar"])

    decided = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    known = label(F.col(text))
    name = F.coalesce(F.when(decided, known["lang_pred"]), F.lit(UNDECIDED))
    shares = [F.when(name == UNDECIDED, 0.0).otherwise(known[x]).alias(x) for x in ("score", "familiar")]
    return F.struct(name.alias("lang_pred"), *shares)


def label_words(field: Field, text: str) -> list[tuple[str, str]]:
    """(word, language) for each word of one text."""
    data, bounds = W.buffer_of(pa.array([text]))
    words = W.split_words(data, bounds, fold=True)
    found, _ = marginals(scores(field, data, words)[0], words.first, field.transitions)
    return [(bytes(data[a:b]).decode(), field.languages[j]) for a, b, j in zip(words.starts, words.ends, found.argmax(axis=1))]

"""Operators against brute force on small tables, with nulls, empties, ties, repeated
rows, empty tables and clashing columns."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firnline.llm import chat, language_id, licenses, line_dedup, mixing, near_dedup, substring_dedup, token_counts, vector_search
from firnline.llm import words as W
from firnline.llm.common import components
from firnline.llm.decontaminate import MASKS, best_segment, contaminated, own_masks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string, component_id string, size string"
LONG = "word " * 60_000


def documents(spark, texts, lang="en", source="a"):
    rows = [(i, t, lang, source, len(t or ""), "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n_docs, vocabulary=60, length=40):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(names, k=rng.randint(0, length))) for _ in range(n_docs)]


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "é\xa0ü\tx"), (904, LONG), (905, LONG), (905, LONG), (None, "a b c d e f g h i j k l m n"), (906, "one")]


@pytest.mark.parametrize("block", [3, 16, 1 << 18])
def test_words(monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    texts = ["a b  c", None, "", "  é x\ty\n", "a b  c", "zz", "Q" * 9, "a b c d", "q" * 9]
    data, bounds = W.buffer_of(pa.array(texts))
    words = W.split_words(data, bounds)
    got = [[bytes(data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    flat = sum(got, [])
    assert len(set(zip(flat, words.hashes.tolist()))) == len(set(flat)) == len(set(words.hashes.tolist()))
    found, at = W.windows(words.hashes, words.first, 3)
    assert at.tolist() == [0, 3, 6, 11, 12]
    assert found[0] == found[2] != found[1]
    folded = W.split_words(data, bounds, fold=True)
    assert folded.hashes[10] == folded.hashes[15]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 161), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    vectors[100:160] = 10 * vectors[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [float("inf")] * 16), (None, [1.0] * 16)]
    other = [(6000, [1.0, 2.0]), (6020, [2.0, 1.0])]
    table = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    out = vector_search.nearest(table, table.where("vec_id % 20 = 0"), k=20, shard_rows=500).collect()
    by_query = {}
    for r in out:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == set(range(0, 1500, 20)) | {6000, 6020}
    assert sorted(by_query[6020]) == [(1, 6000, 4.0)]
    hits = 0
    for query in range(0, 1500, 20):
        got = sorted(by_query[query])
        exact = vectors @ vectors[query]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(exact, 9))) if i != query][:20]
        assert [r for r, *_ in got] == list(range(1, 21))
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(order))
    assert hits / (75 * 20) >= 0.95
    hot = [i for _, i, _ in sorted(by_query[120])]
    assert hot == [i for i in range(100, 121) if i != 120]
    assert vector_search.nearest(table.limit(0), table.limit(0)).count() == 0


def test_token_counts(spark, tmp_path):
    costs = {bytes([i]): 3000 + i for i in range(256)} | {b"th": 4000, b"the": 5000, b" the": 5500, b"aa": 3100, b"aaa": 6200, b"  ": 100}
    pattern = re.compile(rb" ?(?:[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+)|\s+?(?= \S)|\s+")

    def brute(token):
        best = [(0, 0)]
        for e in range(1, len(token) + 1):
            best.append(min((best[b][0] + costs[token[b:e]], best[b][1] + 1) for b in range(max(0, e - 4), e) if token[b:e] in costs))
        return best[-1][1]

    texts = ["the other\n\n  then", "aaaa aaaaa 12the,,", "é  x ", " ", "\n the"]
    run = token_counts._count(costs)
    out = next(run([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])]))
    for text, n, total in zip(texts, out.column(1).to_pylist(), out.column(2).to_pylist()):
        parts = pattern.findall(text.encode())
        assert b"".join(parts) == text.encode() and (n, total) == (len(parts), sum(map(brute, parts)))
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    got = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(documents(spark, ODD), str(path)).collect()}
    assert got == {(i, len((t or "").encode())) for i, t in ODD}
    assert token_counts.token_counts(documents(spark, ODD).limit(0), str(path)).count() == 0


def test_masks_hit_two_substitutions_in_thirteen():
    for spoiled in combinations(range(13), 2):
        assert any(not {q + o for o in mask} & set(spoiled) for mask in MASKS for q in range(13 - mask[-1]))


def test_best_segment():
    same = np.array([0, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1], bool)
    assert best_segment(same) == (1, 9)
    assert best_segment(np.zeros(3, bool)) == (0, 0)


def test_contaminated(spark):
    item = [f"q{i}" for i in range(30)]
    changed = list(item)
    changed[4] = changed[11] = changed[19] = "zz"
    filler = ["f%d" % i for i in range(50)]
    texts = [
        (1, " ".join(filler + item + filler)),
        (2, " ".join(filler + changed).upper()),
        (3, ", ".join(item[:12])),
        (4, " ".join(item[:8] + filler)),
        (5, " ".join(filler)),
        (6, "Tiny! Item.  here"),
        (7, " ".join(reversed(item))),
        *ODD,
    ]
    tests = spark.createDataFrame([(10, " ".join(item), "e"), (11, "tiny item", "e"), (12, None, "e"), (13, "", "e"), (None, "f1 f2", "e")], "item_id long, text string, start string")
    got = {(r.doc_id, r.item_id): (r.start, r.stop, r.matched) for r in contaminated(documents(spark, texts), tests).collect()}
    assert got == {(1, 10): (50, 80, 30), (2, 10): (50, 80, 27), (3, 10): (0, 12, 12), (6, 11): (0, 2, 2)}
    assert contaminated(documents(spark, []), tests).count() == contaminated(documents(spark, texts), tests.limit(0)).count() == 0


def test_patience():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        matches = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in matches)
        assert all(i < k and j < m for (i, j), (k, m) in zip(matches[:-1], matches[1:]))
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.shared_blocks([1, 2, 3, 4, 5], [9, 2, 3, 8, 5], {3}) == [1, 2]


def test_shared_blocks_against_brute_force():
    assert line_dedup.shared_blocks([7, 5, 8, 5, 9], [1, 5, 2], {5}) == [1, 3]
    assert line_dedup.shared_blocks([4, 5, 6, 1, 2, 3], [1, 2, 3, 4, 5, 6], {2, 5}) == [0, 1, 2, 3, 4, 5]
    rng = random.Random(8)
    for _ in range(500):
        kinds = rng.randint(2, 12)
        a, b = ([rng.randint(0, kinds) for _ in range(rng.randint(0, 16))] for _ in range(2))
        if rng.random() < 0.5:  # passages in another order, some of them twice
            parts = [b[i : i + 3] for i in range(0, len(b), 3)]
            a = sum(rng.choices(parts, k=len(parts) + 1) if parts else [], [])
        telling = {x for x in set(b) if rng.random() < 0.4}
        runs, longest = set(), [0] * len(a)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                    longest[i + k - 1] = max(longest[i + k - 1], k)
                    if telling & set(a[i : i + k]):
                        runs.update(range(i, i + k))
        got = line_dedup.shared_blocks(a, b, telling)
        assert {i for i, x in enumerate(a) if x in telling} <= set(got) <= runs
        assert line_dedup.standing(a, b) == longest
        edges = [(-1, -1), *line_dedup.patience(a, b), (len(a), len(b))]
        assert not any(set(a[i + 1 : k]) & set(b[j + 1 : m]) for (i, j), (k, m) in zip(edges[:-1], edges[1:]))
    many = list(range(20_000))  # all in reverse order: still about linear
    assert line_dedup.shared_blocks(many[::-1], many, set(many)) == many


def test_line_dedup(spark):
    a, b, c = "alpha one two", "beta three four", "gamma five six"
    texts = [(1, f"{a}\n\n{b}\nshort"), (2, f"new\n{a}\n{b}\nshort\nend"), (3, f"{c}\nshort"), (4, f"{a}\n\n{b}\nshort"), (5, "short"), (6, "short"), *ODD]
    frame = documents(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_shared_lines(frame, rare=3).collect()}
    assert got[1] == (3, 0, texts[0][1])
    assert got[2] == (5, 3, "new\nend")
    assert got[3] == (2, 0, f"{c}\nshort")  # "short" is in five documents and tells nothing
    assert got[4] == (3, 3, "")
    assert got[5][1] == got[6][1] == 0
    assert got[900] == (0, 0, None) and got[901] == (0, 0, "") and got[902] == (2, 0, " \n\t")
    assert got[904] == (1, 0, LONG) and got[905] == (1, 1, "")
    assert line_dedup.remove_shared_lines(frame, rare=3).count() == len(texts)
    assert line_dedup.remove_shared_lines(frame.limit(0)).count() == 0


def test_line_dedup_of_repeated_and_reordered_lines(spark):
    long = [f"{x} " * 8 + x for x in "abcdef"]
    texts = [(1, "\n".join(["p", *long, "q"])), (2, "\n".join(["h", long[0], "x", long[0], "y"])), (3, "\n".join([*long[3:], "new", *long[:3]]))]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_shared_lines(documents(spark, texts)).collect()}
    assert got == {1: (0, texts[0][1]), 2: (2, "h\nx\ny"), 3: (6, "new")}


def test_line_dedup_of_many_copies_with_short_lines(spark):
    verse = ["roses are red", "violets blue", " ", "sugar is sweet", "and so", "are you"]
    texts = [(i, "\n".join(verse)) for i in range(8)] + [(20 + i, "yes\n\nno") for i in range(8)]
    texts += [(40, "\n".join(["own", *verse[1:], "end", *verse[3:]])), (41, "yes\nno\nperhaps")]
    got = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(documents(spark, texts), rare=3).collect()}
    assert [got[i] for i in range(8)] == [texts[0][1]] + [""] * 7
    assert [got[20 + i] for i in range(8)] == ["yes\n\nno"] + [""] * 7
    assert got[40] == "\n".join(["own", "end", *verse[3:]]) and got[41] == "yes\nno\nperhaps"


def test_stretches_of_short_lines_against_brute_force(spark):
    """Lines in a stretch of 8 words that an earlier text has go, nothing else."""
    rng = random.Random(12)
    kinds = ["a", "b b", "c c c", "d d d d", "e e e e e", " ", "f " * 9]
    texts = [(i, "\n".join(rng.choices(kinds, k=rng.randint(1, 9)))) for i in range(120)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.shared_lines(documents(spark, texts), rare=0).collect()}
    lines = [t.split("\n") for _, t in texts]
    for i, own in enumerate(lines):
        must, may = set(), set()
        for other in lines[:i]:
            if other == own and len([x for x in own if x.strip()]) > 1:
                must.update(range(len(own)))
            for p in range(len(own)):
                for q in range(len(other)):
                    k = 0
                    while p + k < len(own) and q + k < len(other) and own[p + k] == other[q + k]:
                        k += 1
                        if sum(len(x.split()) for x in own[p : p + k]) >= 8:
                            may.update(range(p, p + k))
                            must.update(x for x in range(p, p + k) if own[x].strip())
        may |= must
        assert must <= got.get(i, set()) <= may


def test_language(spark):
    rng = random.Random(5)
    made = {"de": ["und", "schnell", "weiß", "nichtig"], "en": ["the", "quickly", "thing", "with"], "fr": ["les", "étaient", "vous", "chaude"]}
    texts = [(i, " ".join(rng.choices(made[lang], k=30)), lang) for i, lang in enumerate(["de", "en", "fr"] * 20)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    field = language_id.fit(frame, rounds=30)
    assert field.languages == ["de", "en", "fr"] and (np.diag(field.transitions) > -1).all()
    mixed = language_id.label_words(field, "the thing with quickly und nichtig schnell weiß les vous chaude les")
    assert [lang for _, lang in mixed] == ["en"] * 4 + ["de"] * 4 + ["fr"] * 4
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the thing with the thing"), (5, "les vous " * 40_000), (6, "—"), (6, "und")]
    told = documents(spark, odd, lang=None).select("doc_id", language_id.predicted(field).alias("p")).select("doc_id", "p.*").collect()
    got = sorted((r.doc_id, r.lang_pred) for r in told)
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (6, "de"), (6, "und")]
    assert all(0 <= r.score <= 1 for r in told)
    nothing = language_id.fit(frame.limit(0))
    assert frame.select(language_id.predicted(nothing).alias("p")).select("p.lang_pred").distinct().first()[0] == "und"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    n, k = 7, 3
    emission, move = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    first = np.array([0, 5, 5, 7])
    chunk, language_id.CHUNK = language_id.CHUNK, 2
    got, pairs = language_id.marginals(emission, first, move)
    language_id.CHUNK = chunk
    want, both = np.zeros((n, k)), np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:]):
        total, part, between = 0, np.zeros((n, k)), np.zeros((k, k))
        for path in np.ndindex(*[k] * (b - a)) if b > a else ():
            start = np.exp(move[:, path[0]]).sum() / k if path else 1
            weight = start * np.exp(sum(emission[a + t, y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path[:-1], path[1:])))
            total += weight
            for t, y in enumerate(path):
                part[a + t, y] += weight
            for x, y in zip(path[:-1], path[1:]):
                between[x, y] += weight
        if total:
            want += part / total
            both += between / total
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_chat(spark):
    rng = random.Random(1)
    tokens = ["<", "|", "\\", "im_start", "im_end", "|>", chat.START, chat.END, "\n", "a", "é", "assistant", "n", ""]
    make = lambda k: "".join(rng.choices(tokens, k=rng.randint(0, k)))
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", make(4)]), make(8)) for _ in range(3)]
        key, text, loss, n = chat._conversation(1, turns, "assistant")
        assert [t[:2] for t in chat.parse(text)] == turns and n == 3
        assert [chat.unescape(text[s["start"] : s["stop"]]) for s in loss] == [said for role, said in turns if role == "assistant"]
    assert chat.render_turn("user", "a \\ <| b") == f"{chat.START}user\na \\ <| b{chat.END}\n"
    for broken in ("x", chat.START, f"{chat.START}user\nhi", f"{chat.START}user\nhi{chat.END}"):
        with pytest.raises(chat.NotInGrammar):
            chat.parse(broken)
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "z"), (2, 1, "user", chat.END * 2), (2, 1, "user", chat.END * 2), (None, 1, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n\nz\n") and got[1].loss_sha256 == sha("b") and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[2].turns_sha256 == sha(f"user\n{chat.END * 2}\n" * 2) and got[2].loss_sha256 == sha("")
    assert got[None].loss_chars == len(LONG)
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_substring_dedup(spark):
    texts = list(enumerate(prose(7, 60, vocabulary=3))) + ODD
    for length in (4, 13):
        out = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.kept_text, len(r.removed)) for r in substring_dedup.remove_repeats(documents(spark, texts), length).collect())
        first = {}
        for i, t in texts:
            w = (t or "").encode().split()
            for j in range(len(w) - length + 1) if i is not None else ():
                key = tuple(w[j : j + length])
                first[key] = min(first.get(key, i), i)
        want = []
        for i, t in texts:
            w = (t or "").encode().split()
            gone = [0] * len(w)
            for j in range(len(w) - length + 1) if i is not None else ():
                if first[tuple(w[j : j + length])] < i:
                    gone[j : j + length] = [1] * length
            runs = sum(g and not p for g, p in zip(gone, [0, *gone]))
            want.append((i if i is not None else -1, len(w), b" ".join(x for x, g in zip(w, gone) if not g).decode(), runs))
        assert out == sorted(want)
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", s, 0, "x", "y", "z") for i, s in enumerate(rng.choices(["b", "a", None, "c"], [6, 2, 1, 1], k=800))]
    rows += [(900, None, "en", "a", 0, "x", "y", "z"), (901, "", "en", "empty", 0, "x", "y", "z"), (902, "w " * 300, "en", "d", 0, "x", "y", "z"), (None, "w w", "en", "a", 0, "x", "y", "z"), rows[0], rows[0]]
    frame = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([(i, 5.0 if i % 2 else 0.2) for i in range(800)] + [(None, 3.0)], "doc_id long, weight double")
    out = mixing.mix(frame, weights).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(frame.repartition(7), weights).collect()))
    sizes, targets, taken = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.taken == r.epochs * r.size <= 2 * r.size
    weigh = dict(zip(["a", "b", "c", "d", "empty", None], [3, 1, 2, 3, 1, 2]))
    budget, open_ = 1.5 * sum(sizes.values()), set(sizes)
    want = {}
    while open_:
        share = (budget - sum(want.values())) / sum(weigh[s] for s in open_)
        full = {s for s in open_ if share * weigh[s] >= 2 * sizes[s]}
        want.update({s: 2.0 * sizes[s] for s in full} if full else {s: share * weigh[s] for s in open_})
        open_ = open_ - full if full else set()
    assert all(abs(want[s] - targets[s]) < 1e-5 for s in sizes)
    longest = {s: max(r.size for r in out if r.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in sizes)
    partial = [r for r in out if r.source == "b" and r.doc_id is not None]
    assert sum(r.epochs for r in partial if r.doc_id % 2) > sum(r.epochs for r in partial if r.doc_id % 2 == 0)
    carried = mixing.mix(frame, weights, carried=True).select("row.*")
    assert carried.columns == frame.columns and carried.count() == len(rows)
    alone = mixing.mix(documents(spark, [(1, LONG), (2, "a b")]), total=1.0).collect()
    assert [r.epochs for r in alone] == [1, 1]
    assert mixing.mix(frame.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = list(enumerate(prose(8, 40)))
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"e{rng.randint(0, 9)}"
        texts.append((100 + i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    texts += [(200 + i, texts[100 % len(texts)][1]) for i in range(30)] + ODD
    out = near_dedup.near_duplicates(documents(spark, texts), length=4).collect()

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())

    known = [(i, shingles(t)) for i, t in texts if i is not None]
    group = {i: i for i, _ in known}
    for _ in range(6):
        for (i, a), (j, b) in combinations(known, 2):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[i] = group[j] = min(group[i], group[j])
    assert len(out) == len(texts)
    for r in out:
        assert r.component_id == (group[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id in (900, 901, 906)} == {900: 0, 901: 0, 906: 1}
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    bits = [np.frombuffer(near_dedup.pack(near_dedup.minima(W.mix(x))), np.uint64)[None] for x in (a, b, a + np.uint64(5000))]
    assert near_dedup.estimated(bits[0], bits[0])[0, 0] == 1
    assert abs(near_dedup.estimated(bits[0], bits[1])[0, 0] - 2 / 3) < 0.12
    assert abs(near_dedup.estimated(bits[0], bits[2])[0, 0]) < 0.12


def test_licenses(spark):
    texts = [
        (1, "x\nReleased under the MIT License."),
        (2, "released under mit terms the"),
        (3, "General\nPublic  LICENSE, and mit-license"),
        (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided the following conditions"),
        (5, "the license of the software"),
        (6, "Kit mıt license Kit"),
        *ODD,
    ]
    out = licenses.scan(documents(spark, texts)).collect()
    assert len(out) == len(texts)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out}
    assert got[1] == (6, 1, 4, 4, "mit", "mit", 1.0)
    assert got[2] == (5, 0, None, None, "", "mit", 0.8)
    assert got[3] == (6, 2, 0, 4, "gpl,mit", "gpl,mit", 1.0)
    assert got[4][4:6] == ("", "bsd") and 0.8 <= got[4][6] < 1
    assert got[5][4:] == ("", "", 0.0) and got[6][1] == 0
    assert got[900] == got[901] == (0, 0, None, None, "", "", 0.0)
    blocks = licenses.matching_blocks(documents(spark, texts)).select("doc_id", "template").distinct().collect()
    want = set()
    for i, text in texts:
        for line in (text or "").split("\n"):
            held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.translate({c: c + 32 for c in range(65, 91)})))
            for n, (_, body) in enumerate(licenses.TEMPLATES):
                need = set(body.split())
                if len(held & need) >= 0.8 * len(need):
                    want.add((i, n))
    assert {(r.doc_id, r.template) for r in blocks} == want
    assert licenses.scan(documents(spark, [])).count() == 0


def test_licenses_wrapped_over_lines(spark):
    rng = random.Random(6)
    filler, texts, want = [f"v{i}" for i in range(30)], [], {}
    for n, (label, body) in enumerate(licenses.TEMPLATES):
        words = body.split()
        for width in (2, 5):
            lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
            texts.append((len(texts), "\n".join(["# " + x for x in [*filler, *lines, *filler]])))
        spread = [x for w in words for x in (w, *filler)]  # the same words, far apart
        texts.append((len(texts), "\n".join(spread)))
    for _ in range(150):
        pool = rng.choice(licenses.TEMPLATES)[1].split()
        texts.append((len(texts), "".join(w + rng.choice(" \n") for w in rng.choices([*pool, *pool, *pool, "v1", "v2"], k=rng.randint(1, 60)))))
    frame = documents(spark, texts)
    for i, text in texts:
        words = text.replace("#", "").split()
        for n, (_, body) in enumerate(licenses.TEMPLATES if "\n" in text else ()):
            need, span = set(body.split()), -(-len(body.split()) * 5 // 4)
            best = max(len(need & set(words[k : k + span])) for k in range(len(words)))
            if best >= 0.8 * len(need):
                want[i, n] = best / len(need)
    assert {(r.doc_id, r.template): r.containment for r in licenses.matching_windows(frame).collect()} == want
    labels = {r.doc_id: r.labels for r in licenses.scan(frame).collect()}
    for n, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in labels[3 * n].split(",") and label in labels[3 * n + 1].split(",") and labels[3 * n + 2] == ""


def test_language_sample_stays_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(language_id, "train", lambda pieces, rounds: pieces)
    rows = [(None, f"some words {i}", "en") for i in range(40)] + [(7, f"quelques mots {i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(language for language, _ in language_id.fit(docs, documents=10, per_document=2)) == ["en", "en", "fr", "fr"]


@pytest.mark.parametrize("factor", [1, 10_000, 1e200])
def test_nearest_in_a_full_shard_without_clusters(spark, factor):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(8192, 64))
    vectors[77] *= factor
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    out = vector_search.nearest(table, table.where("vec_id % 40 = 0"), k=20).collect()
    queries = np.arange(0, 8192, 40)
    exact = vectors[queries] @ vectors.T
    exact[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :20]
    found = {(r.query_id, r.vec_id) for r in out}
    assert len(found) == len(out) == 20 * len(queries)
    assert np.mean([(int(q), int(i)) in found for q, row in zip(queries, best) for i in row]) >= 0.9


def test_length_bands(spark):
    rows = [([3.0, 4.0],), ([0.5, 0.0],), ([3e200, 4e200],), ([3e-300, 0.0],), ([1e-320],)]
    got = spark.createDataFrame(rows, "v array<double>").select(vector_search.length_band("v")).collect()
    assert [r[0] for r in got] == [2, -1, 666, -995, -1064]


@pytest.mark.parametrize(("shared", "stretch"), [(1, 1), (3, 5), (4, 64), (256, 7)])
def test_long_pretokens_equal_plain_programming(monkeypatch, shared, stretch):
    monkeypatch.setattr(token_counts, "SHARED", shared)
    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    rng = random.Random(shared)
    costs = {bytes([i]): 3000 + i for i in range(256)} | {b"ab": 4000, b"abc": 5000, b"cab": 4500, b"aa": 3100, b"aaaa": 6200, b"bcabc": 5100}
    longest = max(map(len, costs))

    def brute(token):
        best = [(0, 0)]
        for e in range(1, len(token) + 1):
            best.append(min((best[b][0] + costs[token[b:e]], best[b][1] + 1) for b in range(max(0, e - longest), e) if token[b:e] in costs))
        return best[-1][1]

    texts = ["".join(rng.choices("abc", k=n)) for n in (1, 2, 3, 4, 5, 9, 40, 255, 256, 257, 600)] + ["a" * 700, "abc" * 100, "abc" * 100 + "b"]
    out = next(token_counts._count(costs)([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]))
    assert out.column(2).to_pylist() == [brute(t.encode()) for t in texts]


def test_pretoken_beyond_two_to_the_twentieth(spark, tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    long = "\u96ea" * 400_000  # one pre-token of 1.2 million bytes, each a piece
    got = token_counts.token_counts(documents(spark, [(1, long), (2, long + "x")]), str(path)).collect()
    assert {(r.doc_id, r.n_pretokens, r.n_tokens) for r in got} == {(1, 1, 1_200_000), (2, 1, 1_200_001)}


def test_masks_of_short_items_leave_no_gap():
    for length in range(1, 16):
        changes = length // 5
        placed = [{at + o for o in m} for m in MASKS for at in range(length - m[-1])] + [set(m) for m in own_masks(length, 0.8)]
        assert all(any(not p & set(spoiled) for p in placed) for spoiled in combinations(range(length), changes))


def test_short_items_against_plain_alignment(spark):
    """Items of up to 15 tokens with every number of changes, beside a plain alignment of all pairs."""
    rng = random.Random(11)
    items = {n * 10 + k: [f"i{n}x{k}x{j}" for j in range(n)] for n in range(1, 16) for k in range(2)}
    items[500] = [f"long{j}" for j in range(20)]
    texts = []
    for number, item in items.items():
        for changes in range(4):
            changed = list(item)
            for j in rng.sample(range(len(item)), min(changes, len(item))):
                changed[j] = f"zz{rng.randrange(99)}"
            around = [[f"f{rng.randrange(999)}" for _ in range(rng.randrange(12))] for _ in range(2)]
            texts.append((number * 10 + changes, " ".join(around[0] + changed + around[1])))

    def holds(text, item):
        own = text.split()
        for diagonal in range(-len(item) + 1, len(own)):
            low, high = max(0, diagonal), min(len(own), diagonal + len(item))
            same = np.array(own[low:high]) == np.array(item[low - diagonal : high - diagonal])
            for a, b in (best_segment(same), (0, len(same))):
                equal = int(same[a:b].sum())
                if equal and 5 * equal >= 4 * (b - a) and (equal >= 11 or 5 * equal >= 4 * len(item)):
                    return True
        return False

    tests = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(documents(spark, texts), tests).collect()}
    want = {(d, n) for d, t in texts for n, i in items.items() if holds(t, i)}
    assert got == want
    assert {(n * 10 + c, n) for n, i in items.items() if len(i) <= 15 for c in range(len(i) // 5 + 1)} <= got


def test_near_duplicates_where_texts_share_a_doc_id(spark):
    rng = random.Random(12)
    a, b = (" ".join(f"{s}{rng.randrange(900)}" for _ in range(40)) for s in "ab")
    texts = [(3, a), (5, a + " more"), (5, b), (9, b + " more"), (5, b), (12, "one text alone that nothing resembles")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (12, 12, True)}

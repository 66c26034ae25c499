"""The prefix-tree join, fill-in-the-middle and the filter audit against plain versions."""

import hashlib
import random
import re
from itertools import combinations, permutations

import numpy as np
import pytest

from firnline.llm import filter_audit, infill, ngram_join

from .test_operators import ODD, documents, prose

# -- prefix-tree join -----------------------------------------------------------


def shingles(text, length):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < length:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + length]) for i in range(len(words) - length + 1))


def by_brute_force(texts, length, percent):
    """{row number: (n_shingles, component_id, n_links)}; rows without id take no part."""
    sets = [shingles(t, length) for _, t in texts]
    rows = [i for i, (doc, _) in enumerate(texts) if doc is not None]
    parent = {i: i for i in rows}
    partners = {i: set() for i in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in combinations(rows, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
            if sets[i] != sets[j]:
                partners[i].add(sets[j])
                partners[j].add(sets[i])
    least = {}
    for i in rows:
        least[root(i)] = min(least.get(root(i), texts[i][0]), texts[i][0])
    return [(doc, len(sets[i]), least[root(i)] if doc is not None else None, len(partners.get(i, ()))) for i, (doc, _) in enumerate(texts)]


def told(rows):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows], key=repr)


def edited(rng, words, share):
    return " ".join(f"x{rng.randrange(40)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("seed,length,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_links_equal_brute_force(spark, monkeypatch, seed, length, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "_CELLS", 300)
    rng = random.Random(seed)
    texts = []
    for _ in range(8):  # families from very close to barely alike, of differing length
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(rng.choice([2, 9, 25])):
            copy = base[: rng.randint(int(len(base) * 0.8), len(base))]
            texts.append(edited(rng, copy, rng.choice([0, 0.01, 0.03, 0.06])))
    stock = " ".join(f"s{i}" for i in range(12))  # a passage that most texts hold
    texts = [t if rng.random() < 0.4 else f"{t} {stock}" for t in texts] + prose(seed, 25)
    texts += rng.choices(texts, k=15)
    rng.shuffle(texts)
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + ODD
    assert told(ngram_join.similar(documents(spark, rows), length, percent).collect()) == sorted(by_brute_force(rows, length, percent), key=repr)


def test_rows_that_repeat_a_doc_id_do_not_link_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a + " more"), (5, b), (9, b + " more"), (9, b + " more"), (None, a)]
    got = told(ngram_join.similar(documents(spark, rows), 4, 85).collect())
    assert got == sorted([(3, 57, 3, 1), (5, 58, 3, 1), (5, 57, 5, 1), (9, 58, 5, 1), (9, 58, 5, 1), (None, 57, None, 0)], key=repr)


def test_empty_tables_and_texts(spark):
    assert ngram_join.similar(documents(spark, []), 4, 85).count() == 0
    got = told(ngram_join.similar(documents(spark, [(1, None), (2, ""), (3, " \n")]), 4, 85).collect())
    assert got == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)]


@pytest.mark.parametrize("seed", range(30))
def test_tree_equals_counting(seed):
    rng = random.Random(seed)
    pool, percent = rng.choice([6, 12, 40]), rng.choice([50, 80, 85, 100])
    sets = [sorted(rng.sample(range(pool), rng.randint(0, pool))) for _ in range(rng.randint(1, 40))]
    sets += [sorted(set(s) - {rng.randrange(pool)}) for s in sets]
    arrays, extra = [np.array(s, np.int64) for s in sets], np.array([rng.choice([0, 0, 1]) for _ in sets])
    sizes = np.maximum(np.array([len(s) for s in sets]) + extra, 1)  # members that no other set holds
    half = len(sets) // 2
    a, b = ngram_join.links_between(arrays[:half], arrays[half:], sizes[:half], sizes[half:], percent)
    want = set()
    for i in range(half):
        for j in range(half, len(sets)):
            common = len(set(sets[i]) & set(sets[j]))
            if common and 100 * common >= percent * (sizes[i] + sizes[j] - common):
                want.add((i, j - half))
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_a_large_family_meets_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 0.01)) for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{i}-{k}" for k in range(60)) + " " + " ".join(base[:30])) for i in range(100)]
    joined = ngram_join._joined

    def watched(percent):
        run = joined(percent)

        def count(table):
            if table.num_rows > 3 * 2 * 16:  # twice two blocks, dealt by hash
                raise ValueError("a pair of blocks is too large")
            return run(table)

        return count

    monkeypatch.setattr(ngram_join, "_joined", watched)
    got = told(ngram_join.similar(documents(spark, rows), 4, 85).collect())
    assert got == sorted(by_brute_force(rows, 4, 85), key=repr)


# -- fill-in-the-middle ---------------------------------------------------------


def formed(doc, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_texts():
    rng = random.Random(11)
    shared = "".join(rng.choice(["naïve ", "line\n", "日本語\n", "\r\n", "word ", "<", "P>", "😀\n"]) for _ in range(400))
    texts = [(i, "".join(rng.choice([shared, "a\n", "bb ", "<P", "<\n", "S><", "\n\n"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    texts += [(200 + i, "x" * i + mark + "y" * 50) for i in range(30) for mark in ("<P>", "<S>", "<M>", "<S", "<")]
    texts += [(400, "no line end " * 20_000), (401, "\n" * 50_000), (402, "z" * 100_000 + "\n" + "z" * 100_000), (403, "\n"), (404, "a")]
    return texts + ODD


@pytest.mark.parametrize("bits,largest,block,limit", [(9, 8192, 1 << 18, 8 << 20), (2, 40, 64, 500), (4, 16, 1000, 1)])
def test_infill_equals_plain_cutting(spark, monkeypatch, bits, largest, block, limit):
    """With usual chunks, with tiny ones (marks and line ends across their boundaries),
    and with a store that forgets at once."""
    monkeypatch.setattr(infill, "MEAN_BITS", bits)
    monkeypatch.setattr(infill, "LARGEST", largest)
    monkeypatch.setattr(infill.W, "BLOCK", block)
    monkeypatch.setattr(infill.Summaries.__init__, "__defaults__", (limit,))
    texts = infill_texts()
    frame = infill.fill_in_middle(documents(spark, texts)).withColumn("back", infill.restored())
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in frame.collect()]
    assert sorted(got, key=repr) == sorted([(d, *formed(d, t), t or "") for d, t in texts], key=repr)


def test_infill_rates_seed_and_empty_table(spark):
    texts = [(i, f"a{i}\nb\nc\n") for i in range(300)]
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.fill_in_middle(documents(spark, texts), seed=3, rate=60, spm_rate=10).collect()}
    assert got == {d: formed(d, t, 3, 60, 10) for d, t in texts}
    forms = [g[1] for g in got.values()]
    assert 80 < forms.count("plain") < 160 and 0 < forms.count("spm") < 50
    assert infill.fill_in_middle(documents(spark, [])).count() == 0


def test_chunks_follow_content():
    rng = random.Random(2)
    shared = bytes(rng.randrange(256) for _ in range(30_000))

    def chunks(*texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        ends = infill.chunk_ends(data, bounds).tolist()
        assert set(bounds.tolist()) <= set(ends) and max(np.diff(ends)) <= infill.LARGEST
        return [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    one, two = set(chunks(b"ab" * 100 + shared)), set(chunks(b"other", b"z" * 57 + shared + b"tail"))
    assert len(one & two) > 30


# -- filter audit ---------------------------------------------------------------


def audited(docs, labels):
    """By walking every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails, parts = [], {}
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        out += "E" * any(doc is not None and d is not None and d < doc and (t or "") == text for d, t, _ in docs)
        fails.append(out)
        parts.setdefault(lang or "", []).append((doc, out))
    rows = {}
    for part, members in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            there = list(members)
            for step, f in enumerate(order, 1):
                out = [m for m in there if f in m[1]]
                kept = [m for m in there if f not in m[1]]
                gone = [m for m in members if m not in there]
                shapley[f] += len(out)
                rows[part, "".join(order), step] = [f, len(kept), len(out), sum(f in m[1] for m in members) - len(out), sum(m[1] == f for m in members), sum(m[0] in good for m in out), sum(m[0] in toxic for m in out)]
                there = kept
        for (p, _, _), row in rows.items():
            if p == part:
                row.append(shapley[row[0]])
    return {k: tuple(v) for k, v in rows.items()}


def test_audit_equals_walking(spark):
    rng = random.Random(9)
    pieces = ["plain word here ", "Capital LETTERS ", "mark # ", "again again ", "ünï cödé "]
    docs = []
    for i in range(150):
        text = "".join(rng.choices(pieces, k=rng.choice([2, 60, 120]))) + " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 250])))
        docs.append((i, rng.choice([text, docs[0][1] if docs else text]), rng.choice(["en", "de", None, ""])))
    docs += [(7, docs[0][1], "en"), (7, docs[0][1], "en"), (None, docs[0][1], "en"), (None, "alone", None), (300, None, "de"), (301, None, "fr"), (302, "", "fr"), (303, "Q" * 100_000, "fr"), (0, docs[0][1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(7, 1, None), (7, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, part string, mask string")
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, good string")
    out = filter_audit.audit(filter_audit.cells(frame, table)).collect()
    got = {(r.part, r.filter_order, r.step): (r["filter"], *[r[c] for c in filter_audit.COUNTS], r.shapley) for r in out}
    assert len(out) == len(got) == 600 * 4
    assert got == audited(docs, labels)


def test_audit_of_nothing_and_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(empty, labels)).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    rows = filter_audit.audit(filter_audit.cells(one, labels)).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)
    assert {(r["filter"], r.shapley) for r in rows} == {("A", 120), *((f, 0) for f in "BCDE")}
    assert all(r.removed + r.kept == 1 or r.step > r.filter_order.index("A") + 1 for r in rows)

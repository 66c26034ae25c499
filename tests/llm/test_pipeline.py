"""The corpus pipeline against a plain version of its stages on a small folder."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firnline.llm import language_id

DOCS = "doc_id long, source string, text string, lang string, n_chars long"


def words(rng, n, stem):
    return [f"{stem}{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts in two languages, and texts that each stage must act on."""
    rng = random.Random(5)
    clean = {i: "\n".join(" ".join(words(rng, 9, "the" if i % 2 else "der")) for _ in range(6)) for i in range(40)}
    texts = dict(clean)
    passage = " ".join(words(rng, 30, "quiz"))
    texts[100] = None
    texts[101] = " 12 34 \n 56"
    texts[102] = clean[3]  # an exact copy: nothing is left of it
    changed = clean[4].split()
    changed[20] = "other"
    texts[103] = " ".join(changed)  # a near copy on a single line
    texts[104] = "\n".join([clean[5].split("\n")[2], " ".join(words(rng, 40, "the"))])  # one line of 5
    inside = passage.split()
    inside[12] = "swap"
    texts[105] = " ".join([*words(rng, 30, "the"), *inside, *words(rng, 30, "the")])
    rows = [(i, "ab"[i % 2] if i % 5 else None, t, None if i % 7 == 0 else "en" if i % 2 else "de", len(t or "")) for i, t in texts.items()]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(3, 1), (4, 0), (5, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, passage


def shingles(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def without_shared_lines(texts):
    """Long lines that an earlier document holds go."""
    first, out = {}, {}
    for i, text in sorted(texts.items()):
        for line in text.split("\n"):
            first.setdefault(line, i)
        left = [line for line in text.split("\n") if first[line] == i]
        if left:
            out[i] = "\n".join(left)
    return out


def one_of_each_group(texts):
    least = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            x, y = shingles(texts[a]), shingles(texts[b])
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                least[b] = min(least[b], least[a])
    return {i: t for i, t in texts.items() if least[i] == i}


def leaks(text, passage):
    own, item = text.split(), passage.split()
    best = max((sum(x == y for x, y in zip(own[d:], item)) for d in range(len(own))), default=0)
    return best >= 11


def test_stages_equal_plain_versions(spark, folder):
    path, texts, passage = folder
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    plain = [lambda t: kept, without_shared_lines, one_of_each_group, lambda t: {i: x for i, x in t.items() if not leaks(x, passage)}]
    for (name, stage), expect in zip(corpus_pipeline.STAGES[:-1], plain):
        docs = stage(spark, docs, path).cache()
        kept = expect(kept)
        assert docs.columns == columns, name
        assert {r.doc_id: r.text for r in docs.collect()} == kept, name
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0, name
    assert set(range(40)) - {103} <= set(kept) and not {100, 101, 102, 103, 105} & set(kept) and "\n" not in kept[104]

    mixed = corpus_pipeline.mixture(spark, docs, path).collect()
    sizes = {i: len(t.split()) for i, t in kept.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = {}
    for r in mixed:
        assert (r.text, r.mix_words) == (kept[r.doc_id], sizes[r.doc_id])
        taken.setdefault(r.doc_id, []).append(r.mix_epoch)
    assert all(sorted(e) == list(range(1, len(e) + 1)) and len(e) <= 2 for e in taken.values())
    for name, target in plain_targets(sizes, source).items():
        own = [i for i in sizes if source[i] == name]
        words_taken = sum(sizes[i] * len(taken.get(i, ())) for i in own)
        assert abs(words_taken - target) <= max(sizes[i] for i in own) / 2 + 1e-6


def plain_targets(sizes, source):
    """Shares by weight, stopped at twice a source, the excess shared again."""
    names = sorted(set(source[i] for i in sizes), key=lambda s: (s is None, s or ""))
    own = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(own.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * own[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * own[s]
            left -= out[s]
        free -= over
    return out


def test_run_equals_its_stages(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
    order = ["doc_id", "mix_epoch"]
    assert corpus_pipeline.run(spark, path).orderBy(*order).collect() == docs.orderBy(*order).collect()


def test_stages_take_columns_of_any_name(spark, folder):
    path, _, _ = folder
    docs = plain = spark.read.parquet(f"{path}/documents.parquet")
    names = ["row", "of", "gone", "removed", "rejected", "size", "epochs", "weight", "component_id", "mix_words", "mix_epoch", "with.dot"]
    docs = docs.select("*", *[F.concat(F.lit(name), "doc_id").alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs, plain = stage(spark, docs, path).cache(), stage(spark, plain, path).cache()
        assert sorted(docs.select(*plain.columns).collect()) == sorted(plain.collect()), name
    for name in names:
        if not name.startswith("mix"):
            assert docs.where(F.col(f"`{name}`") != F.concat(F.lit(name), "doc_id")).count() == 0


def test_language_stage_rejects_junk_of_letters(spark, folder):
    """Random letters go, whether labelled or not; clean texts of any length and short
    ones with numbers between stay."""
    path, _, _ = folder
    rng = random.Random(8)
    syllables = {"en": "the ing tion er an with st our".split(), "de": "der ung sch ein ver lich auf ge".split()}

    def clean(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))

    def junk(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))

    rows = [(i, clean(lang, n), lang) for i, (lang, n) in enumerate([("en", 60), ("de", 60), ("en", 12), ("de", 3000)] * 20)]
    rows += [(200, "the with 17 4 2029 99 100", None), (201, clean("en", 30) + " " + clean("de", 30), None)]
    good = {i for i, _, _ in rows}
    rows += [(300 + i, junk("bcdfghjklmnpqrstvwxz", 5 + 40 * i), None) for i in range(25)]
    rows += [(400, junk("qxzjkvwy", 3000), None), (401, "\u0431\u0443\u043a\u0432\u044b " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, path).collect()} == good


def test_stages_take_an_empty_table(spark, folder):
    path, _, _ = folder
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
    assert language_id.fit(empty).languages == []

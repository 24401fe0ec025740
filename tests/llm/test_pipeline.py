"""The pipeline's stages by what they must do, on a small corpus with planted cases."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline as pipeline
from gleaner.llm import langid_kn
from gleaner.llm.common import text_buffers
from tests.llm.test_duplicates import brute_near, brute_removed
from tests.llm.test_mixing_packing import level_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    sounds = {"en": ["the", "ing", "ou", "re", "sh"], "de": ["sch", "ung", "ein", "ver", "ö"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))

    passage = text("en", 60)
    rows = [(i, text(lang := rng.choice(list(sounds)), rng.randint(30, 300)), lang, f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, f"{text('en', 80)} {passage} {text('en', 80)}", "en", "s0", 0) for i in range(3)]
    near = text("de", 200).split()
    for i in range(3):
        copy = list(near)
        copy[10 * i] = "anders"
        rows.append((300 + i, " ".join(copy), "de", "s1", 0))
    rows += [(400, rows[0][1], "en", "s2", 0), (401, None, None, None, None), (402, "0101 !!", None, "s1", None), (1, rows[1][1], "de", "s1", 0)]
    return rows, passage


def test_stages(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    columns, states = docs.columns, [docs]
    for _, stage in pipeline.STAGES:
        out = stage(spark, states[-1], "")
        states.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(s.columns == columns for s in states[:5])
    ids = [[r["doc_id"] for r in s.collect()] for s in states]
    assert set(ids[0]) - set(ids[1]) == {401, 402}
    assert set(ids[1]) - set(ids[2]) == {301, 302, 400} and len(ids[2]) == len(set(ids[2]))
    texts = {r["doc_id"]: r["text"] for r in states[3].collect()}
    before = {r["doc_id"]: r["text"] for r in states[2].collect()}
    assert all(passage not in texts[i] and len(texts[i].split()) == 160 for i in (200, 201, 202))
    assert all(texts[i] == before[i] for i in texts if i not in (200, 201, 202)) and set(texts) == set(before)
    words = sum(len(t.split()) for t in texts.values())
    mixed = [r["text"] for r in states[4].collect()]
    assert abs(sum(len(t.split()) for t in mixed) - 1.5 * words) < 0.25 * words
    pieces = states[5].toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024 and len(pieces) >= len(mixed)


def test_stages_against_brute_force(spark):
    """Each stage on the planted corpus with odd rows and a very long text, against the same thing in plain Python."""
    rows, _ = corpus()
    long = " ".join(random.Random(7).choice(["theshou", "ingre", "ouousre", "shing"]) + random.Random(i).choice(["the", "re"]) for i in range(30_000))
    rows += [(500, long, "en", "s1", 0), (501, "ein zwei", "de", None, 0), (502, "the the", "en", "s0", None)]
    docs = spark.createDataFrame(rows, DOCS)
    # language: what the models do not reject
    model = langid_kn.fit(docs)
    kept = pipeline.language(spark, docs, "").collect()
    left = Counter(tuple(r) for r in kept)
    judged = [model.judge(*text_buffers(pa.array([r[1]], pa.string())))[3][0] for r in rows]
    assert left == Counter(tuple(r) for r, rejected in zip(rows, judged, strict=True) if not rejected)
    # near-duplicates: one of each component
    texts = [tuple(r) for r in kept]
    near = pipeline.near_duplicates(spark, spark.createDataFrame(texts, DOCS), "").collect()
    component = {(i, n): least for i, n, least in brute_near(texts, 5, 80)}
    assert Counter(r["doc_id"] for r in near) == Counter({int(x): 1 for x in component.values()})
    # substrings: the words that no repeated window covers
    before = [tuple(r) for r in near]
    after = {r["doc_id"]: r["text"] for r in pipeline.substrings(spark, spark.createDataFrame(before, DOCS), "").collect()}
    want = {int(i): (n, removed, sha) for i, n, removed, sha in brute_removed(before, 35)}
    for i, text, *_ in before:
        n, removed, sha = want[i]
        if removed == 0:
            assert after[i] == text
        else:
            assert i not in after if removed == n else hashlib.sha256(after[i].encode()).hexdigest() == sha
    # mix: floor(rate) copies and one more where the draw is below the fraction
    sized = [(i, t, lang, s, c) for i, t, lang, s, c in before]
    mixed = Counter(r["doc_id"] for r in pipeline.mix(spark, spark.createDataFrame(sized, DOCS), "").collect())
    total = Counter()
    for _, t, _, source, _ in sized:
        total[source] += len(t.split())
    names = sorted(total, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, level_targets([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    for i, _, _, source, _ in sized:
        rate = targets[source] / total[source]
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert mixed[i] == int(rate) + (draw < rate - int(rate))


def test_different_texts_under_one_id_all_stay(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["ein", "sch", "ung"]) + str(k) for _ in range(60)) for k in range(5)]
    rows = [(1, texts[0], "en", "a", 0), (2, texts[1], "en", "a", 0), (5, texts[2], "en", "a", 0), (5, texts[3], "en", "b", 0), (7, texts[4], "en", "b", 0), (7, texts[4], "en", "c", 0), (8, texts[3] + " more", "en", "b", 0)]
    runs = []
    for order in (rows, rows[::-1]):
        out = pipeline.near_duplicates(spark, spark.createDataFrame(order, DOCS), "")
        assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        runs.append(sorted(tuple(x) for x in out.collect()))
    assert runs[0] == runs[1] == sorted(rows[:5])


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0

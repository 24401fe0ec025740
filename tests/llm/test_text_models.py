"""Language, quality, toxicity: exact parts against brute force, the rest by held-out accuracy."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import langid_kn, quality_knn, queries, toxicity_cf
from gleaner.llm.common import split_words, text_buffers, word_hashes

DOCS = "doc_id long, text string, lang string, source string, label long"
TABLES = "/root/testdata/sf0.01"


def auc(truth, score):
    truth, rank = np.asarray(truth) == 1, np.argsort(np.argsort(score)) + 1
    return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


def buffers(texts):
    import pyarrow as pa

    return text_buffers(pa.array(texts, pa.string()))


def test_words_of_texts():
    texts = ["a bc", None, "", " x\ty\n", "é😀 é", "end"]
    raw, offsets = buffers(texts)
    starts, ends, first = split_words(raw, offsets)
    words = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["a", "bc", "x", "y", "é😀", "é", "end"] and first.tolist() == [0, 2, 2, 2, 4, 6, 7]
    h = word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == 7


def reduced(text):
    out = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return "   " + " ".join(out) + (" " if out else "")


def test_reduction_of_texts():
    texts = ["Ab, c1d", "", "?!", "Éa  x", None, "z"]
    chars, bounds = langid_kn.reduced(*buffers(texts))
    got = ["".join(map(chr, chars[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert [g.rstrip() for g in got] == [reduced(t or "").rstrip() for t in texts]


def small_docs():
    rng = random.Random(4)
    sounds = {"xx": ["ba", "du", "ki"], "yy": ["sch", "ung", "ein"], "zz": ["çã", "õe", "lho"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30))), lang, "s", 1))
    return [*rows, (1000, None, None, None, None), (1001, "12 !?", "xx", None, 0), (1005, "", None, None, None), (None, "baduki", None, None, None), (1006, "ba " * 30000, "xx", None, None), (1007, "𐍈", None, None, None)]


def test_probabilities_sum_to_one_and_match_the_formula(spark):
    m = langid_kn.fit(spark.createDataFrame(small_docs(), DOCS))
    every = np.arange(65536, dtype=np.uint64)
    for context in ("bad", "   ", " sc", "qqq"):
        a, b, c = (np.uint64(ord(x)) for x in context)
        p = np.exp2(m.logs(a << np.uint64(48) | b << np.uint64(32) | c << np.uint64(16) | every).astype(float)).sum(0)
        assert p == pytest.approx(np.ones(3), abs=1e-4)


def brute_kneser_ney(texts):
    """p(character | three before) by the textbook recursion over dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        r = reduced(t)
        counts[4].update(r[i : i + 4] for i in range(len(r) - 3))
    for o in (3, 2, 1):  # below the highest order a gram counts by its different left neighbours
        counts[o] = Counter(g[1:] for g in counts[o + 1])

    def p(gram):
        o = len(gram)
        if o == 0:
            return 1 / 65536
        c = counts[o]
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        own = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(gram[1:])

    return p


def test_probabilities_against_brute_force(spark):
    docs = [r for r in small_docs()[:60]]
    m = langid_kn.fit(spark.createDataFrame(docs, DOCS))
    rng, letters = random.Random(9), sorted({c for _, t, *_ in docs for c in t.lower()} | {"q"})
    seen = [t[i : i + 4] for _, t, *_ in docs for i in range(0, max(0, len(t) - 3), 7)]
    grams = [*seen[:60], *("".join(rng.choice(letters) for _ in range(4)) for _ in range(60)), "   b", "  ba", "qqqq"]
    keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
    learned = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 5]
    for l, lang in enumerate(m.langs):
        p = brute_kneser_ney([t for _, t, x, *_ in learned if x == lang])
        assert np.exp2(m.logs(keys)[:, l]) == pytest.approx([p(g) for g in grams], rel=1e-4)


def test_many_languages_take_memory_by_their_grams():
    """A hundred languages of different grams: numbers per gram, not per gram and language."""
    rng = np.random.default_rng(1)
    counts = [(np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64)), None) for _ in range(100)]
    m = langid_kn.Model([f"l{i:02d}" for i in range(100)], [(k, np.ones(len(k), np.int64)) for k, _ in counts])
    size = sum(a.nbytes for t in (*m.direct.values(), *m.weight.values()) for a in (t.hashes, t.index, t.ends, t.langs, t.values))
    assert size < 64 * 7 * 100 * 5000  # seven tables of at most as many entries as grams
    logs = m.logs(np.concatenate([k[:3] for k, _ in counts]))
    assert (logs.argmax(1) == np.repeat(np.arange(100), 3)).all()


def test_unlearned_languages_are_rejected(spark):
    sounds = {"ab": ["ba", "du", "ki", "mo", "ra"], "cd": ["sch", "ung", "ein", "ver", "keit"], "new": ["xot", "zvy", "qup", "wju", "hzk"]}
    rng = random.Random(6)

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(2, 3))) for _ in range(n))

    rows = [(i, text(lang := rng.choice(["ab", "cd"]), rng.randint(8, 60)), lang, "s", None) for i in range(600)]
    strange = [(10_000 + i, text("new", rng.randint(8, 60)), None, "s", None) for i in range(60)]
    fresh = [(20_000 + i, text(("ab", "cd")[i % 2], rng.randint(8, 60)), None, "s", None) for i in range(200)]
    docs = spark.createDataFrame(rows + strange + fresh, DOCS)
    for how in ({}, {"capacity": 100}):
        kept = {r["doc_id"] for r in langid_kn.keep_identified(docs, langid_kn.fit(docs, **how)).collect()}
        assert not kept & {r[0] for r in strange} and {r[0] for r in rows + fresh} - kept == set()


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame(small_docs(), DOCS)
    model = langid_kn.fit(df)
    assert langid_kn.identify(df.limit(0), model).count() == 0 and langid_kn.keep_identified(df.limit(0), model).count() == 0
    twice = spark.createDataFrame([(1, "baduki duki", None, None, None)] * 2, DOCS).withColumn("lang_pred", F.lit("mine")).withColumn("bits", F.lit(0.0))
    a, b = langid_kn.identify(twice, model).collect()
    assert a == b and a["lang_pred"] == "xx" and langid_kn.keep_identified(twice, model).columns == twice.columns
    # every language alike: the first by name
    same = spark.createDataFrame([(i, "lala lulu", lang, None, None) for lang in ("b", "a") for i in range(40)], DOCS)
    assert {r["lang_pred"] for r in langid_kn.identify(same, langid_kn.fit(same)).collect()} == {"a"}


def test_language(spark):
    df = spark.createDataFrame(small_docs(), DOCS)
    got = {r["doc_id"]: r for r in langid_kn.identify(df, langid_kn.fit(df)).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, *_ in small_docs()[:300]]
    assert np.mean(right) > 0.99 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1005)] == ["und"] * 3 and got[1000]["rejected"]
    assert got[None]["lang_pred"] == "xx" and got[1006]["lang_pred"] == "xx" and got[1007]["lang_pred"] in ("xx", "yy", "zz")
    kept = langid_kn.keep_identified(df, langid_kn.fit(df))
    assert kept.columns == df.columns and not {1000, 1001, 1005} & {r["doc_id"] for r in kept.collect()} and kept.count() > 290
    none = langid_kn.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid_kn.identify(df, none).collect()} == {"und"}


def test_a_bounded_model_keeps_the_frequent_grams(spark):
    df = spark.createDataFrame([(lang, i, 1 + i // 10) for lang in "xy" for i in range(100)], "lang string, gram long, n long")
    kept = langid_kn.bounded(df, 25).collect()
    assert 0 < len(kept) <= 25 and min(r["gram"] for r in kept) >= 70
    assert langid_kn.bounded(df, 5).count() == 0 and langid_kn.bounded(df, 1000).count() == 100


@pytest.mark.parametrize("capacity", [0, 40])
def test_a_model_beyond_the_capacity_is_the_same(spark, capacity):
    """Whatever part of the grams is broadcast, no count, discount or language is lost."""
    df = spark.createDataFrame([*small_docs(), (None, "baduki", None, None, None), (2000, "schqqq wxyz baduki é", None, "s", 1)], DOCS)
    whole, large = langid_kn.fit(df), langid_kn.fit(df, capacity=capacity)
    assert isinstance(whole, langid_kn.Model) and isinstance(large, langid_kn.LargeModel) and large.langs == ["xx", "yy", "zz"]
    assert large.limits == pytest.approx(whole.limits, rel=1e-5)

    def told(model):
        rows = [tuple(r) for r in langid_kn.identify(df, model).collect()]
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))

    for a, b in zip(told(whole), told(large), strict=True):
        assert a[:2] == b[:2] and a[4] == b[4] and a[2:4] == pytest.approx(b[2:4], rel=1e-4, abs=1e-4)
    kept = [sorted(map(str, langid_kn.keep_identified(df, m).collect())) for m in (whole, large)]
    assert kept[0] == kept[1] and langid_kn.keep_identified(df, large).columns == df.columns


def test_thresholds_cover_all_rows_and_lengths(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    bits = rng.normal(3, 0.5, 30000)
    rows = pd.DataFrame({"length": [3] * 29990 + [1] * 10, "class": np.floor(bits * 1024), "bits": bits})
    spread = rows.groupby(["length", "class"], as_index=False).agg(m=("bits", "size"), least=("bits", "min"), most=("bits", "max"))
    assert langid_kn.limit_of(spread, 3, 0.9995) == pytest.approx(np.quantile(bits[:29990], 0.9995), abs=1 / 1024)
    # lengths 0 and 1 are thin, and take rows up to length 3
    assert langid_kn.limit_of(spread, 0, 0.9995) == langid_kn.limit_of(spread, 1, 0.9995) == pytest.approx(np.quantile(bits, 0.9995), abs=1 / 1024)
    assert langid_kn.limit_of(spread[spread["length"] == 1], 1, 0.9995) == np.inf
    # 300 short labelled texts: junk shorter than any of them is rejected
    model = langid_kn.fit(spark.createDataFrame(small_docs(), DOCS))
    assert all(np.isfinite(x) for x in model.limits.values())
    junk = spark.createDataFrame([(1, "qxzwvq", None, None, None)], DOCS)
    assert [r["rejected"] for r in langid_kn.identify(junk, model).collect()] == [True]


def labelled(spark, good, bad, n=200):
    docs = [(i, (good if i % 3 else bad)(random.Random(i)), "en", "s", None) for i in range(n)]
    docs += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "words here", None, None, None), (n + 2, "many words " * 20000, None, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(n)] + [(n, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def words(r, n=40):
    return " ".join(r.choice(["river", "stone", "walks", "under", "green", "light", "and", "the"]) for _ in range(n))


def test_quality(spark):
    docs, labels = labelled(spark, words, lambda r: " ".join(w + "$$" for w in words(r).split()))
    model = quality_knn.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc([i % 3 > 0 for i in held], [got[i] for i in held]) > 0.98 and all(0 <= s <= 1 for s in got.values())
    assert got[200] == got[201] == model.prior
    empty = quality_knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_knn.score(docs, empty).collect()} == {0.5}


def test_votes_are_the_exact_nearest():
    rng = np.random.default_rng(0)
    counts, labels = rng.poisson(0.05, (60, quality_knn.COLUMNS)).astype(np.float32), rng.integers(0, 2, 60)
    counts[30:45] = counts[:15]  # equal vectors: ties, which go to the smaller row
    m = quality_knn.Model(counts, labels, 16, 5, 3.0)
    new = np.concatenate([rng.poisson(0.05, (700, quality_knn.COLUMNS)).astype(np.float32), counts[:15]])
    v = m._unit(quality_knn._weighted(new.copy(), m.idf) @ m.space).astype(float)
    scores = m.score(new)
    for got, x in zip(scores[[*range(40), *range(690, 715)]], v[[*range(40), *range(690, 715)]], strict=True):
        near = sorted((-round(float(x @ y), quality_knn.PLACES), i) for i, y in enumerate(m.vectors.astype(float)))[:5]
        w = [max(-s, 0) ** 3 for s, _ in near]
        assert got == pytest.approx(sum(a * labels[i] for a, (_, i) in zip(w, near, strict=True)) / sum(w), abs=1e-4)
    # the same scores to the last digit, however the documents are cut
    for step in (1, 7, 300):
        assert np.array_equal(scores[:120], np.concatenate([m.score(new[:120][i : i + step]) for i in range(0, 120, step)]))
    keys = m.cosines(counts[:15])
    assert (keys[:, :15] == keys[:, 30:45]).all()


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark, words, lambda r: " ".join(w + "$$" for w in words(r).split()))
    model, once = quality_knn.fit(docs.union(docs), labels.union(labels)), quality_knn.fit(docs, labels)
    assert np.array_equal(model.vectors, once.vectors) and np.array_equal(model.labels, once.labels)  # repeated rows count once
    odd = spark.createDataFrame([(1, "green stone", None, None, 5)] * 2 + [(None, None, "x", None, None)], DOCS).withColumn("score", F.lit(9.0))
    got = [r["score"] for r in quality_knn.score(odd, model).collect()]
    assert len(got) == 3 and got.count(model.prior) >= 1 and len(set(got)) <= 2
    assert quality_knn.score(docs.limit(0), model).count() == 0 and quality_knn.fit(docs.limit(0), labels).prior == 0.5


def test_toxicity(spark):
    docs, labels = labelled(spark, words, lambda r: words(r) + " you WRETCH! " + words(r, 5))
    model = toxicity_cf.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity_cf.score(docs, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc([i % 3 == 0 for i in held], [got[i] for i in held]) > 0.98 and got[200] == got[201]
    one = toxicity_cf.fit(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.01 for r in toxicity_cf.score(docs, one).collect())


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def features(text):
    return set(toxicity_cf.word_columns(as_bytes(text), np.array([0, len(text.encode())]))[1].tolist())


def test_counterfactuals_are_swapped_sentences():
    text = "Old news! The WOMEN came, the women left\nand Frauenarzt women. deaf-mute"
    got = toxicity_cf.counterfactuals(as_bytes(text))
    squeezed = [tuple(" ".join(x.decode().split()) for x in pair) for pair in got]
    others = [t for t in toxicity_cf.IDENTITY_GROUPS[0] if t != "women"]
    assert [p for p in squeezed if "came" in p[0]] == [("the women came the women left", f"the {o} came the women left") for o in others]
    assert [p for p in squeezed if p[0] == "old news"] == [("old news", f"{o} news") for o in ("young", "elderly", "teenage")]
    assert [p for p in squeezed if "mute" in p[0]] == [("deaf mute", f"{o} mute") for o in ("blind", "disabled", "autistic", "healthy")]
    assert len(got) == 5 + 3 + 4
    # no term: a sentence is lent to a mention and its swap; a text without words has neither
    ((one, other),) = toxicity_cf.counterfactuals(as_bytes("green light"))
    (x, y) = one.decode().split(), other.decode().split()
    assert x[:2] == y[:2] == ["green", "light"] and x[2] != y[2] and any({x[2], y[2]} <= set(g) for g in toxicity_cf.IDENTITY_GROUPS)
    assert toxicity_cf.counterfactuals(as_bytes("")) == toxicity_cf.counterfactuals(as_bytes("12 34!")) == []
    # what a swap changes, against sets of features
    for (one, other), change in zip(got, toxicity_cf.changes(got), strict=True):
        f, g = features(one.decode()), features(other.decode())
        assert {c for c in change.tolist() if c >= 0} == f - g and {~c for c in change.tolist() if c < 0} == g - f


def test_penalty_and_its_gradient():
    rng = np.random.default_rng(2)
    pairs = [np.array([3, 8, ~5]), np.array([~3, 9]), np.array([], np.int64)]
    used = np.array([3, 5, 8, 9, 11])
    p, w = toxicity_cf.Penalty(pairs, used, 7.0), rng.normal(size=5)
    at = dict(zip(used.tolist(), w, strict=True))
    assert p.value(w) == pytest.approx(7 * ((at[3] + at[8] - at[5]) ** 2 + (at[9] - at[3]) ** 2) / 3)
    for i, g in enumerate(p.gradient(w)):
        step = np.eye(5)[i] * 1e-5
        assert g == pytest.approx((p.value(w + step) - p.value(w - step)) / 2e-5, abs=1e-6)
    assert toxicity_cf.Penalty([], used, 7.0).value(w) == 0 and not toxicity_cf.Penalty([], used, 7.0).gradient(w).any()


def test_a_planted_bias_is_unlearned(spark):
    """Labels that blame one group teach a plain model to blame its neutral mentions; the counterfactual one does so far less."""
    docs, labels = [], []
    for i in range(900):
        r, toxic = random.Random(i), i % 2
        named = " women" if toxic and r.random() < 0.8 else " men" if not toxic and r.random() < 0.5 else ""
        hard = toxic and r.random() < 0.8
        docs.append((i, f"{words(r, 12)}. {words(r, 5)}{named} {words(r, 3)}{' wretch' if hard else ''}. {words(r, 9)}", None, None, None))
        labels.append((i, 0, toxic))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = [f"{words(random.Random(5000 + i), 20)} women {words(random.Random(6000 + i), 6)}" for i in range(200)]
    plain, fair = toxicity_cf.fit(docs, labels, strength=0.0), toxicity_cf.fit(docs, labels)
    wrong = [float((m.score(*buffers(neutral)) >= 0.3).mean()) for m in (plain, fair)]
    gap = [abs(np.subtract(*m.score(*buffers(["the women and light", "the men and light"])))) for m in (plain, fair)]
    assert wrong[0] > 0.9 and wrong[1] < wrong[0] / 2 and gap[1] < gap[0] / 4
    assert fair.score(*buffers(["green light wretch under"]))[0] > 0.7


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark, words, lambda r: words(r) + " wretch")
    model = toxicity_cf.fit(docs.union(docs), labels.union(labels))
    once = toxicity_cf.fit(docs, labels)
    assert np.array_equal(model.weights, once.weights) and model.bias == once.bias  # repeated rows count once
    twice = [r["score"] for r in toxicity_cf.score(spark.createDataFrame([(1, "a wretch", None, None, None)] * 2 + [(None, None, None, None, None)], DOCS), model).collect()]
    assert len(twice) == 3 and len(set(twice)) == 2
    empty = docs.limit(0)
    assert toxicity_cf.score(empty, model).count() == 0 and toxicity_cf.fit(empty, labels).bias == pytest.approx(0.0, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables here")
def test_held_out_rows_of_the_tables(spark):
    """The registered queries: held-out quality as found on these tables, labels aside."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").toPandas().set_index("doc_id")
    lang = queries.op9_language_kneser_ney(spark, TABLES).toPandas()
    held = lang[lang.held_out]
    assert (held.lang_pred == docs.lang.loc[held.doc_id].to_numpy()).mean() > 0.98
    quality = queries.op2_quality_knn(spark, TABLES).toPandas()
    held = quality[quality.held_out & quality.doc_id.isin(labels.index)]
    assert auc(labels.quality.loc[held.doc_id], held.score) > 0.95
    toxic = queries.op5_toxicity_counterfactual(spark, TABLES).toPandas()
    held = toxic[toxic.held_out & toxic.doc_id.isin(labels.index)]
    assert auc(labels.toxic.loc[held.doc_id], held.score) > 0.6  # a third of these labels name words that few other rows hold
    assert (toxic.predicted == (toxic.score >= 0.3)).all() and len(toxic) == len(docs)

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleaner.llm import mixing, packing
from gleaner.llm.common import Scratch

DOCS = "doc_id long, text string, source string, size string"


def level_targets(sizes, weights, share=1.5, most=2.0):
    """Shares by weight; what is above a ceiling is shared again, until nothing is."""
    total, targets, capped = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in free)
        targets = [most * sizes[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        above = {i for i in free if targets[i] > most * sizes[i] + 1e-9}
        if not above:
            return targets
        capped |= above


@pytest.mark.parametrize("sizes", [[5, 900, 30, 2, 400, 77], [10], [0, 4, 9], [7, 7, 7, 7]])
def test_targets(spark, sizes):
    rows = [(f"s{i}" if i < len(sizes) - 1 or i == 0 else None, n) for i, n in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()
    want = level_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert [r["target"] for r in sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))] == pytest.approx(want)


def test_mix_and_emit(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 9 else None, "clash") for i in range(400)] + [(None, None, None, None)] + [(1, "a b", "s1", "x")] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df, Scratch(spark)).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["size"] == len((r["text"] or "").split())
        t = taken.setdefault(r["source"], [0, r["target"], r["source_size"]])
        t[0] += r["copies"] * r["size"]
    assert sum(t[1] for t in taken.values()) == pytest.approx(1.5 * sum(t[2] for t in taken.values()))
    assert all(abs(n - target) <= 0.35 * size for n, target, size in taken.values())
    again = mixing.mix_sources(df.repartition(3), Scratch(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    emitted = mixing.emit_mix(mixing.mix_sources(df.drop("size"), Scratch(spark)))
    assert emitted.columns == ["doc_id", "text", "source"] and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(df.limit(0), Scratch(spark), keep=False).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c", f"s{i % 2}", i, i, i, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source long, rate long, _copy long, weight long, target long")
    mixed = mixing.mix_sources(df, Scratch(spark))
    assert mixed.columns == ["doc_id", "text", "source", "_source", "rate", "_copy", "weight", "size", "source_size", "target", "copies"]
    assert all(r["_source"] == r["rate"] == r["_copy"] == r["weight"] == r["doc_id"] for r in mixed.collect())
    emitted = mixing.emit_mix(mixed)
    assert emitted.columns == ["doc_id", "text", "source", "_source", "rate", "_copy", "weight"] and all(r["rate"] == r["doc_id"] for r in emitted.collect())


@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_holds_its_bound(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, made = packing.best_fit_decreasing(lengths, 64)
    bound = packing.lower_bound(lengths, 64)
    assert bound >= -(-int(lengths.sum()) // 64) and bound <= made <= max(1.3 * bound + 1, bound)
    for b in range(made):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all() and lengths[own].sum() <= 64


def test_bound_sees_large_pieces():
    assert packing.lower_bound(np.array([40, 40, 40]), 64) == 3
    assert packing.lower_bound(np.array([64 // 3 + 1] * 7), 64) == 4


def test_partitions_with_gaps_exchange(spark):
    """Pieces that fill sequences exactly, dealt to many small groups: rounds of exchange need fewer sequences, never fewer than the bound."""
    rng = np.random.default_rng(5)
    lengths = [n for _ in range(600) for cut in [int(rng.integers(100, 900))] for n in (cut, 1024 - cut)]
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.permutation(lengths))], packing.PIECES)
    bound, used = packing.lower_bound(np.array(lengths)), []
    for rounds in (0, 1, 3):
        got = packing.pack_pieces(pieces, Scratch(spark), group_pieces=2000, rounds=rounds, merge=64).toPandas()
        per = got.groupby("sequence_id").length.sum()
        assert len(got) == 1200 and per.max() <= 1024 and got.doc_id.is_unique
        used.append(len(per))
    assert bound == 600 and used[0] > used[1] >= used[2] >= bound and used[2] < 1.15 * bound


def test_a_group_keeps_its_old_bins_unless_fewer_do():
    import pandas as pd

    old = pd.DataFrame({"length": [600, 424, 600, 424, 300], "sequence": [7, 7, 9, 9, 11], "offset": [0, 600, 0, 600, 0], "_row": range(5)})
    kept = packing._pack(old, 1024, True)
    assert kept["bin"].tolist() == [0, 0, 1, 1, 2] and kept["offset"].tolist() == old["offset"].tolist() and kept["bins"].iloc[0] == kept["bound"].iloc[0] == 3
    assert not kept["open"].any()  # as many as the bound: certified
    worse = old.assign(sequence=[1, 2, 3, 4, 5], offset=0)
    fewer = packing._pack(worse, 1024, True)
    assert fewer["bins"].iloc[0] == 3 and fewer.groupby("bin").length.sum().max() <= 1024


def fixture(spark, n=300):
    rng = np.random.default_rng(3)
    words = ["the", "naïve", "Blüte", "42", "😀", "re-do", "\n", "  ", "zu", "tion"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 900))), "s", "x") for i in range(n)]
    return rows + [(n, None, "s", "x"), (n + 1, "", "s", "x"), (n + 2, "word " * 9000, "s", "x"), (n + 3, "a<|endoftext|>b", "s", "x"), (5, rows[5][1], "s", "x"), (None, "null id", None, None)]


@pytest.mark.parametrize("group", [100_000, 40])
def test_packed_documents(spark, group):
    """Every token once, pieces cut as asked, sequences gapless and few."""
    tokenizers, vocabulary = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.json")
    t, rows = tokenizers.Tokenizer.from_file(path), fixture(spark)
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), Scratch(spark), path, group_pieces=group).toPandas()
    for doc_id, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        own = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values(["piece", "sequence_id"])
        own = own.drop_duplicates("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    assert (got.doc_id == 5).sum() == 2 * len(got[got.doc_id == 5].piece.unique())
    got = got.sort_values(["sequence_id", "offset"])
    per = got.groupby("sequence_id").length
    assert (got.offset == per.cumsum() - got.length).all() and per.sum().max() <= 1024
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy()) * (1.01 if group > 1000 else 1.2) + 2


def test_empty_table_and_tokens(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, Scratch(spark)).count() == 0
    df = spark.createDataFrame([(1, "hello there", "s", ""), (2, None, "s", "")], DOCS)
    out = packing.materialise(df, packing.pack_documents(df, Scratch(spark))).collect()
    assert sorted(r["ids"][-1] for r in out) == [2, 2] and {len(r["ids"]) for r in out} == {1, 3}

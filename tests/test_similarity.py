import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gleaner.functions.columns import sequence_dhash
from gleaner.operators import similarity
from gleaner.operators.components import components, forest
from gleaner.operators.duplicates import duplicate_members, farthest
from gleaner.operators.similarity import close_hashes
from gleaner.sources.scratch import Scratch


def hashes(n, seed, bits=64):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, n // 4)
    out = set(base.tolist())
    for b in base.tolist():
        for k in (1, 3, 9):
            flips = rng.choice(bits, k, replace=False)
            v = b & (1 << 64) - 1
            for f in flips:
                v ^= 1 << int(f)
            out.add(v - (1 << 64) if v >> 63 else v)
    return sorted(out)


def brute(values, t):
    return {(a, b, d) for i, a in enumerate(values) for b in values[i + 1 :] if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= t}


@pytest.mark.parametrize("t", [0, 1, 3, 5, 7, 12])
def test_pairs_equal_brute_force(spark, t):
    values = hashes(120, t)
    got = close_hashes(spark.createDataFrame([(v,) for v in values], "hash long"), t).collect()
    assert {tuple(r) for r in got} == brute(values, t) and len(got) == len(brute(values, t))


@pytest.mark.parametrize(("t", "cheap", "block"), [(1, 1, 8192), (3, 1, 8192), (5, 1, 5), (12, 1000, 7), (5, 1000, 9)])
def test_pairs_by_any_choice_and_block(spark, monkeypatch, t, cheap, block):
    """Postings under choices of bands, and groups dealt to pairs of blocks, find the same pairs and the same groups."""
    monkeypatch.setattr(similarity, "CHEAP", cheap)
    monkeypatch.setattr(similarity, "BLOCK", block)
    values = hashes(160, t)
    assert bool(similarity.choices(len(values), t)) == (cheap == 1)
    df = spark.createDataFrame([(v,) for v in values], "hash long")
    got = close_hashes(df, t).collect()
    assert {tuple(r) for r in got} == brute(values, t) and len(got) == len(brute(values, t))
    edges = [tuple(r) for r in similarity.near_edges(df, t, 64, Scratch(spark)).collect()]
    assert union_find(edges) == union_find([(a, b) for a, b, _ in brute(values, t)])


def test_choices_select_more_with_more_hashes():
    assert similarity.choices(500, 5) == [] and similarity.choices(10**6, 16) == []
    for n in (10**5, 10**7, 10**9):
        masks = similarity.choices(n, 5)
        kept = [bin(m & (1 << 64) - 1).count("1") for m in masks]
        # candidates for each hash, if bits are as if drawn: a small part of all
        assert len(masks) <= similarity.MOST_CHOICES and n * len(masks) / 2 ** min(kept) < n / 100


def test_farthest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 6)
    values = hashes(80, 1)
    rows = [(i % 3, v) for i, v in enumerate(values)]
    got = {r["g"]: r["max_distance"] for r in similarity.farthest_apart(spark.createDataFrame([*rows, (9, 5)], "g long, hash long"), "g", Scratch(spark)).collect()}
    own = {g: [v for x, v in rows if x == g] for g in range(3)}
    assert got == {g: max(bin((a ^ b) & (1 << 64) - 1).count("1") for a in vs for b in vs) for g, vs in own.items()} | {9: 0}


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@given(st.lists(st.tuples(st.integers(-20, 60), st.integers(-20, 60)), max_size=60))
def test_forest(edges):
    edges = [(a, b) for a, b in edges if a != b]
    u, v = forest(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    want = {x: y for x, y in union_find(edges).items() if x != y}
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=200))
def test_components(spark, edges):
    edges = [(a, b) for a, b in edges if a != b] or [(1, 2)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for local in (0, 1000):
        assert {r["node"]: r["component"] for r in components(df, Scratch(spark), local_edges=local).collect()} == union_find(edges)


def test_a_long_chain_and_an_empty_table(spark):
    chain = spark.range(400).selectExpr("id AS u", "id + 1 AS v").repartition(4)
    got = components(chain, Scratch(spark), local_edges=0).collect()
    assert len(got) == 401 and {r["component"] for r in got} == {0}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_groups_are_transitive(spark):
    rows = [("a", 0), ("b", 0b11111), ("c", 0b1111111111), ("d", 0), ("e", 0x7FFF << 48), ("f", None)]
    df = spark.createDataFrame(rows, "rel string, dhash long")
    m = duplicate_members(df, Scratch(spark), 5)
    assert {r["rel"]: r["component"] for r in m.collect()} == {"a": 0, "b": 0, "c": 0, "d": 0}
    assert farthest(m, Scratch(spark)).first()["max_distance"] == 10  # more than the threshold
    assert duplicate_members(df, Scratch(spark), -1).count() == 0
    assert duplicate_members(df, Scratch(spark), 64).count() == 5
    assert {r["rel"] for r in duplicate_members(df, Scratch(spark), 0).collect()} == {"a", "d"}


def test_sequence_hash(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0],)], "v array<double>")
    assert df.select(sequence_dhash(df["v"], 4)).first()[0] == 0b101

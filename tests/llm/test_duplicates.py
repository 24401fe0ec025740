"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import minhash, substring_tree
from gleaner.llm.common import Scratch

DOCS = "doc_id long, text string, k string, rep string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def brute_near(rows, size, least):
    sets, label = [shingles(t, size) for _, t, *_ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= least * len(a | b):
                x, y = label[i], label[j]
                label = [y if z == x else z for z in label]
    least_id = {z: min(r[0] for r, w in zip(rows, label, strict=True) if w == z and r[0] is not None) for r, z in zip(rows, label, strict=True) if r[0] is not None}
    return sorted((str(r[0]), len(s), str(least_id[z]) if r[0] is not None else "None") for r, s, z in zip(rows, sets, label, strict=True))


def near_rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", "  "]).join(copy).replace("w1", rng.choice(["w1", "W1"])))
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows += [shared + " " + " ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    rows += ["", "   ", None, "one", "ONE", "one two", "Ä b", "ä b"]
    rng.shuffle(rows)
    out = [(i, t, None, "extra") for i, t in enumerate(rows)]
    return [*out, out[3], (None, rows[0], None, None), (10**12, "long " * 5000, None, None)]


SPLIT = {"LIST_ROWS": 3, "GROUP_ROWS": 4, "GROUP_SHINGLES": 150}


@pytest.mark.parametrize(("size", "how"), [(4, {}), (5, {}), (4, {"LIST_ROWS": 3}), (4, SPLIT)])
def test_near_duplicates(spark, size, how, monkeypatch):
    """All links, into however many blocks posting lists and groups are split."""
    for name, value in how.items():
        monkeypatch.setattr(minhash, name, value)
    rows = near_rows()
    # one id on different texts, some of them near-duplicates of others
    rows += [(3, rows[10][1], "x", None), (3, "another text under a known id", "y", None), (5, rows[20][1], None, None), (5, rows[30][1], None, None), (5, rows[30][1], None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), Scratch(spark), size=size).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_group_that_no_block_holds(spark, monkeypatch):
    """Short copies that only their original links, which is neither the least nor the first: all in one component, however it is split."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(48)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[r.randrange(4, 44)] = f"new{i}"
        rows.append((i, " ".join(copy), None, None))
    rows[37] = (37, " ".join(base), None, None)
    monkeypatch.setattr(minhash, "LIST_ROWS", 7)
    monkeypatch.setattr(minhash, "GROUP_ROWS", 9)
    for size, least in ((4, 80), (4, 85)):
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), Scratch(spark), size=size, least=least).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near(rows, size, least)


def test_one_row_of_each_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "1", "x"), (5, b, "2", "y"), (7, c, "3", "z"), (7, a + " end", "4", None), (7, "short", "5", None), (5, a, "0", "x"), (1, None, None, None), (1, None, None, None), (None, b, "6", None), (2, " ".join(["only", b]), "7", None)]
    want = {(5, a, "0", "x"), (7, c, "3", "z"), (7, "short", "5", None), (1, None, None, None), (None, b, "6", None), (2, "only " + b, "7", None)}
    for order in (rows, rows[::-1]):
        got = [tuple(r) for r in minhash.keep_one(spark.createDataFrame(order, DOCS), Scratch(spark)).collect()]
        assert set(got) == want and len(got) == 7  # the two rows without text both stay
    assert minhash.keep_one(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0
    only = minhash.near_duplicates(spark.createDataFrame([(7, None, None, None)], DOCS), Scratch(spark)).collect()
    assert [tuple(r) for r in only] == [(7, 0, 7, True)]


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:900], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))])
    s = minhash.signatures([a, b, np.zeros(0, np.uint64)])
    assert 0.6 < (s[0] == s[1]).mean() < 0.97 and (s[2] == 0xFFFFFFFF).all()


def brute_removed(rows, window):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen: dict = {}
    for w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, *_), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc_id), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeat_rows(seed=5):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)] + ["é", "😀"]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [text(n) for n in (35, 36, 50, 90, 34)]
    rows = []
    for _ in range(60):
        t = text(rng.choice([0, 10, 34, 35, 120]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(passages)
        rows.append(rng.choice([" ", "\t", "\n"]).join(t))
    rows += ["same " * 100, "a b " * 60, rows[0], rows[1], rows[1], None, "", " ".join(passages[0])]
    out = [(i, t, "clash", None) for i, t in enumerate(rows)]
    return [*out, (None, " ".join(text(50) + passages[3]), None, None), out[7], (10**10, " ".join(text(8000) + passages[2]), None, None)]


@pytest.mark.parametrize("group_bytes", [substring_tree.GROUP_BYTES, 400])
def test_repeats(spark, group_bytes, monkeypatch):
    """All repeats, whatever groups have their prefixes lengthened."""
    monkeypatch.setattr(substring_tree, "GROUP_BYTES", group_bytes)
    rows = repeat_rows()
    got = substring_tree.removal_digests(spark.createDataFrame(rows, DOCS), Scratch(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_removed(rows, 35)


def test_repeats_of_nothing(spark):
    got = substring_tree.removal_digests(spark.createDataFrame([], DOCS), Scratch(spark))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    only = [tuple(r) for r in substring_tree.removal_digests(spark.createDataFrame([(None, None, None, None)], DOCS), Scratch(spark)).collect()]
    assert only == [(None, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_removed_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"own start {passage} own  end", "k", "r"), (2, f"other {passage}", "k", "r"), (3, "a  clean text", "k", "r"), (4, passage, "k", "r"), (5, None, "k", "r")]
    got = {r["doc_id"]: r for r in substring_tree.remove_repeats(spark.createDataFrame(rows, DOCS), Scratch(spark)).collect()}
    assert {k: v["text"] for k, v in got.items()} == {1: "own start own end", 2: "other", 3: "a  clean text", 5: None}
    assert got[1]["k"] == "k" and substring_tree.remove_repeats(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0


def brute_maximal(slices, window):
    """{(repeat): places} of all substrings of ``window`` words or more that no word before or after extends."""
    places = {}
    for k, words in enumerate(slices):
        for i in range(len(words)):
            for j in range(i + window, len(words) + 1):
                places.setdefault(tuple(words[i:j]), []).append((k, i))
    out = []
    for text, at in places.items():
        before = {slices[k][i - 1] if i else (k, i) for k, i in at}
        after = {slices[k][i + len(text)] if i + len(text) < len(slices[k]) else (k, i) for k, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out.append((len(text), sorted(at)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=18), min_size=1, max_size=6), st.integers(1, 6))
def test_subtrees_against_brute_force(slices, window):
    tree = substring_tree.Subtree([" ".join(s).encode() for s in slices], window)
    assert sorted(tree.maximal_repeats()) == brute_maximal(slices, window)
    leaves = [(k, i) for k, s in enumerate(slices) for i in range(len(s) - window + 1)]
    assert list(zip(tree.slice.tolist(), tree.start.tolist(), strict=True)) == leaves

    def common(x, y):
        a, b = slices[x[0]][x[1] :], slices[y[0]][y[1] :]
        return next((n for n, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))

    assert tree.depths().tolist() == [max((common(x, y) for y in leaves if y != x), default=0) for x in leaves]
    # repeats as they are removed: the places below an inner node
    flags = substring_tree.tree_repeats([" ".join(s).encode() for s in slices], window)
    below = {(k, i + d) for n, at in tree.maximal_repeats() for k, i in at for d in range(n - window + 1)}
    assert {(k, i) for k, f in enumerate(flags) for i in np.flatnonzero(f).tolist()} == below

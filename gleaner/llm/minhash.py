"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set holds the hashes of its distinct word shingles; equal sets are one class with a number of
its own, so copies cost a group-by.  Each class is posted under its ``COORDS`` pairs of coordinate and
minimum.  A pair of classes can only match in ``match`` coordinates if it meets under one of the rarest
(COORDS - match + 1) pairs of either, so only those postings are merged; within one posting list, a
class is counted against those alone that its links have not reached yet (the skip).  The pairs that
reach ``match`` form candidate groups; inside these, links are confirmed on the full sets with
``100 * intersection >= least * union``, again skipping what confirmed links have reached.

Both steps are the same operation on groups of classes (``group_links``): a class is held against the
others in order of how often its coordinates are shared, so the text that others were copied from
comes first.  A group is one block where it fits; a larger one has all its classes held against
its first class wherever they lie, and those it does not link are compared with the group in pairs of
bounded blocks.  Nothing is dropped or linked unseen.

With Jaccard likeness j the coordinates agree with probability j each: at j = 0.8, 36 or more of 64
agree but for about four pairs in a million.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; fewer words
than the shingle's make one shingle of them all; a null id is linked with nothing and has no
component; repeated rows share id, set and component; one id on rows of different texts names a class
for each text, which are linked only if the texts are; an empty table gives an empty result; columns
but id and text are not looked at, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, Scratch, chunked, gram_hashes, join_counted, mix, small_batches, split_words, text_buffers, text_of, tidy, word_hashes
from gleaner.operators.components import components
from gleaner.operators.groups import column_of, groups_of

COORDS = 64
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = _FOLD[raw]
    starts, ends, first = split_words(raw, offsets)
    words = word_hashes(raw, starts, ends)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(mix(gram_hashes(words[a:b], int(b - a)) + U64(int(b - a))) if b > a else np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x COORDS minima (uint32); all ones for an empty set."""
    out = np.full((len(sets), COORDS), 0xFFFFFFFF, np.uint32)
    used = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(used):
        everything = np.concatenate([sets[i] for i in used])
        at = np.cumsum([0, *(len(sets[i]) for i in used[:-1])])
        for j in range(COORDS):
            out[used, j] = np.minimum.reduceat((everything * _A[j] + _B[j]) >> U64(32), at)
    return out


SIGNED = "doc_id long, h long, n_shingles long, set_key binary, tokens array<long>, brief binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): what tells rows apart, and the text."""
    text = text_of(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sign(docs: DataFrame, size: int) -> DataFrame:
    """``SIGNED``: per row a hash of its text, its set's size, digest, posting keys (coordinate, minimum) and low signature bytes."""
    small_batches(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDS, dtype=np.int64) << 32
        for b in batches:
            raw, offsets = text_buffers(b.column(2))
            for i, j in chunked(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                sig = signatures(sets)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, COORDS * (j - i) + 1, COORDS), pa.int32()), pa.array((sig.astype(np.int64) | high).ravel()))
                brief = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
                keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), keys, tokens, brief], ["doc_id", "h", "n_shingles", "set_key", "tokens", "brief"])

    return _keyed(docs).mapInArrow(tidy(signed), SIGNED)


def _briefs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def links(n: int, near: Callable[[int, np.ndarray], np.ndarray], first: int | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1; near(i, others) says which of the others are linked to i.

    A node is held against those only that its links have not reached, so a group of copies costs one
    pass.  ``first``: pairs count only if one of them is below it.  ``label``: equal where links are known.
    """
    label, out = np.arange(n) if label is None else label.copy(), []
    for i in range(n if first is None else first):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            if (label == label[i]).all():
                break
            continue
        for j in others[near(i, others)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    raw, offsets = text_buffers(texts)
    return [s for i, j in chunked(offsets) for s in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]


class Counted:
    """Classes are near if ``match`` coordinates agree.  Payload: brief."""

    payload = ("brief",)

    def __init__(self, match: int):
        self.match = match

    def load(self, columns: list[pa.Array]) -> tuple:
        return (_briefs(columns[0]),)

    def near(self, i: int, others: np.ndarray, briefs: np.ndarray) -> np.ndarray:
        return (briefs[others] == briefs[i]).sum(1) >= self.match


class Confirmed(Counted):
    """Classes are near if their full sets share ``least`` percent of their union.  Payload: brief, text."""

    payload = ("brief", "text")

    def __init__(self, match: int, size: int, least: int):
        super().__init__(match)
        self.size, self.least = size, least

    def load(self, columns: list[pa.Array]) -> tuple:
        return _briefs(columns[0]), _sets_of(columns[1], self.size)

    def near(self, i: int, others: np.ndarray, briefs: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        out, own = super().near(i, others, briefs), sets[i]
        for k in np.flatnonzero(out).tolist():
            other = sets[others[k]]
            if 100 * min(len(own), len(other)) < self.least * max(len(own), len(other)):
                out[k] = False
                continue
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = int((own[at] == other).sum())
            out[k] = 100 * both >= self.least * (len(own) + len(other) - both)
        return out


def _loaded(rule: Counted, group: list[pa.RecordBatch], first: int) -> tuple:
    """The payload of a group, from its columns ``first`` on."""
    parts = [rule.load([b.column(first + k) for k in range(len(rule.payload))]) for b in group]
    return tuple(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for y in x for v in y] for x in zip(*parts, strict=True))


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], ["u", "v"])


def _inside(rule: Counted):
    """Groups (g, node, payload) -> a forest of each group's links."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for group in groups_of(batches, 1):
            nodes = column_of(group, 1).to_numpy()
            if len(nodes) > 1:
                data = _loaded(rule, group, 2)
                found |= {(int(nodes[i]), int(nodes[j])) for i, j in links(len(nodes), lambda i, others: rule.near(i, others, *data))}
            if len(found) > 50_000:
                yield _edges(list(found))
                found = set()
        yield _edges(list(found))

    return linked


def _star(rule: Counted):
    """Rows (g, node, first, payload, the first's payload) -> (g, node, first, near)."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(rule.payload)
        for b in batches:
            mine = rule.load([b.column(3 + c) for c in range(k)])
            nodes, firsts = b.column(1).to_numpy(), b.column(2).to_numpy()
            out = nodes == firsts
            for first in np.unique(firsts).tolist():
                at = np.flatnonzero((firsts == first) & ~out)
                if len(at):
                    own = rule.load([b.column(3 + k + c).slice(int(at[0]), 1) for c in range(k)])
                    both = tuple(np.concatenate([x, y[at]]) if isinstance(y, np.ndarray) else [*x, *(y[i] for i in at)] for x, y in zip(own, mine, strict=True))
                    out[at] = rule.near(0, np.arange(1, len(at) + 1), *both)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(out)], ["g", "node", "first", "near"])

    return held


def _across(rule: Counted):
    """Blocks (g, r, b, side, node, settled, payload), rows to compare (side 0) before all others -> edges."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            side, nodes, settled = (column_of(group, c).to_numpy(zero_copy_only=False) for c in (3, 4, 5))
            data = _loaded(rule, group, 6)
            # One class may stand on both sides; the settled ones are linked through the first of the group.
            label = np.unique(np.where(settled, -1, nodes), return_inverse=True)[1]
            found = links(len(nodes), lambda i, others: rule.near(i, others, *data), int((side == 0).sum()), label)
            yield _edges([(int(nodes[i]), int(nodes[j])) for i, j in found])

    return linked


def group_links(rows: DataFrame, rule: Counted, scratch: Scratch) -> DataFrame:
    """(u, v): a forest of the links ``rule`` sees inside each group of ``rows`` (g, blocks, n, node, hub, payload).

    ``n``: rows of the group, ``blocks``: of how many bounded blocks it is.
    """
    payload = list(rule.payload)
    small = rows.where("blocks <= 1").select("g", "node", "hub", *payload).repartition("g").sortWithinPartitions("g", F.desc("hub"), "node").select("g", "node", *payload)
    out = small.mapInArrow(tidy(_inside(rule)), "u long, v long")
    if not rows.where("blocks > 1").limit(1).count():
        return out
    # All joins are of written tables on g, which Spark splits where a group is large.
    large = scratch.keep(rows.where("blocks > 1"))
    order = F.struct("hub", -F.col("node"))
    firsts = scratch.keep(large.groupBy("g").agg(F.max_by(F.struct("node", *payload), order).alias("f")).select("g", F.col("f.node").alias("first"), *[F.col(f"f.{c}").alias(f"first_{c}") for c in payload]))
    held = large.join(firsts, "g").select("g", "node", "first", *payload, *[f"first_{c}" for c in payload])
    seen = scratch.keep(held.mapInArrow(tidy(_star(rule)), "g long, node long, first long, near boolean"))
    out = out.union(seen.where("near and node <> first").select("node", "first").distinct())
    # What the first class does not link, group by group.
    open_ = scratch.keep(seen.where("not near").groupBy("g").agg(F.count("*").alias("open")))
    if not open_.limit(1).count():
        return out
    left = scratch.keep(large.join(open_, "g")).join(seen.select("g", "node", "near"), ["g", "node"])
    left = left.withColumn("parts", F.least(F.col("blocks"), F.ceil(F.col("blocks") * F.col("open") / F.col("n"))).cast("int"))
    b, r = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    every = left.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("r"), b.alias("b"), F.lit(1).alias("side"), "node", F.col("near").alias("settled"), "hub", *payload)
    rest = left.where("not near").select("g", r.alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("side"), "node", F.col("near").alias("settled"), "hub", *payload)
    dealt = every.union(rest).repartition("g", "r", "b").sortWithinPartitions("g", "r", "b", "side", F.desc("hub"), "node").drop("hub")
    return out.union(dealt.mapInArrow(tidy(_across(rule)), "u long, v long"))


#: Classes of one block: signatures only, and with full sets (of so many shingles).
LIST_ROWS, GROUP_ROWS, GROUP_SHINGLES = 1000, 500, 2_000_000


def _blocks(*shares) -> Column:
    return F.greatest(F.lit(1), *[F.ceil(x) for x in shares]).cast("int")


def ranked_coordinates(classes: DataFrame, scratch: Scratch, match: int) -> DataFrame:
    """(node, hub, prefix): of each class that shares ``match`` coordinates its rarest ones, with how many classes have each, and how often its coordinates are shared."""
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    shared = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    ranked = join_counted(tokens, shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"), F.sum("n").alias("hub"))
    return scratch.keep(ranked.where(F.size("ranked") >= match).select("node", "hub", F.slice("ranked", F.lit(1), F.size("ranked") - match + 1).alias("prefix")))


def near_groups(docs: DataFrame, scratch: Scratch, size: int = 5, least: int = 80, match: int = 36) -> DataFrame:
    """(doc_id, h, n_shingles, least_id, group) of every row, kept in ``scratch``.

    h: a hash of the text.  least_id: the smallest id that is linked (its own where nothing is).
    group: equal for the rows of one component; null where a row is linked with nothing by rule.
    """
    with Scratch(docs.sparkSession) as work:
        signed = work.keep(sign(docs, size))
        able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        classes = signed.where(able).groupBy("set_key").agg(
            F.min(F.struct("doc_id", "h")).alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("brief").alias("brief"), F.count("*").alias("copies")
        )
        classes = work.keep(classes.select("set_key", "row.doc_id", "row.h", "n_shingles", "tokens", "brief", "copies", F.monotonically_increasing_id().alias("node")))
        ranked = ranked_coordinates(classes, work, match)
        postings = ranked.select("node", "hub", F.explode("prefix").alias("p")).select(F.col("p.token").alias("g"), F.col("p.n").alias("n"), _blocks(F.col("p.n") / LIST_ROWS).alias("blocks"), "node", "hub")
        candidates = group_links(postings.join(classes.select("node", "brief"), "node"), Counted(match), work).distinct()
        grouped = work.keep(components(candidates, work, local_edges=0).select("node", F.col("component").alias("g")))
        members = work.keep(grouped.join(ranked.select("node", "hub"), "node").join(classes.select("node", "brief", "n_shingles", "doc_id", "h"), "node"))
        totals = work.keep(members.groupBy("g").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")))
        members = join_counted(members, totals, "g").withColumn("blocks", _blocks(F.col("n") / GROUP_ROWS, F.col("shingles") / GROUP_SHINGLES)).select("g", "n", "blocks", "node", "hub", "brief", "doc_id", "h")
        full = work.keep(members.join(_keyed(docs), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).drop("doc_id", "h"))
        linked = components(group_links(full, Confirmed(match, size, least), work), work, local_edges=0)
        named = work.keep(linked.join(classes.select("node", "doc_id", "copies", "set_key"), "node"))
        lowest = work.keep(named.groupBy("component").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
        several = join_counted(named, lowest, "component").select("set_key", F.col("copies").alias("n"), "least_id", F.col("component").alias("group"))
        alone = classes.where("copies > 1").join(named.select("node"), "node", "left_anti").select("set_key", F.col("copies").alias("n"), F.col("doc_id").alias("least_id"), F.col("node").alias("group"))
        known = work.keep(several.union(alone))
        # Rows of the classes that are linked or repeated are looked up; all others are on their own.
        rows = signed.where(able).select("doc_id", "h", "n_shingles", "set_key")
        found = join_counted(rows, known, "set_key").select("doc_id", "h", "n_shingles", "least_id", "group")
        own = classes.where("copies = 1").join(named.select("node"), "node", "left_anti").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("least_id"), F.col("node").alias("group"))
        none = signed.where(~able).select("doc_id", "h", "n_shingles", F.col("doc_id").alias("least_id"), F.lit(None).cast("long").alias("group"))
        return scratch.keep(found.union(own).union(none))


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, least: int = 80, match: int = 36) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``least``: percent of the union that is shared."""
    return near_groups(docs, scratch, size, least, match).select("doc_id", "n_shingles", F.col("least_id").alias("component_id"), F.col("least_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, size: int = 5, least: int = 80, match: int = 36) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, then of the least hash of its text.

    Of rows with equal id and text, the first by their JSON stays.  Rows that are linked with nothing by
    rule (no words, null id) all stay.
    """
    rows = near_groups(docs, scratch, size, least, match)
    with Scratch(docs.sparkSession) as work:
        best = work.keep(rows.where("group is not null").groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("best")).where("n > 1"))
        judged = work.keep(join_counted(rows.select("doc_id", "h", "group"), best, "group").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (F.struct("doc_id", "h") == F.col("best")).alias("_best")))
        gone = scratch.keep(judged.where("not _best").select("_id", "_h").distinct())
        again = scratch.keep(judged.where("_best").groupBy("_id", "_h").count().where("count > 1").select("_id", "_h"))
    here = (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("_h"))
    kept = docs.join(gone, here, "left_anti")
    if not again.limit(1).count():
        return kept
    row = F.struct(*[docs[c] for c in docs.columns])
    one = docs.join(again, here).groupBy("_id", "_h").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return kept.join(again, here, "left_anti").unionByName(one)

"""Repeated substrings by prefix-partitioned suffix trees over words.

A suffix (a place in a text with at least ``window`` words to go) matters only if its first ``window``
words start somewhere else too.  Suffixes are split by variable-length prefixes: a suffix's prefix runs to
the end of the minimal gram among its first ``window`` words, so equal suffixes have equal prefixes,
and all prefixes that end in the same gram go to one group.  Groups of one occurrence hold no
repeat and are dropped by counting grams alone.  Suffixes of one text whose prefixes end at the same place
are a slice of its words; equal slices, of which a common passage has one for each text that
holds it, are counted before they meet.  Each group's different slices become a subtree: a suffix array
by prefix doubling and the common prefixes of its neighbours, whose intervals are the inner nodes.  The
inner nodes at depth ``window`` or more are the maximal repeats; a suffix below one is a repeat, as is any of a
slice that was counted twice.

A group whose different slices hold more than ``GROUP_BYTES`` has its prefixes lengthened to the whole window.  Such a
subtree has its first inner node at depth ``window`` already, so its leaves need only be counted, which
an aggregate does wherever they lie; these prefixes are compared by 128-bit digests of their
words, those of all other groups word by word.

Texts that are the same as a whole are settled first by their digest: one of them stays as witness.

Defined cases: a null text has no words; a text shorter than the window keeps all; windows of one
text that overlap or repeat count as different places; repeated rows are copies of one another; a
null id is an id like others; an empty table gives an empty result; columns but id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, Scratch, chunked, gram_hashes, join_counted, small_batches, split_words, text_buffers, text_of, tidy, word_hashes

GRAM = 8
#: Words of a group (bytes) that become one subtree in a task.
GROUP_BYTES = 1 << 18
_LOW = U64(0xFFFFFFFF)
_NO_ID = -(1 << 63)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


class Anchors:
    """For texts, the minimal gram of each window: runs of windows that share it, and its hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.first = split_words(raw, offsets)
        n = len(self.starts) - window + 1
        self.doc = self.low = self.high = np.zeros(0, np.int64)
        self.value = np.zeros(0, np.int64)
        if n <= 0:
            return
        grams = gram_hashes(word_hashes(raw, self.starts, self.ends), GRAM)
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
        place = (sliding_min(keys, window - GRAM + 1) & _LOW).astype(np.int64)
        doc = np.searchsorted(self.first, np.arange(len(self.starts)), "right") - 1
        valid = doc[:n] == doc[window - 1 :]
        s = np.flatnonzero(valid)
        if not len(s):
            return
        fresh = np.ones(len(s), bool)
        fresh[1:] = (place[s[1:]] != place[s[:-1]]) | (s[1:] != s[:-1] + 1)
        at = np.flatnonzero(fresh)
        self.low, self.high = s[at], s[np.append(at[1:], len(s)) - 1]
        self.value, self.doc = grams[place[self.low]].view(np.int64), doc[self.low]


def _scan(window: int):
    """(k, h, digest, doc_id, text) -> without the text: words, digest of them all, the anchors."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(4))
            for i, j in chunked(offsets):
                part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a = Anchors(part, own, window)
                data = part.tobytes()
                shas = [hashlib.sha256(b" ".join(data[x:y].split())).hexdigest() for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                # Each text names a gram once, with how often it is minimal there.
                order = np.lexsort((a.value, a.doc))
                doc, value = a.doc[order], a.value[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                at = np.flatnonzero(fresh)
                bounds = pa.array(np.searchsorted(doc[at], np.arange(j - i + 1)), pa.int32())
                anchors = pa.ListArray.from_arrays(bounds, pa.array(value[at], pa.int64()))
                times = pa.ListArray.from_arrays(bounds, pa.array(np.diff(np.append(at, len(order))), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(4)), pa.array(np.diff(a.first), pa.int64()), pa.array(shas, pa.string()), anchors, times], ["k", "h", "digest", "doc_id", "n_words", "all_sha256", "anchors", "times"])

    return scanned


SLICES = "anchor long, key binary, k long, h long, starts array<long>, words binary"


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _slices(window: int):
    """(k, h, text, seeds) -> ``SLICES`` of each seed: the words of its windows, once for all places where a text has the same."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(2))
            ks, hs, seeds = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            for i, j in chunked(offsets):
                part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a = Anchors(part, own, window)
                data, out = part.tobytes(), []
                bounds = np.searchsorted(a.doc, np.arange(j - i + 1))
                for d in range(j - i):
                    known, found, base = set(seeds[i + d]), defaultdict(list), int(a.first[d])
                    for r in range(bounds[d], bounds[d + 1]):
                        anchor = int(a.value[r])
                        if anchor in known:
                            low, high = int(a.low[r]), int(a.high[r])
                            found[anchor, b" ".join(data[a.starts[low] : a.ends[high + window - 1]].split())].append(low - base)
                    out += [(anchor, _digest(words), ks[i + d], hs[i + d], starts, words) for (anchor, words), starts in found.items()]
                    if len(out) >= 5000:
                        yield _batch(out, _SLICE_TYPES)
                        out = []
                if out:
                    yield _batch(out, _SLICE_TYPES)

    return cut


_LONGS = pa.list_(pa.int64())
_SLICE_TYPES = {"anchor": pa.int64(), "key": pa.binary(), "k": pa.int64(), "h": pa.int64(), "starts": _LONGS, "words": pa.binary()}
_WINDOW_TYPES = {"wide": pa.binary(), "key": pa.binary(), "n": pa.int64(), "places": _LONGS}
_RUN_TYPES = {"key": pa.binary(), "n": pa.int64(), "lows": _LONGS, "highs": _LONGS}


def _batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _lengthened(window: int):
    """(key, n, words) -> (wide, key, n, places): each different window of a slice by the digest of its words, n times as often as it stands there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, n, joined in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                words, places = joined.split(b" "), defaultdict(list)
                for p in range(len(words) - window + 1):
                    places[_digest(b" ".join(words[p : p + window]))].append(p)
                out += [(wide, key, n * len(at), at) for wide, at in places.items()]
            yield _batch(out, _WINDOW_TYPES)

    return cut


class Subtree:
    """The suffix tree of slices of words, as a suffix array of its leaves with the common prefixes of neighbours.

    Leaves are the places with at least ``window`` words to go in their slice, in order of slice and place.
    """

    def __init__(self, slices: list[bytes], window: int):
        parts = [s.split() for s in slices]
        self.window, self.sizes = window, np.array([len(p) for p in parts])
        codes = pd.factorize(np.array([w for p in parts for w in p], dtype=object))[0]
        # A separator of its own after each slice ends every common prefix there.
        ends = np.cumsum(self.sizes + 1)
        self.ids = np.empty(int(ends[-1]), np.int64)
        separators = np.zeros(len(self.ids), bool)
        separators[ends - 1] = True
        self.ids[~separators] = codes
        self.ids[separators] = len(codes) + np.arange(len(slices))
        self.counts = np.maximum(self.sizes - window + 1, 0)
        first = np.cumsum(self.counts) - self.counts
        self.slice = np.repeat(np.arange(len(slices)), self.counts)
        self.start = np.arange(len(self.slice)) - first[self.slice]
        self.place = (ends - self.sizes - 1)[self.slice] + self.start
        # Ranks by the first 1, 2, 4, ... words, until these are as long as the longest slice.
        self.ranks = [np.unique(self.ids, return_inverse=True)[1]]
        step = 1
        while step < int(self.sizes.max(initial=0)):
            rank, second = self.ranks[-1], np.zeros(len(self.ids), np.int64)
            second[:-step] = rank[step:] + 1
            self.ranks.append(np.unique(rank * (int(rank.max()) + 2) + second, return_inverse=True)[1])
            step *= 2
        #: Leaves in lexical order, and the words that each shares with the one before.
        self.order = np.argsort(self.ranks[-1][self.place], kind="stable")
        at = self.place[self.order]
        self.common = np.concatenate([np.zeros(1, np.int64), self._common(at[:-1], at[1:])])[: len(at)]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, last = np.zeros(len(a), np.int64), len(self.ids) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            out += (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)]).astype(np.int64) << k
        return out

    def depths(self) -> np.ndarray:
        """For each leaf the depth of the inner node it hangs on: the words it shares with its nearest neighbour."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.maximum(self.common, np.append(self.common[1:], 0)) if len(self.order) else 0
        return out

    def inner_nodes(self) -> list[tuple[int, int, int]]:
        """(depth, first, last) of the inner nodes at depth ``window`` or more; first and last count in ``order``."""
        out, open_ = [], []
        for i, c in enumerate([*self.common.tolist(), 0]):
            low = i - 1
            while open_ and open_[-1][0] > c:
                depth, low = open_.pop()
                out.append((depth, low, i - 1))
            if c >= self.window and (not open_ or open_[-1][0] < c):
                open_.append((c, low))
        return out

    def maximal_repeats(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """(words, [(slice, place)]) of the inner nodes whose leaves have different words before them (or none)."""
        out = []
        for depth, first, last in self.inner_nodes():
            leaves = self.order[first : last + 1]
            before = np.where(self.start[leaves] > 0, self.ids[self.place[leaves] - 1], -1 - leaves)
            if len(np.unique(before)) > 1:
                out.append((depth, sorted(zip(self.slice[leaves].tolist(), self.start[leaves].tolist(), strict=True))))
        return out


def tree_repeats(slices: list[bytes], window: int) -> list[np.ndarray]:
    """For each slice of words, which of its windows are leaves below an inner node at depth ``window`` or more."""
    tree = Subtree(slices, window)
    return np.split(tree.depths() >= window, np.cumsum(tree.counts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _subtrees(window: int, chunk: int = 1 << 20):
    """Rows (anchor, key, n, words) sorted by anchor -> (key, n, lows, highs): the runs of repeated windows of each slice that has any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # whole groups, but for the last one
        size = 0

        def solve(part: list[tuple]) -> pa.RecordBatch:
            keep = [r for x, r in enumerate(part) if r[2] > 1 or (x and part[x - 1][0] == r[0]) or (x + 1 < len(part) and part[x + 1][0] == r[0])]
            out = []
            if keep:
                for (_, key, n, _), flags in zip(keep, tree_repeats([r[3] for r in keep], window), strict=True):
                    runs = [(0, len(flags) - 1)] if n > 1 else _runs(flags)
                    if runs:
                        out.append((key, n, [x for x, _ in runs], [y for _, y in runs]))
            return _batch(out, _RUN_TYPES)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if size > chunk and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield solve(rows)

    return found


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of(F.col("text"))
    return docs.withColumn("_gleaner_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_gleaner_h", F.xxhash64(text))


def _remove(window: int):
    """(k, h, text, found) of repeated windows -> words removed and the kept words.  found: runs of windows, and the places they are counted from."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept = [], []
            for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = text.encode("utf-8", "replace").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for x in found:
                    for low, high in zip(x["lows"], x["highs"], strict=True):
                        for start in x["starts"]:
                            gone[start + low] += 1
                            gone[start + high + window] -= 1
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                n.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["k", "h", "n_removed", "kept"])

    return removed


def repeated_words(docs: DataFrame, scratch: Scratch, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """What to remove: (all, changed), both kept in ``scratch``.

    all: (k, h, doc_id, n_words, all_sha256, copied) of every row; ``copied``: its whole text occurs again.
    changed: (k, h, n_removed, kept) of the texts that are not copied but hold repeats.
    k is the id (or a number that stands for null), h a hash of the text; both together tell texts apart.
    """
    small_batches(docs.sparkSession)
    text = text_of(F.col("text"))
    keyed = _keyed(docs)
    with Scratch(docs.sparkSession) as work:
        rows = keyed.select(F.col("_gleaner_k").alias("k"), F.col("_gleaner_h").alias("h"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        scanned = work.keep(rows.mapInArrow(tidy(_scan(window)), "k long, h long, digest binary, doc_id long, n_words long, all_sha256 string, anchors array<long>, times array<long>"))
        copies = work.keep(scanned.groupBy("digest").agg(F.count("*").alias("copies"), F.min("k").alias("witness")).where("copies > 1"))
        everything = scratch.keep(scanned.select("k", "h", "digest", "doc_id", "n_words", "all_sha256").join(copies, "digest", "left").withColumn("copied", F.col("copies").isNotNull()).drop("digest", "copies"))
        # One row of each text that occurs again says where its grams are.
        whole = work.keep(everything.where("copied").select("k", "h", (F.col("k") == F.col("witness")).alias("witness")).distinct())
        lists = scanned.where(F.size("anchors") > 0).select("k", "h", "anchors", "times")
        lists = lists.join(whole, ["k", "h"], "left_anti").union(lists.join(whole.where("witness"), ["k", "h"], "left_semi").dropDuplicates(["k", "h"]))
        grams = lists.select("k", "h", F.explode(F.arrays_zip("anchors", "times")).alias("a")).select("k", "h", F.col("a.anchors").alias("anchor"), F.col("a.times").alias("times"))
        shared = work.keep(grams.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1"))
        seeds = join_counted(grams.select("k", "h", "anchor"), shared, "anchor").groupBy("k", "h").agg(F.collect_set("anchor").alias("seeds"))
        texts = keyed.select(F.col("_gleaner_k").alias("k"), F.col("_gleaner_h").alias("h"), text.alias("text"))
        seeded = work.keep(texts.join(seeds, ["k", "h"]).dropDuplicates(["k", "h"]))
        slices = work.keep(seeded.mapInArrow(tidy(_slices(window)), SLICES))
        # Equal slices are one, with how often it stands anywhere; groups are as large as their different slices.
        different = work.keep(slices.groupBy("anchor", "key", "words").agg(F.sum(F.size("starts")).alias("n")))
        sizes = work.keep(different.groupBy("anchor").agg(F.sum(F.length("words")).alias("bytes"), F.sum("n").alias("n")).where("n > 1"))
        wide = sizes.where(F.col("bytes") > GROUP_BYTES).select("anchor")
        small = different.join(sizes.where(F.col("bytes") <= GROUP_BYTES).select("anchor"), "anchor").select("anchor", "key", "n", "words")
        runs = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_subtrees(window)), "key binary, n long, lows array<long>, highs array<long>")
        if wide.limit(1).count():
            windows = work.keep(different.join(wide, "anchor").select("key", "n", "words").mapInArrow(tidy(_lengthened(window)), "wide binary, key binary, n long, places array<long>"))
            twice = work.keep(windows.groupBy("wide").agg(F.sum("n").alias("n")).where("n > 1"))
            again = join_counted(windows.select("wide", "key", "places"), twice, "wide").groupBy("key").agg(F.flatten(F.collect_list("places")).alias("lows"))
            runs = runs.unionByName(again.join(different.select("key", "n"), "key").select("key", "n", "lows", F.col("lows").alias("highs")))
        runs = work.keep(runs)
        found = join_counted(slices.select("key", "k", "h", "starts"), runs, "key")
        per_text = found.groupBy("k", "h").agg(F.collect_list(F.struct("starts", "lows", "highs")).alias("found"))
        open_ = seeded.select("k", "h", "text").join(per_text, ["k", "h"]).join(whole, ["k", "h"], "left_anti")
        changed = open_.select("k", "h", "text", "found").mapInArrow(tidy(_remove(window)), "k long, h long, n_removed long, kept string")
        return everything, scratch.keep(changed)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def removal_digests(docs: DataFrame, scratch: Scratch, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    everything, changed = repeated_words(docs, scratch, window)
    short = changed.select("k", "h", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    out = everything.join(short, ["k", "h"], "left")
    gone = F.col("copied") & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 35) -> DataFrame:
    """``docs`` with repeated words removed; texts without repeats stay as they are, emptied ones go."""
    everything, changed = repeated_words(docs, scratch, window)
    gone = everything.where(F.col("copied") & (F.col("n_words") >= window)).select(F.col("k").alias("_gleaner_k"), F.col("h").alias("_gleaner_h"), F.lit("").alias("_gleaner_kept")).distinct()
    new = changed.select(F.col("k").alias("_gleaner_k"), F.col("h").alias("_gleaner_h"), F.col("kept").alias("_gleaner_kept")).union(gone)
    joined = _keyed(docs).join(new, ["_gleaner_k", "_gleaner_h"], "left").where("_gleaner_kept is null or _gleaner_kept <> ''")
    return joined.select(*[F.coalesce("_gleaner_kept", F.col("text").cast("string")).alias("text") if c == "text" else F.col(c) for c in docs.columns])

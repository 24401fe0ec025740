"""Best-fit packing of token sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens.  Full pieces are sequences of their own.
The rest is dealt to partitions of bounded size; each is packed by best-fit decreasing and compared
with a lower bound from dual feasible functions.  A partition whose bins equal its bound is certified
and done.  Partitions with a gap exchange: the pieces of their bins that are not full are pooled and dealt
anew to fewer, larger groups (never above ``group_pieces``), which are packed again; a group that needs
no fewer bins than before keeps its old ones.

Only lengths and numbers are shuffled for packing, not the tokens: ``materialise`` cuts the tokens
of a packed piece from its text again.

Defined cases: a null text is empty and one piece (the end token alone); repeated rows are pieces of
their own; an empty table packs into nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, small_batches, text_of, tidy

CAPACITY, END = 1024, 2
#: The published pattern that splits text before merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOKENIZERS: dict = {}


class ByteBpe:
    """A byte-level BPE vocabulary (JSON): merges by a rank table, texts with special strings by the file's own rules."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.full = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.full is None:  # rare, and large in memory
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def tokenizer(path: str) -> ByteBpe:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def piece_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` of every row: where each piece starts, its tokens and their CRC-32 (little-endian uint32)."""
    small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(t.ids(text.as_py()), np.uint32(END)).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return rows.mapInArrow(tidy(pieces), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of dual feasible functions over the histogram of lengths.

    For each e up to half the capacity: pieces over capacity - e count as a whole bin, those from e up
    by their length, shorter ones not at all; and the rounding functions x -> floor((k + 1) x) / k.
    """
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    mass, count = np.cumsum(h * size), np.cumsum(h)
    e = np.arange(0, capacity // 2 + 1)
    big = count[-1] - count[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max()) if len(lengths) else 0
    for k in range(1, 64):
        u = np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, int(-(-int((h * u).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.  Ties go to the earlier piece and the latest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    has = 0  # a bit for each room that some bin has
    made = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = has >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                has &= ~(1 << r)
        else:
            r, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - r
        if r - n:
            room[r - n].append(b)
            has |= 1 << (r - n)
    return bins, offsets, made


def _pack(table: pd.DataFrame, capacity: int, old: bool) -> pd.DataFrame:
    """One group: new bins (or its old ones where those are not more), and what a further round may take."""
    lengths = table["length"].to_numpy(np.int64)
    bins, offsets, made = best_fit_decreasing(lengths, capacity)
    if old and table["sequence"].nunique() <= made:
        _, bins = np.unique(table["sequence"].to_numpy(), return_inverse=True)
        offsets = table["offset"].to_numpy(np.int64)
        made = int(bins.max()) + 1
    bound = lower_bound(lengths, capacity)
    full = np.bincount(bins, lengths)[bins] == capacity
    table = table.copy()
    table["bin"], table["offset"], table["open"] = bins, offsets, ~full if made > bound else np.zeros(len(table), bool)
    table["bins"], table["bound"] = made, bound
    return table


def _packer(capacity: int, old: bool):
    def pack(table: pd.DataFrame) -> pd.DataFrame:
        return _pack(table.sort_values("_row"), capacity, old)

    return pack


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group_pieces: int = 100_000, rounds: int = 3, merge: int = 8) -> DataFrame:
    """``pieces`` with sequence_id and offset.  A group of one task holds about ``group_pieces`` pieces at most.

    sequence_id: the round and group that packed the piece, above its bin there.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = scratch.keep(pieces.withColumn("_row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == capacity).select(*columns, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.where(F.col("length") < capacity).withColumn("sequence", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    schema = open_.schema.add("bin", "long").add("open", "boolean").add("bins", "long").add("bound", "long").add("_group", "long")
    done = [whole]
    base, left = 1 << 62, open_.count()
    groups = max(1, -(-left * merge // group_pieces))
    for step in range(rounds + 1):
        if not left:
            break
        least = max(1, -(-left // group_pieces))
        groups = max(least, groups if step == 0 else groups // merge)
        last = step == rounds or (step > 0 and groups == before == 1)
        # All pieces of one old bin move together, so that a group can keep its old bins.
        key = F.col("_row") if step == 0 else F.col("sequence")
        dealt = open_.withColumn("_group", F.pmod(F.xxhash64(key, F.lit(step)), F.lit(groups)))

        packed = dealt.groupBy("_group").applyInPandas(_packer(capacity, step > 0), schema)
        packed = packed.withColumn("sequence", F.lit(base + (step << 56)) + F.shiftleft("_group", 32) + F.col("bin"))
        packed = scratch.keep(packed)
        final = packed if last else packed.where("not open")
        done.append(final.select(*columns, F.col("sequence").alias("sequence_id"), "offset"))
        if last:
            break
        open_ = packed.where("open").select(*open_.columns)
        left, before = open_.count(), groups
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY, **how) -> DataFrame:
    """Every piece of every row with its sequence and place."""
    return pack_pieces(piece_documents(docs, path, capacity), scratch, capacity, **how)


def materialise(docs: DataFrame, packed: DataFrame, path: str | None = None) -> DataFrame:
    """(sequence_id, offset, ids) for documents whose ids are unique: the tokens of each packed piece."""
    plan = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("plan"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).join(plan, "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())
        for b in batches:
            out = []
            for text, plan in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(t.ids(text), np.uint32(END))
                out += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].astype(np.int64).tolist()) for p in plan]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    small_batches(docs.sparkSession)
    return rows.select("text", "plan").mapInArrow(tidy(tokens), "sequence_id long, offset long, ids array<long>")

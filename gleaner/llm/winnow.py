"""Document fingerprints by winnowing, and their likeness along the order of ids.

Hashes of all k-character grams are taken; of each window of ``WINDOW`` consecutive grams the
minimum is kept, the rightmost one of equal minima, with its position.  Any passage of
``GRAM + WINDOW - 1`` characters that two texts share therefore leaves a common fingerprint.

Defined cases: a null text is empty and has no fingerprint; a text of fewer than ``GRAM``
characters has the hash of its whole self; one of fewer than a full window has its one minimum;
two empty texts are alike (1.0), an empty and another are not (0.0).  Rows are in order of
(doc_id, hash of the text), null ids first; repeated rows follow one another; a table of one row
is its own next; an empty table gives an empty result; columns but id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import CHUNK_BYTES, U64, mix, small_batches, text_of, tidy

GRAM, WINDOW = 16, 32  # powers of two: both are built by doubling
_BASE = 0xD6E8FEB86659FD93
_LOW = U64(0xFFFFFFFF)


def _grams(codes: np.ndarray) -> np.ndarray:
    h, step, power = mix(codes.astype(U64) + U64(1)), 1, _BASE
    while step < GRAM:
        h = h[:-step] * U64(power) + h[step:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        step *= 2
    return mix(h)


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the winnowed hashes (32 bits) and their positions, in order of position."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out: list = [None] * len(texts)
    for i in np.flatnonzero(sizes < GRAM + WINDOW - 1):
        own = codes[starts[i] : ends[i]]
        if len(own) >= GRAM:
            h = _grams(own) >> U64(32)
            at = len(h) - 1 - int(np.argmin(h[::-1]))
            out[i] = (h[at : at + 1].astype(np.uint32), np.array([at]))
        elif len(own):
            whole = np.zeros(GRAM, np.uint32)
            whole[: len(own)] = own
            whole[-1] += np.uint32(len(own) << 24)
            out[i] = ((_grams(whole) >> U64(32)).astype(np.uint32), np.array([0]))
        else:
            out[i] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    full = np.flatnonzero(sizes >= GRAM + WINDOW - 1)
    if not len(full):
        return out
    h = _grams(codes)
    # The hash above, the complement of the place below: the least key is the rightmost minimum.
    m = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=U64))
    step = 1
    while step < WINDOW:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    fresh = np.ones(len(m), bool)
    fresh[1:] = m[1:] != m[:-1]
    for i in full:
        a, b = starts[i], ends[i] - (GRAM + WINDOW - 2)
        f = fresh[a:b].copy()
        f[0] = True
        keys = m[a:b][f]
        out[i] = ((keys >> U64(32)).astype(np.uint32), (_LOW - (keys & _LOW)).astype(np.int64) - a)
    return out


def digest(found: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as a short string: how many hashes, and the MD5 of hashes and positions in decimal."""
    listed = ",".join(map(str, found[0].tolist())) + ";" + ",".join(map(str, found[1].tolist()))
    return f"{len(found[0])}:{hashlib.md5(listed.encode()).hexdigest()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes (sorted and unique)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, positions): the winnowed fingerprint of each text."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _ranges([len(t) for t in texts]):
                x = fingerprints(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h.astype(np.int64) for h, _ in x], pa.list_(pa.int64())), pa.array([p for _, p in x], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(tidy(found), "doc_id long, hashes array<long>, positions array<long>")


def _ranges(sizes: list[int], limit: int = CHUNK_BYTES // 4) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tail, doc_id, text) in order: each row but a bucket's tails, with the row after it."""
    carried: tuple = ()
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        if carried:
            rows.insert(0, carried)
        carried = rows[-1]
        for i, j in _ranges([len(r[3]) for r in rows[:-1]]):
            here = rows[i : j + 1]
            texts = [r[3] for r in here]
            pairs = [k for k in range(len(here) - 1) if not here[k][1]]
            edited = [edit(texts[k], texts[k + 1]) for k in pairs]
            own, changed = fingerprints(texts), fingerprints(edited)
            sets = [np.unique(h) for h, _ in own]
            if any(here[k][0] != here[k + 1][0] for k in pairs):
                raise ValueError("a bucket of documents has lost the first document after it")
            yield pa.RecordBatch.from_arrays([
                pa.array([here[k][2] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([digest(own[k]) for k in pairs], pa.string()), pa.array([digest(x) for x in changed], pa.string()),
                pa.array([likeness(sets[k], np.unique(x[0])) for k, x in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(sets[k], sets[k + 1]) for k in pairs], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


#: Sampled rows for each bucket, from which the buckets' bounds are taken, and buckets for each shuffle partition.
SAMPLED, SPREAD = 20, 4


def _bounds(keys: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes (sorted) that split ``keys`` (doc_id, order) into about as many buckets, from a sample of them."""
    total = keys.count()
    if buckets < 2 or not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, SAMPLED * buckets / total)
    # Rows whose mixed hash is low: the same ones each time, of hot ids and null ids too.
    low = F.pmod(F.xxhash64("doc_id", "order"), F.lit(1 << 40)) < int(share * (1 << 40))
    got = keys.where(low).distinct().toPandas()
    ids, orders = got["doc_id"].fillna(LEAST).to_numpy(np.int64), got["order"].to_numpy(np.int64)
    place = np.lexsort((orders, ids))
    cut = place[np.unique(np.arange(1, buckets) * len(place) // buckets)] if len(place) else place
    return ids[cut], orders[cut]


#: Stands for a null id, which comes first.
LEAST = -(1 << 63)


def bucket_of(ids: np.ndarray, orders: np.ndarray, bound_ids: np.ndarray, bound_orders: np.ndarray) -> np.ndarray:
    """How many bounds (id, order) each row is not below."""
    low, high = np.searchsorted(bound_ids, ids, "left"), np.searchsorted(bound_ids, ids, "right")
    for i in np.unique(ids[low < high]).tolist():  # ids that are bounds: their hashes decide
        at = ids == i
        x, y = int(low[at][0]), int(high[at][0])
        low[at] += np.searchsorted(bound_orders[x:y], orders[at], "right")
    return low


def compare_along(docs: DataFrame) -> DataFrame:
    """``RESULT`` for every row: its fingerprint against its edited text's and the next document's.

    Rows are dealt to buckets of consecutive (id, hash) between bounds from a sample, ``SPREAD`` buckets for
    each shuffle partition; the first row of a bucket is also sent, as a tail, to the bucket before it.
    Only the bounds and one key per bucket reach the driver; the texts are shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).withColumn("order", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("doc_id", "order"), SPREAD * parts)
    sent = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, orders: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids.to_numpy(np.int64), orders.to_numpy(np.int64), *sent.value).astype(np.int32))

    rows = rows.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(LEAST).cast("long")), "order") if len(bounds[0]) else F.lit(0))
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "order")).alias("head")).orderBy("bucket").collect()
    if heads:
        firsts = spark.createDataFrame([(h["head"]["doc_id"], h["head"]["order"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)], "first_id long, first_order long, before int")
        rows = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("order") == F.col("first_order")), "left")
        places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail")))
        rows = rows.withColumn("place", F.explode(F.when(F.col("before").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("before").alias("b"), F.lit(1).alias("tail")))))))
        rows = rows.select("place.b", "place.tail", "doc_id", "text", "order").repartition(parts, "b").sortWithinPartitions("b", "tail", F.col("doc_id").asc_nulls_first(), "order")
        rows = rows.select(F.col("b").cast("int"), F.col("tail").cast("int"), "doc_id", "text")
    else:
        rows = rows.select(F.lit(0).alias("b"), F.lit(0).alias("tail"), "doc_id", "text")
    return rows.mapInArrow(tidy(_compared), RESULT)

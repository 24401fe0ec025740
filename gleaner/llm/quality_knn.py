"""Quality by nearest neighbours: labelled latent-semantic vectors vote with their similarity.

A document's terms are its words and the trigrams of its shape (runs of letters, capitals, digits and
space are one symbol each, punctuation stands for itself), hashed to fixed numbers of columns, and
one term for each word that repeats the word before it.  A truncated SVD of the labelled documents' tf-idf rows gives the latent space.  Every document is
projected into it, and its cosines to all labelled vectors are computed exactly, in blocks; the
``neighbours`` nearest vote for their label with weight cosine ** ``sharpness``.

The labelled vectors are broadcast: at most ``max_labelled`` of them (the rows with the smallest
hash of their id), so ``max_labelled`` * ``rank`` * 4 bytes bound what is sent.

Cosines count to ``PLACES`` places, so that ties are ties whatever the last digits of a product are, and
blocks always have ``BLOCK`` rows (the last one is filled up), so that a document's score does not
depend on the rows it is read with.

Defined cases: a null or empty text has no terms and gets the prior of label 1; labelled rows
without a label or text row are not learned from; ties in cosine go to the smaller row of the
labelled table (by id, label, terms); with no labels at all every score is 0.5; a null id is held out;
repeated rows are learned from once and scored alike; an empty table gives no scores; columns but id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, chunked, id_remainder, mix, small_batches, split_words, text_buffers, text_of, tidy, word_hashes

WORD_COLUMNS, SHAPE_COLUMNS = 1024, 1024
COLUMNS = WORD_COLUMNS + SHAPE_COLUMNS
#: Weight of the word part against the shape part.
WORD_WEIGHT = 0.3
#: Decimal places of a cosine, and documents of a block.
PLACES, BLOCK = 6, 256


def _shape_classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[[0x20, 9, 11, 12, 13]] = 0x20
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_CLASS = _shape_classes()
_RUN = np.zeros(256, bool)
_RUN[[0x20, ord("a"), ord("A"), ord("0")]] = True


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x COLUMNS counts of hashed words and shape trigrams."""
    n = len(offsets) - 1
    out = np.zeros(n * COLUMNS, np.float32)
    if len(raw):
        starts, ends, _ = split_words(raw, offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        words = word_hashes(raw, starts, ends)
        out += np.bincount(doc * COLUMNS + (words % U64(WORD_COLUMNS)).astype(np.int64), minlength=len(out))
        again = doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
        out += np.bincount(again * COLUMNS + COLUMNS - 1, minlength=len(out))
        shape = _CLASS[raw]
        kept = np.ones(len(raw), bool)
        kept[1:] = ~(_RUN[shape[1:]] & (shape[1:] == shape[:-1]))
        kept[offsets[:-1][offsets[:-1] < len(raw)]] = True
        at = np.flatnonzero(kept)
        shape = shape[at].astype(U64)
        doc = np.searchsorted(offsets, at, "right") - 1
        if len(at) > 2:
            tri = mix(shape[:-2] | shape[1:-1] << U64(8) | shape[2:] << U64(16)) % U64(SHAPE_COLUMNS - 1)
            same = doc[:-2] == doc[2:]
            out += np.bincount(doc[:-2][same] * COLUMNS + WORD_COLUMNS + tri[same].astype(np.int64), minlength=len(out))
    return out.reshape(n, COLUMNS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    for part, weight in ((slice(0, WORD_COLUMNS), WORD_WEIGHT), (slice(WORD_COLUMNS, COLUMNS), 1.0)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.maximum(norm, 1e-9)
    return x


def _right_vectors(x: np.ndarray, rank: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration from a seeded start."""
    rank = min(rank, *x.shape)
    wide = min(rank + 16, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], wide)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank])


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, sharpness: float):
        self.neighbours, self.sharpness = neighbours, sharpness
        used = counts.sum(1) > 0
        counts, self.labels = counts[used], labels[used].astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(counts):
            self.vectors = None
            return
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = _weighted(counts, self.idf)
        self.space = _right_vectors(x, rank)
        self.vectors = self._unit(x @ self.space)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """Rounded cosines (documents x labelled vectors, as whole multiples of the last place) of at most ``BLOCK`` documents."""
        block = np.zeros((BLOCK, counts.shape[1]), np.float32)
        block[: len(counts)] = counts
        near = self._unit(_weighted(block, self.idf) @ self.space) @ self.vectors.T
        return np.rint(near[: len(counts)] * 10.0**PLACES).astype(np.int64)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        rows = np.flatnonzero(counts.sum(1) > 0)
        if self.vectors is None:
            return out
        n = len(self.labels)
        k = min(self.neighbours, n)
        for i in range(0, len(rows), BLOCK):
            at = rows[i : i + BLOCK]
            # The row as the lowest digits: no two keys are equal, and of equal cosines the smaller row is first.
            keys = -self.cosines(counts[at]) * n + np.arange(n)
            top = np.sort(np.partition(keys, k - 1, axis=1)[:, :k], axis=1)
            cosine = -np.floor_divide(top, n) / 10.0**PLACES
            weight = np.maximum(cosine, 0.0) ** self.sharpness + 1e-12
            out[at] = (weight * self.labels[top % n]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 6000, rank: int = 48, neighbours: int = 15, sharpness: float = 4.0, folds: int = 5, held: int = 0) -> Model:
    """A model from at most ``max_labelled`` labelled rows outside the held-out remainder."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (id_remainder(F.col("doc_id"), folds) != held))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.col("text").cast("string")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(2))
            for i, j in chunked(offsets):
                counts = term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = [np.minimum(r, 65535).astype(np.uint16).tobytes() for r in counts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(packed, pa.binary())], ["doc_id", "label", "counts"])

    got = rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(tidy(counted), "doc_id long, label int, counts binary").toPandas()
    got = got.sort_values(["doc_id", "label", "counts"])
    counts = np.frombuffer(b"".join(got["counts"]), np.uint16).reshape(-1, COLUMNS).astype(np.float32)
    return Model(counts, got["label"].to_numpy(), rank, neighbours, sharpness)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            parts = [sent.value.score(term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunked(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")

"""Toxicity by a counterfactually regularised linear classifier.

A logistic model over hashed words and word beginnings (of runs of letters, ASCII case folded, present
or not) is fitted to labelled documents.  Identity terms are found in the sentences of these documents word by
word (their bytes, not their hashes).  For each term that a document holds, the first sentence with it
is swapped: once for each other term of its group, each giving a counterfactual sentence with features of
its own.  A document without any term has one of its sentences (and one term, dealt by hash) joined to a
mention, which is swapped alike, so that a group is known to the penalty even where the labelled
sentences hardly name it.  The squared change of the score between a sentence and its counterfactual is
added to the loss (its mean, times ``strength``): naming one group rather than another moves no score.
The features that tell sentence and counterfactual apart stay in the model whatever their own merit.

Learning takes at most ``max_labelled`` labelled rows (those with the smallest hash of their id).

Defined cases: null and empty texts have no words and get the model's bias; rows without a label are
not learned from; with no labelled row, or labels of one kind, the score is that kind's share (0.5
without any); a null id counts as the empty id in the folds; repeated rows are learned from once and
scored alike; an empty table gives no scores; columns but id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, chunked, id_remainder, mix, small_batches, text_buffers, text_of, tidy, word_hashes

BITS = 18
#: Terms that may stand for one another in a sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("deaf", "blind", "disabled", "autistic", "healthy"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "juden", "christen", "muslime", "ausländer"),
    ("femmes", "hommes", "juifs", "chrétiens", "musulmans", "étrangers"),
    ("mujeres", "hombres", "judíos", "cristianos", "musulmanes", "extranjeros"),
)

_LETTER = np.zeros(256, np.uint8)  # a word's byte, folded; 0 elsewhere
_LETTER[128:] = np.arange(128, 256)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)


def word_columns(raw: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each distinct feature of each text, sorted; ``only``: a mask of the columns asked for."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = _LETTER[raw]
    word = folded > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, columns = [row], [(word_hashes(folded, starts, ends) >> U64(64 - BITS)).astype(np.int64)]
    for k in BEGINNINGS:
        long = ends - starts > k
        rows.append(row[long])
        columns.append((mix(word_hashes(folded, starts[long], starts[long] + k) + U64(k)) >> U64(64 - BITS)).astype(np.int64))
    row, column = np.concatenate(rows), np.concatenate(columns)
    if only is not None:
        asked = only[column]
        row, column = row[asked], column[asked]
    both = np.unique(row << BITS | column)
    return both >> BITS, both & ((1 << BITS) - 1)


#: Bytes that end a sentence.
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
#: Folded word -> (group, place in it).
TERMS = {term.encode(): (g, i) for g, group in enumerate(IDENTITY_GROUPS) for i, term in enumerate(group)}


def _mention(key: int) -> tuple[bytes, int, int]:
    """A term dealt by a number, as bytes, with its group and place."""
    g = key % len(IDENTITY_GROUPS)
    i = key // len(IDENTITY_GROUPS) % len(IDENTITY_GROUPS[g])
    return IDENTITY_GROUPS[g][i].encode(), g, i


def counterfactuals(raw: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(sentence, its counterfactual) pairs of one text, in folded bytes; a text without a term lends a sentence to a mention."""
    folded = _LETTER[raw]
    word = folded > 0
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return []
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    stops = np.concatenate([[-1], np.flatnonzero(_ENDS[raw]), [len(raw)]])
    data = np.where(word, folded, np.uint8(0x20)).tobytes()

    def sentence(at: int) -> tuple[int, int]:
        k = int(np.searchsorted(stops, at, "right"))
        return int(stops[k - 1]) + 1, int(stops[k])

    first: dict[bytes, tuple[int, int]] = {}
    sizes = ends - starts
    for k in np.flatnonzero((sizes >= SHORTEST) & (sizes <= LONGEST)).tolist():
        first.setdefault(data[starts[k] : ends[k]], (int(starts[k]), int(ends[k])))
    out = []
    for term, (g, i) in TERMS.items():
        if term not in first:
            continue
        x, y = first[term]
        low, high = sentence(x)
        before, after = data[low:x], data[y:high]
        out += [(before + term + after, before + other.encode() + after) for j, other in enumerate(IDENTITY_GROUPS[g]) if j != i]
    if not out:
        key = int(mix(np.array([len(raw) * 1_000_003 + int(raw.sum(dtype=np.int64))], U64))[0] >> U64(1))
        low, high = sentence(int(starts[key % len(starts)]))
        term, g, i = _mention(key // len(starts))
        other = IDENTITY_GROUPS[g][(i + 1) % len(IDENTITY_GROUPS[g])].encode()
        out.append((data[low:high] + b" " + term, data[low:high] + b" " + other))
    return out


SHORTEST, LONGEST = min(map(len, TERMS)), max(map(len, TERMS))


def changes(pairs: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Of each pair, the columns that only the sentence has (c) and those that only the counterfactual has (~c)."""
    texts = [t for pair in pairs for t in pair]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, column = word_columns(np.frombuffer(b"".join(texts), np.uint8), offsets)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    parts = [column[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return [np.concatenate([np.setdiff1d(x, y, True), ~np.setdiff1d(y, x, True)]).astype(np.int32) for x, y in zip(parts[::2], parts[1::2], strict=True)]


class Penalty:
    """strength * the mean of (w . d)^2 over the differences d of sentences and counterfactuals, on ``used`` columns."""

    def __init__(self, pairs: list[np.ndarray], used: np.ndarray, strength: float):
        self.pairs, self.strength, self.size = len(pairs), strength, len(used)
        signed = np.concatenate([np.zeros(0, np.int64), *pairs]).astype(np.int64)
        self.which = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        self.sign = np.where(signed < 0, -1.0, 1.0)
        self.place = np.searchsorted(used, np.where(signed < 0, ~signed, signed))

    def moved(self, w: np.ndarray) -> np.ndarray:
        """The change of the score from each sentence to its counterfactual."""
        return np.bincount(self.which, self.sign * w[self.place], minlength=self.pairs)

    def value(self, w: np.ndarray) -> float:
        return self.strength * float((self.moved(w) ** 2).mean()) if self.pairs else 0.0

    def gradient(self, w: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return np.zeros(self.size)
        return np.bincount(self.place, self.sign * (2 * self.strength / self.pairs * self.moved(w))[self.which], minlength=self.size)


class Model:
    """Weights per column and a bias."""

    def __init__(
        self, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, pairs: list[np.ndarray], strength: float, l2: float, least: int = 5, features: int = 1000, steps: int = 1500
    ):
        self.weights = np.zeros(1 << BITS, np.float32)
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not 0 < share < 1:
            return
        n = len(labels)
        # The columns that tell the labels apart best (chi-square), of those in enough documents, and all that a swap changes.
        seen = np.bincount(columns, minlength=1 << BITS).astype(np.float64)
        toxic = np.bincount(columns, labels[rows], minlength=1 << BITS)
        expected = seen * share
        chi = np.where(seen >= least, (toxic - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), -1.0)
        chosen = np.zeros(1 << BITS, bool)
        chosen[np.argsort(-chi, kind="stable")[:features]] = True
        chosen &= chi >= 0
        swapped = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]).astype(np.int64))
        chosen[np.where(swapped < 0, ~swapped, swapped)] = True
        used = np.flatnonzero(chosen)
        keep = chosen[columns]
        rows, columns = rows[keep], np.searchsorted(used, columns[keep])
        penalty = Penalty(pairs, used, strength)
        w, bias = np.zeros(len(used)), self.bias
        first, second, first_b, second_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        for t in range(1, steps + 1):
            s = bias + np.bincount(rows, w[columns], minlength=n)
            g = balance * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels) / n
            grad = np.bincount(columns, g[rows], minlength=len(used)) + l2 * w + penalty.gradient(w)
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            first_b, second_b = 0.9 * first_b + 0.1 * g.sum(), 0.999 * second_b + 0.001 * g.sum() ** 2
            rate, c1, c2 = 0.05 / (1 + t / 150), 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (first / c1) / (np.sqrt(second / c2) + 1e-8)
            bias -= rate * (first_b / c1) / (np.sqrt(second_b / c2) + 1e-8)
        self.weights[used], self.bias = w, float(bias)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, columns = word_columns(raw, offsets, self.weights != 0)
        s = self.bias + np.bincount(rows, self.weights[columns], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 6000, strength: float = 10.0, l2: float = 1e-4, folds: int = 4, held: int = 2) -> Model:
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (id_remainder(F.col("doc_id"), folds) != held))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(text_of(F.col("text"))).alias("text"))
    rows = rows.select(F.col("doc_id").cast("long"), "label", "text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(2))
            for i, j in chunked(offsets):
                row, column = word_columns(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts = np.split(column.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
                swaps = [[d.tobytes() for d in changes(counterfactuals(raw[x:y]))] for x, y in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                out = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(swaps, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "label", "columns", "swaps"])

    got = rows.mapInArrow(tidy(found), "doc_id long, label int, columns binary, swaps array<binary>").toPandas().sort_values(["doc_id", "label", "columns"])
    parts = [np.frombuffer(x, np.int32) for x in got["columns"]]
    pairs = [np.frombuffer(d, np.int32) for swaps in got["swaps"] for d in swaps]
    columns = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Model(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), columns, got["label"].to_numpy(np.float64), pairs, strength, l2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            parts = [sent.value.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunked(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")

"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of 4-grams over letters (lower case) and single spaces between runs of
letters.  Counts come from all labelled texts.  The discounted parts of its grams and the weights of its
contexts are kept as sorted arrays of 64-bit hashes, each entry with the languages that have it, so the
size follows the grams there are and not grams times languages; probabilities are put together order by
order for the grams of a batch.  A text gets the language of the lowest cross-entropy per character; it is
rejected when that entropy is above what labelled texts of similar length show.

The arrays are broadcast where all languages together have at most ``capacity`` 4-grams.  Else the model stays in
tables of the shared folder (``LargeModel``): discounts, context weights and counts of shorter grams are
aggregated over all grams, only the log-probabilities of the most frequent grams (``capacity`` numbers)
are broadcast, and the texts' other grams are joined to the tables.  Both ways give the same model.

Thresholds of rejection come from all labelled rows outside the held-out remainder, by length class.
Each row is judged by a model that has not counted it: the rows are two halves, and the models of either
judge the other (rows of a language that the other half lacks are left out).
Their entropies are counted in classes of 1/1024 bit with the least and greatest value of each, from
which the quantile is read (exact where a class has at most two rows).  A length class with fewer than
``THIN`` rows takes its neighbours' rows as well, one class more on each side until there are enough;
with fewer than ``THIN`` rows in all, only texts without a letter are rejected.

Languages are names: they are listed on the driver, so a table has thousands of them at most.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows
without a language are not learned from; ties in entropy go to the first language by name; with
no labelled row every text is ``und``; a null id counts as held out; repeated rows count as often as they
stand and are judged alike; an empty table gives an empty result; columns but id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import U64, Scratch, chunked, id_remainder, join_counted, mix, small_batches, text_buffers, text_of, tidy

ORDER, SPACE = 4, 0x20
_B = U64(16)
UND = "und"
#: Length classes for rejection, in characters of the reduced text.
LENGTHS = (8, 16, 32, 64, 128, 256)
THIN = 20


def _letters() -> np.ndarray:
    """From a UTF-16 unit to its lower-case letter, or to a space; surrogates stand for themselves."""
    out = np.full(65536, SPACE, np.uint16)
    for i in range(65536):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            out[i] = i
        elif c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTERS = _letters()


def reduced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of the texts, each as three spaces, its words with single spaces, one space; and n + 1 offsets."""
    n = len(offsets) - 1
    lead = (raw & 0xC0) != 0x80
    units = np.concatenate([[0], np.cumsum(lead + (raw >= 0xF0).astype(np.int64))])[offsets]
    chars = _LETTERS[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)]
    kept = chars != SPACE
    # a space stays when it follows a letter of the same text
    follows = np.zeros(len(chars), bool)
    follows[1:] = kept[:-1]
    follows[units[:-1][units[:-1] < len(chars)]] = False
    at = np.flatnonzero(kept | follows)
    chars = chars[at]
    bounds = np.searchsorted(at, units)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(chars) + 4 * n, SPACE, np.uint16)
    out[np.arange(len(chars)) + 4 * doc + 3] = chars
    return out, bounds + 4 * np.arange(n + 1)


def grams(chars: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each place from the fourth on, 16 bits a character."""
    c = chars.astype(U64)
    return c[:-3] << U64(48) | c[1:-2] << U64(32) | c[2:-1] << _B | c[3:]


def _by_text(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams that lie within one text, and the number of each text's."""
    if len(chars) < ORDER:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    inside = np.ones(len(chars), bool)
    for k in range(ORDER - 1):
        inside[offsets[:-1] + k] = False
    return grams(chars)[inside[3:]], np.diff(offsets) - 3


def _characters(raw: np.ndarray, offsets: np.ndarray, chars: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Characters of each text (``sizes`` grams); 0 for a text without a letter."""
    sizes = np.where(np.diff(bounds) > 4, sizes, 0)
    for i in np.flatnonzero((np.add.reduceat((chars >= 0xD800) & (chars < 0xE000), bounds[:-1]) > 0) if len(sizes) else []):
        text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        sizes[i] *= any(c.isalpha() for c in text)
    return sizes


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(lang: str) -> None:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            held[lang] = [(keys, np.bincount(inverse, np.concatenate([n for _, n in held[lang]])).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in held:
                merged(lang)
                keys, n = held[lang][0]
                for i in range(0, len(keys), 100_000):
                    part = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[i : i + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                raw, offsets = text_buffers(b.column(1).take(pa.array(np.flatnonzero(langs == lang))))
                for i, j in chunked(offsets):
                    keys, n = np.unique(_by_text(*reduced(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[0], return_counts=True)
                    held.setdefault(lang, []).append((keys, n.astype(np.int64)))
                    if len(held[lang]) >= 16:
                        merged(lang)
            if sum(len(k) for x in held.values() for k, _ in x) > 2_000_000:
                yield from flush()
        yield from flush()

    parts = docs.select("lang", "text").mapInArrow(tidy(counted), "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def bounded(counts: DataFrame, most: int) -> DataFrame:
    """(gram) of the most frequent grams over all languages: those at or above the least count that leaves at most ``most``.

    Counts are summed in classes of width 1/16 of a power of two, so there are under a thousand
    classes at any size of the corpus.
    """
    totals = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    spread = totals.groupBy(F.floor(F.log2("n") * 16).alias("class")).agg(F.count("*").alias("m"), F.min("n").alias("n")).orderBy(F.desc("class")).collect()
    room, least = most, None
    for r in spread:
        room -= r["m"]
        if room < 0:
            break
        least = r["n"]
    return totals.where(F.col("n") >= least).select("gram") if least is not None else totals.limit(0).select("gram")


class Hashes:
    """Sorted hashes of keys, found from an index of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.concatenate([hashes, [U64(0xFFFFFFFFFFFFFFFF)]])
        self.bits = max(1, int(len(hashes)).bit_length())
        self.index = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        h = mix(keys)
        at = self.index[(h >> U64(64 - self.bits)).astype(np.int64)]
        seen = self.hashes[at]
        late = np.flatnonzero(seen < h)
        while len(late):
            at[late] += 1
            seen[late] = self.hashes[at[late]]
            late = late[seen[late] < h[late]]
        found = (seen == h) & (at < len(self.hashes) - 1)
        return at, found


class Table(Hashes):
    """Rows of values by key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        super().__init__(h[order])
        self.values = values[order].astype(np.float32)


class Sparse(Hashes):
    """Numbers by key and language: each hash with the languages that have it.  ``parts``: (keys, values) of each language."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        h = mix(np.concatenate([k for k, _ in parts]))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        super().__init__(h[first])
        self.ends = np.append(first, len(h))
        self.langs = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])[order]
        self.values = np.concatenate([v for _, v in parts])[order].astype(np.float32)

    def put(self, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``out`` (keys x languages) with the numbers there are."""
        at, found = self.find(keys)
        rows = np.flatnonzero(found)
        starts = self.ends[at[rows]]
        sizes = self.ends[at[rows] + 1] - starts
        entry = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        out[np.repeat(rows, sizes), self.langs[entry]] = self.values[entry]
        return out


#: The probability of a character no model has seen, before any weight.
BASE = 1.0 / 65536
#: Numbers of a block of grams times languages that are worked on together, and log-probabilities of frequent grams kept ready.
CELLS, READY = 1 << 21, 1 << 19


class Model:
    """Log2-probabilities of a character after three others, in each language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.limits: dict = {}
        if not langs:
            return
        per = [self._smoothed(k, n) for k, n in counts]
        self.lam0 = np.array([p["lam0"] for p in per])
        self.direct = {o: Sparse([(p["keys"][o], p["direct"][o]) for p in per]) for o in (1, 2, 3, 4)}
        self.weight = {o: Sparse([(p["contexts"][o], p["weight"][o]) for p in per]) for o in (1, 2, 3)}
        # The most frequent grams' numbers are worked out once; all others' when they are met.
        keys, place = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
        often = np.bincount(place, np.concatenate([n for _, n in counts]))
        head = keys[np.argsort(-often, kind="stable")[: READY // len(langs)]]
        self.head = Table(head, self.logs(head))

    @staticmethod
    def _smoothed(keys: np.ndarray, n: np.ndarray) -> dict:
        """Direct parts and context weights of orders 4 to 1; below 4, a gram counts by its different left neighbours."""
        out = {"keys": {}, "direct": {}, "contexts": {}, "weight": {}}
        for order in (4, 3, 2, 1):
            if order < 4:
                keys, n = np.unique(keys & U64((1 << 16 * order) - 1), return_counts=True)
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            contexts, first, follow = np.unique(keys >> _B if order > 1 else np.zeros(len(keys), U64), return_index=True, return_counts=True)
            totals = np.add.reduceat(n, first).astype(float)
            out["keys"][order] = keys
            out["direct"][order] = np.maximum(n - discount, 0) / np.repeat(totals, follow)
            weight = discount * follow / totals
            if order > 1:
                out["contexts"][order - 1], out["weight"][order - 1] = contexts, weight
            else:
                out["lam0"] = float(weight[0])
        return out

    def logs(self, g: np.ndarray) -> np.ndarray:
        """Log2-probabilities of different grams (grams x languages): each order is its direct part and its context's weight times the shorter gram's."""
        out, step = np.empty((len(g), len(self.langs))), max(1, CELLS // len(self.langs))
        for i in range(0, len(g), step):
            own = g[i : i + step]
            p = np.broadcast_to(self.lam0 * BASE, (len(own), len(self.langs)))
            for o in (1, 2, 3, 4):
                part = own & U64((1 << 16 * o) - 1) if o < 4 else own
                if o > 1:
                    p = p * self.weight[o - 1].put(part >> _B, np.ones(p.shape))
                p = p + self.direct[o].put(part, np.zeros(p.shape))
            out[i : i + step] = np.log2(p)
        return out

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character (texts x languages) and characters of each text; 0 characters: no letter."""
        chars, bounds = reduced(raw, offsets)
        g, sizes = _by_text(chars, bounds)
        n = len(sizes)
        total = np.zeros((n, len(self.langs)))
        if len(g):
            at, found = self.head.find(g)
            rest = np.flatnonzero(~found)
            different, place = np.unique(g[rest], return_inverse=True)
            logs, ends = self.logs(different).astype(np.float32), np.minimum(np.cumsum(sizes) - sizes, len(g) - 1)
            at[rest] = 0
            for l in range(len(self.langs)):
                each = self.head.values[at, l] if len(self.head.values) else np.zeros(len(g), np.float32)
                each[rest] = logs[place, l]
                total[:, l] = np.add.reduceat(each, ends, dtype=np.float64)
        sizes = _characters(raw, offsets, chars, bounds, sizes)
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def judge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and rejection of each text."""
        n = len(offsets) - 1
        if not self.langs:
            return [UND] * n, np.zeros(n), np.full(n, np.inf), np.ones(n, bool)
        return self.judge_bits(*self.entropies(raw, offsets))

    def judge_bits(self, h: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The same from bits per character in each language, and characters."""
        n = len(sizes)
        best = h.argmin(1)
        low = h[np.arange(n), best]
        score = 1 / np.exp2(-np.minimum(sizes, 20)[:, None] * (h - low[:, None])).sum(1)
        none = sizes == 0
        limit = np.array([self.limits.get((int(b), int(c)), np.inf) for b, c in zip(best, np.searchsorted(LENGTHS, sizes), strict=True)])
        return [UND if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score), low, none | (low > limit)


class LargeModel:
    """A model of any size: tables of all grams in the shared folder; of the most frequent ones, ``capacity`` log-probabilities are sent with the tasks.

    ``direct`` has (lang, gram, direct) of each order, ``weight`` (lang, context, weight) of each order of contexts; lang is a number.
    """

    def __init__(self, langs: list[str], counts: DataFrame, capacity: int, scratch: Scratch):
        self.langs, self.scratch, self.limits = langs, scratch, {}
        self.direct, self.weight = {}, {}
        spark = counts.sparkSession
        self.numbers = spark.createDataFrame(list(enumerate(langs)), "lang int, name string")
        n = counts.withColumnRenamed("lang", "name").join(F.broadcast(self.numbers), "name").select("lang", "gram", "n")
        head = scratch.keep(bounded(n, capacity // len(langs)))
        for order in (4, 3, 2, 1):
            if order < 4:
                n = scratch.keep(n.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")).agg(F.count("*").alias("n")))
            seen = n.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
            discounts = spark.createDataFrame([(r["lang"], min(0.95, max(0.1, r["once"] / max(1, r["once"] + 2 * r["twice"])))) for r in seen], "lang int, discount double")
            context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
            placed = n.withColumn("context", context)
            totals = placed.groupBy("lang", "context").agg(F.count("*").alias("follow"), F.sum("n").alias("total")).join(F.broadcast(discounts), "lang")
            self.direct[order] = scratch.keep(placed.join(totals, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("direct")))
            self.weight[order - 1] = scratch.keep(totals.select("lang", "context", (F.col("discount") * F.col("follow") / F.col("total")).alias("weight")))
        got = self.resolved(head).toArrow()
        values = np.concatenate([np.zeros(0), *(np.array(c.flatten()) for c in got["bits"].chunks)]).reshape(-1, len(langs))
        self.head = Table(got["gram"].to_numpy().view(U64), values)

    def resolved(self, grams: DataFrame) -> DataFrame:
        """(gram, bits): log2-probabilities in each language of the different ``grams`` (gram), seen or not."""
        gram = F.col("gram")
        x = grams.withColumn("lang", F.explode(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)))).withColumn("p", F.lit(BASE))
        for order in (1, 2, 3, 4):
            part = gram.bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < 4 else gram
            context = F.shiftrightunsigned(part, 16) if order > 1 else F.lit(0).cast("long")
            direct, weight = self.direct[order].withColumnRenamed("gram", "_part"), self.weight[order - 1].withColumnRenamed("context", "_context")
            if order == 1:  # at most a row a character and language
                direct, weight = F.broadcast(direct), F.broadcast(weight)
            x = x.withColumn("_part", part).withColumn("_context", context).join(weight, ["lang", "_context"], "left").join(direct, ["lang", "_part"], "left")
            x = x.select("gram", "lang", (F.coalesce("direct", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        ordered = F.array_sort(F.collect_list(F.struct("lang", F.log2("p").alias("b"))))
        return x.groupBy("gram").agg(F.transform(ordered, lambda y: y["b"]).alias("bits"))

    def bits(self, texts: DataFrame) -> DataFrame:
        """(_row, size, bits): characters, and bits per character in each language, of kept ``texts`` (_row, text)."""
        small_batches(texts.sparkSession)
        sent, L = texts.sparkSession.sparkContext.broadcast(self.head), len(self.langs)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, offsets = text_buffers(b.column(1))
                for i, j in chunked(offsets):
                    part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    chars, bounds = reduced(part, own)
                    g, sizes = _by_text(chars, bounds)
                    doc = np.repeat(np.arange(j - i), sizes)
                    at, found = sent.value.find(g)
                    sums = np.stack([np.bincount(doc[found], sent.value.values[at[found], l], j - i) for l in range(L)], 1).astype(float)
                    doc, g = doc[~found], g[~found]
                    order = np.lexsort((g, doc))
                    doc, g = doc[order], g[order]
                    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.int64)
                    times = np.diff(np.append(first, len(g)))
                    ends = pa.array(np.searchsorted(doc[first], np.arange(j - i + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).slice(i, j - i), pa.array(_characters(part, own, chars, bounds, sizes).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * L), pa.array(sums.ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(g[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                    ], ["_row", "size", "sums", "grams", "times"])

        part = self.scratch.keep(texts.select("_row", text_of(F.col("text")).alias("text")).mapInArrow(tidy(counted), "_row long, size long, sums array<double>, grams array<long>, times array<long>"))
        rest = part.select("_row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("_row", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
        different = self.scratch.keep(rest.groupBy("gram").agg(F.count("*").alias("n")))
        known = self.scratch.keep(self.resolved(different.select("gram")).join(different, "gram"))
        more = join_counted(rest, known, "gram").groupBy("_row").agg(F.array(*[F.sum(F.col("bits")[l] * F.col("times")) for l in range(L)]).alias("more"))
        total = F.zip_with("sums", "more", lambda a, b: a + F.coalesce(b, F.lit(0.0)))
        bits = F.transform(F.when(F.col("more").isNull(), F.col("sums")).otherwise(total), lambda a: -a / F.greatest(F.col("size"), F.lit(1)))
        return part.join(more, "_row", "left").select("_row", "size", bits.alias("bits"))

    def judged(self, texts: DataFrame) -> DataFrame:
        """(_row, lang_pred, score, bits, rejected) of kept ``texts`` (_row, text)."""
        rules = Model([], [])
        rules.langs, rules.limits = self.langs, self.limits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = np.array(b.column(2).flatten()).reshape(-1, len(rules.langs))
                langs, scores, bits, rejected = rules.judge_bits(h, b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], ["_row", "lang_pred", "score", "bits", "rejected"])

        return self.bits(texts).mapInArrow(tidy(run), "_row long, lang_pred string, score double, bits double, rejected boolean")


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows, kept, with a number each (``_row``)."""
    return scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()))


def limit_of(spread: pd.DataFrame, length: int, quantile: float) -> float:
    """The quantile of a length class from its rows by class of entropy (length, class, m, least, most); infinite with too few rows."""
    for more in range(len(LENGTHS) + 1):
        near = spread[(spread["length"] - length).abs() <= more]
        if near["m"].sum() >= THIN:
            break
    else:
        return float("inf")
    near = near.groupby("class").agg(m=("m", "sum"), least=("least", "min"), most=("most", "max")).sort_index()
    m, least, most = (near[k].to_numpy() for k in ("m", "least", "most"))
    ends = np.cumsum(m)

    def ranked(k: int) -> float:
        i = int(np.searchsorted(ends, k, "right"))
        return float(least[i] + (most[i] - least[i]) * (k - ends[i] + m[i]) / max(m[i] - 1, 1))

    place = quantile * (int(ends[-1]) - 1)
    low = int(place)
    return ranked(low) + (ranked(min(low + 1, int(ends[-1]) - 1)) - ranked(low)) * (place - low)


def _by_language(got: pa.Table, langs: list[str], half: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of each of the languages from collected counts (half, lang, gram, n): of one half, or summed over both."""
    if half is not None:
        got = got.filter(pc.equal(got["half"], half))
    code = pc.index_in(got["lang"], pa.array(langs, pa.string())).to_numpy()
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(langs) + 1))
    grams, n, out = got["gram"].to_numpy()[order].view(U64), got["n"].to_numpy()[order], []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        keys, place = np.unique(grams[i:j], return_inverse=True)
        out.append((keys, np.bincount(place, n[i:j]).astype(np.int64)))
    return out


def _spread(seen: DataFrame) -> pd.DataFrame:
    """Entropies (size, bits) counted by length class and class of entropy."""
    length = sum((F.col("size") > n).cast("int") for n in LENGTHS)
    return seen.where("size > 0").groupBy(length.alias("length"), F.floor(F.col("bits") * 1024).alias("class")).agg(F.count("*").alias("m"), F.min("bits").alias("least"), F.max("bits").alias("most")).toPandas()


def _judged_by(models: list[Model], rows: DataFrame) -> DataFrame:
    """(size, bits) of the rows (half, lang, text) whose language the model of the other half has, by that model."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves, langs = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object)
            for half in (0, 1):
                model = sent.value[1 - half]
                raw, offsets = text_buffers(b.column(2).take(pa.array(np.flatnonzero((halves == half) & np.isin(langs, model.langs)))))
                for i, j in chunked(offsets):
                    h, sizes = model.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int64)), pa.array(h.min(1))], ["size", "bits"])

    return rows.select("half", "lang", "text").mapInArrow(tidy(judged), "size long, bits double")


def fit(docs: DataFrame, folds: int = 5, held: int = 0, capacity: int = 1_000_000, quantile: float = 0.9995, slack: float = 1.1, scratch: Scratch | None = None) -> Model | LargeModel:
    """Models from all rows with text and lang outside the held-out remainder."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark)
    fold = id_remainder(F.col("doc_id"), folds)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held))
    half = (F.pmod(fold - held, F.lit(folds)) * 2 > folds).cast("int")
    rows = rows.select(half.alias("half"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as work:
        keyed = count_grams(rows.select(F.concat(F.col("half").cast("string"), "lang").alias("lang"), "text"))
        counted = work.keep(keyed.select(F.substring("lang", 1, 1).cast("int").alias("half"), F.expr("substring(lang, 2)").alias("lang"), "gram", "n"))
        found = {(r["half"], r["lang"]): r["count"] for r in counted.groupBy("half", "lang").count().collect()}
        if not found:
            return Model([], [])
        langs, halves = sorted({lang for _, lang in found}), [sorted(lang for h, lang in found if h == half) for half in (0, 1)]
        if sum(found.values()) <= capacity:
            got = counted.toArrow()
            spread = _spread(_judged_by([Model(halves[h], _by_language(got, halves[h], h)) for h in (0, 1)], rows))
            model = Model(langs, _by_language(got, langs))
        else:
            merged = work.keep(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
            model, parts = LargeModel(langs, merged, capacity, scratch), []
            for h in (0, 1):
                if halves[1 - h]:
                    other = LargeModel(halves[1 - h], counted.where(F.col("half") == 1 - h).drop("half"), capacity, work)
                    texts = rows.where((F.col("half") == h) & F.col("lang").isin(halves[1 - h])).select("text")
                    parts.append(_spread(other.bits(numbered(texts, work)).select("size", F.array_min("bits").alias("bits"))))
            spread = pd.concat([pd.DataFrame(columns=["length", "class", "m", "least", "most"], dtype=float), *parts])
    # Per length, for all languages together: short texts vary more.
    for c in range(len(LENGTHS) + 1):
        limit = limit_of(spread, c, quantile) * slack
        model.limits |= {(i, c): limit for i in range(len(langs))}
    return model


def identify(docs: DataFrame, model: Model | LargeModel) -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected) of every row."""
    if isinstance(model, LargeModel):
        rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.scratch)
        return rows.select("_row", "doc_id").join(model.judged(rows.select("_row", "text")), "_row").drop("_row")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            for i, j in chunked(offsets):
                langs, scores, bits, rejected = sent.value.judge(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(tidy(judged), "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | LargeModel) -> DataFrame:
    """The rows whose language is not rejected, all columns as they are."""
    if isinstance(model, LargeModel):
        rows = numbered(docs, model.scratch)
        return rows.join(model.judged(rows.select("_row", "text")).where("not rejected"), "_row", "left_semi").select(docs.columns)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(place))
            out = [~sent.value.judge(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[3] for i, j in chunked(offsets)]
            yield b.filter(pa.array(np.concatenate(out) if out else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(kept), docs.schema)

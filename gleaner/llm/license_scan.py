"""Licence scans: winnowed template fingerprints propose places, banded alignment measures them.

Words are runs of ASCII letters, digits and non-ASCII bytes, case folded.  Fingerprints are hashes of
``GRAM`` words.  A place that matches enough words of a template, others changed, shares a run of words
with it (``shared_run``).  Where that run has ``GRAM + WINDOW - 1`` words at least, the template's
fingerprints are the minimum of each ``WINDOW`` consecutive hashes (rightmost of equals); else they are
all its hashes, of fewer words where the run is shorter than ``GRAM``.  The templates' fingerprints are
an inverted index (fixed, some thousand entries, sent with the task), and every gram of a text is looked
up in it, so each such place is a candidate; words inserted into or left out of a notice may split its
runs further.  Hits of a template on near diagonals are aligned together, in a band around them, if they
are half as many as the changed words must leave at least (``least_hits``); each alignment reports the
words matched, the share of the template they cover, and where it lies in the text.  Of overlapping
places that match at least ``min_coverage``, the one with the most matched words stays (then the
higher coverage, the earlier, the first template by name).

``templates_in`` reads whole licence texts from a folder; without one, ``license_texts`` has common notices,
headers and short licences.

Defined cases: null and empty texts match nothing; a licence that occurs twice is two rows; repeated
rows give their rows each; a null id stays null; of equal matches the earlier place and the first
template by name stay; an empty table gives an empty result; columns but id and text are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunked, gram_hashes, small_batches, text_buffers, text_of, tidy, word_hashes
from gleaner.llm.license_texts import TEMPLATES

GRAM, WINDOW, BAND = 3, 2, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Stands for words of the text that an alignment has taken.
FOUND = np.uint64(0)

_WORD = np.zeros(256, np.uint8)
_WORD[128:] = np.arange(128, 256)
_WORD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_WORD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_WORD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def scan_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words, and each text's first word (n + 1)."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    folded = _WORD[raw]
    word = folded > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    return word_hashes(folded, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the minimum of each WINDOW consecutive grams (all of them when there are fewer)."""
    if len(grams) <= WINDOW:
        return np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(1))


def shared_run(n: int, min_coverage: float) -> int:
    """Words of the longest run that a place has in common with a template of n words, if at least ``min_coverage`` of them match and the others are changed."""
    changed = next((c for c in range(n - 1, -1, -1) if (n - c) / n >= min_coverage), 0)
    return -(-(n - changed) // (changed + 1))


def least_hits(n: int, k: int, min_coverage: float) -> int:
    """Grams of k words that a place shares with a template of n words, at least, if as in ``shared_run`` each changed word takes k of them; half of that, as insertions take more."""
    changed = next((c for c in range(n - 1, -1, -1) if (n - c) / n >= min_coverage), 0)
    return max(1, (n - k + 1 - changed * k) // 2)


class Index:
    """Fingerprint -> (template, place) postings, for each number of words in a fingerprint."""

    def __init__(self, templates: dict[str, str], min_coverage: float = 0.75):
        self.names = sorted(templates)
        self.words, self.least = [], []
        self.postings: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for t, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            words = scan_words(raw, np.array([0, len(raw)]))[0]
            self.words.append(words)
            self.least.append(1)
            if not len(words):
                continue
            run = shared_run(len(words), min_coverage)
            # Runs of one word are only looked for where the template has no more.
            k = min(GRAM, max(run, 2), len(words))
            grams = gram_hashes(words, k)
            places = winnow(grams) if run >= GRAM + WINDOW - 1 else np.arange(len(grams))
            if len(places) == len(grams):
                self.least[t] = least_hits(len(words), k, min_coverage)
            for p in places.tolist():
                self.postings[k][int(grams[p])].append((t, p))
        self.postings = {k: dict(x) for k, x in self.postings.items()}
        self.keys = {k: np.array(sorted(x), np.uint64) for k, x in self.postings.items()}

    def hits(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each number of words: the places whose gram is in the index, and their hashes."""
        out = {}
        for k, keys in self.keys.items():
            grams = gram_hashes(words, k)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
            out[k] = at, grams[at]
        return out


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """Best local alignment with text place minus template place in low..high: (score, matched, template's words covered by it, start, end in words).

    Scores row by row over the band; the best cell that is a match (the first of equals) is traced back,
    a match or change before a word left out, and that before a word put in.
    """
    n, width = len(template), high - low + 1
    scores, best, at = np.zeros((n + 1, width + 1), np.int32), 0, (0, 0)
    places = np.arange(width)
    for i in range(n):
        a, z = max(0, -(i + low)), min(width, len(words) - i - low)  # the cells of this row that lie in the text
        if a >= z:
            continue
        hit = words[i + low + a : i + low + z] == template[i]
        above = scores[i]
        cell = np.maximum(above[a:z] + np.where(hit, MATCH, MISMATCH), above[a + 1 : z + 1] + GAP)
        np.maximum(cell, 0, out=cell)
        # A word put in costs GAP for each cell to the right: the running maximum, each cell counted from the left.
        cell = np.maximum.accumulate(cell - GAP * places[a:z]) + GAP * places[a:z]
        scores[i + 1, a:z] = cell
        ends = np.where(hit, cell, 0)
        top = int(ends.argmax())
        if ends[top] > best:
            best, at = int(ends[top]), (i, a + top)
    if not best:
        return 0, 0, 0, 0, 0
    (i, d), matched = at, 0
    end = i + low + d + 1
    first_t, first_w = i, end - 1
    last = i
    while True:
        s, j = int(scores[i + 1, d]), i + low + d
        if s <= 0:
            break
        hit = 0 <= j < len(words) and words[j] == template[i]
        before = int(scores[i, d])
        if s == before + (MATCH if hit else MISMATCH):
            matched += bool(hit)
            first_t, first_w = i, j
            i -= 1
        elif s == int(scores[i, d + 1]) + GAP:
            i, d = i - 1, d + 1
        else:
            d -= 1
        if i < 0 or d < 0:
            break
    return best, matched, last + 1 - first_t, first_w, end


def find(index: Index, words: np.ndarray, min_coverage: float) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, first word, end word) in one text, without overlaps, in order."""
    hits = defaultdict(list)
    for k, (at, grams) in index.hits(words).items():
        for p, g in zip(at.tolist(), grams.tolist(), strict=True):
            for t, q in index.postings[k][g]:
                hits[t].append((p - q, p))
    places = []
    for t, found in hits.items():
        found.sort()
        template = index.words[t]
        run = [found[0]]
        for h in [*found[1:], None]:
            if h is not None and h[0] - run[-1][0] <= BAND and h[0] - run[0][0] <= 4 * BAND:
                run.append(h)
                continue
            if len({p - d for d, p in run}) < index.least[t]:
                run = [h]
                continue
            low, high = run[0][0] - BAND, run[-1][0] + BAND
            base = max(0, low)
            part = words[base : max(0, high) + len(template)].copy()
            while True:  # the template may stand here more than once: what has been found is masked
                _, matched, _, a, b = align(template, part, low - base, high - base)
                if not matched or matched / len(template) < min_coverage:
                    break
                places.append((-matched, -matched / len(template), a + base, t, b + base))
                part[a:b] = FOUND
            if h is not None:
                run = [h]
    taken: list[tuple] = []
    for m, c, a, t, b in sorted(set(places)):
        if all(b <= x or a >= y for _, _, _, x, y in taken):
            taken.append((index.names[t], -m, -c, a, b))
    return sorted(taken, key=lambda x: (x[3], x[0]))


def templates_in(folder: str) -> dict[str, str]:
    """The texts of the files in a folder, by file name without its extension."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


SCANNED = "doc_id long, license string, matched_words int, coverage double, start_word int, end_word int, start_byte long, end_byte long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.75) -> DataFrame:
    """``SCANNED``: a row for each licence found in each text."""
    small_batches(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates, min_coverage)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            ids, rows = b.column(0).to_pylist(), []
            for i, j in chunked(offsets):
                hashes, starts, ends, first = scan_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in index.hits(hashes).values())])
                for d in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                    a, z = int(first[d]), int(first[d + 1])
                    for name, matched, coverage, x, y in find(index, hashes[a:z], min_coverage):
                        rows.append((ids[i + d], name, matched, coverage, x, y, int(starts[a + x] - (offsets[i + d] - offsets[i])), int(ends[a + y - 1] - (offsets[i + d] - offsets[i]))))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "matched_words", "coverage", "start_word", "end_word", "start_byte", "end_byte"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return rows.mapInArrow(tidy(scanned), SCANNED)

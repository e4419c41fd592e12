"""Periodic runs of words: heavy and light lag counting, then island scans.

A run is a stretch of words that repeats with a smallest period of q words at least four times (six words at least) and
that no neighbour extends. A word that occurs less than four times is in no run, so such words part a text, again and again, into
pieces. Every run is found, whatever a text's length: a piece's lags are handled in bands that double, each over
overlapping stretches as long as that band's runs ask for. In a stretch the number of equal pairs is counted for
all lags of the band at once, exactly: frequent words by the FFT autocorrelation of their places, rare ones by the differences
of their places. Only lags with as many matches as a run would need are scanned for islands of consecutive matches: first at every
q/8-th place, then at eight times as many inside of the islands of those, and so on. A text is read by one task and nothing is shuffled.

Defined cases: null text has no words; a text without words has no run; a null doc_id gives a text that is left as it is;
repeated rows give equal results; runs of equal length are told apart by start, then period; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, cut, tidy

#: A run has this many periods and words at least.
TIMES, WORDS = 4, 6
#: Lags below this are the first band; a stretch is SPAN times as long as a band's end.
BAND, SPAN = 512, 16
#: Samples a period in the first look at a lag; every further look takes so many times as many.
SAMPLES = 8
#: Pairs that are gone through at a time, and what one costs, in butterflies of a transform.
STEP, PAIR_COST = 1 << 20, 6.0


def need(q: np.ndarray) -> np.ndarray:
    """Consecutive matches at lag q that a run of period q has."""
    return np.maximum(WORDS, TIMES * q) - q


def lag_matches(words: np.ndarray, least: int, most: int, pair_cost: float = PAIR_COST) -> np.ndarray:
    """For each lag from ``least`` on below ``most`` the number of equal pairs of words that far apart, exactly.

    A word is frequent when going through its pairs would cost more than a transform: it is counted by FFT, others by the differences of their places.
    """
    n = len(words)
    place = np.argsort(words, kind="stable").astype(np.int32)
    group = words[place]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = np.zeros(n, np.int64)
    number[first[1:]] = 1
    key = np.cumsum(number) * (n + most) + place
    next_ = np.searchsorted(key, key + least)  # the first place of the same word that is far enough
    pairs = np.searchsorted(key, key + most) - next_
    width = 1 << (n + most - 1).bit_length()
    heavy = np.add.reduceat(pairs, first) * pair_cost > width * width.bit_length()
    counts = np.zeros(most, np.int64)
    pairs[np.repeat(heavy, np.diff(np.r_[first, n]))] = 0
    done = np.r_[0, np.cumsum(pairs)]
    a = 0
    while a < n and done[a] < done[-1]:
        b = max(a + 1, int(np.searchsorted(done, done[a] + STEP, "right")) - 1)
        own = pairs[a:b]
        other = np.arange(int(done[b] - done[a]), dtype=np.int32) + np.repeat((next_[a:b] - (done[a:b] - done[a])).astype(np.int32), own)
        counts += np.bincount(place[other] - np.repeat(place[a:b], own), minlength=most)
        a = b
    if heavy.any():  # one power spectrum of all
        power, ends = np.zeros(width // 2 + 1), np.r_[first, n]
        for j in np.flatnonzero(heavy):
            where = np.zeros(width)
            where[place[ends[j] : ends[j + 1]]] = 1
            seen = np.fft.rfft(where)
            power += seen.real**2 + seen.imag**2
        counts += np.rint(np.fft.irfft(power, width)[:most]).astype(np.int64)
    return counts[least:]


def bands(n: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, end of lags, length of stretches) for a text of n words."""
    lo, hi = 1, BAND
    while lo <= n // TIMES:
        yield lo, min(hi, n // TIMES + 1), SPAN * hi
        lo, hi = hi, 2 * hi


def _islands(one: np.ndarray, two: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of ``least`` or more places where both are equal."""
    apart = np.flatnonzero(one != two)
    edges = np.empty(len(apart) + 2, np.int64)
    edges[0], edges[1:-1], edges[-1] = -1, apart, len(one)
    long = np.flatnonzero(edges[1:] - edges[:-1] > least)
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


def _extended(words: np.ndarray, q: int, a: int, b: int) -> tuple[int, int]:
    """Matches a..b-1 at lag q with all that follow on either side."""
    step = 64
    while a > 0:
        low = max(0, a - step)
        other = np.flatnonzero(words[low:a] != words[low + q : a + q])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a, step = low, 2 * step
    end, step = len(words) - q, 64
    while b < end:
        high = min(end, b + step)
        other = np.flatnonzero(words[b:high] != words[b + q : high + q])
        if len(other):
            b += int(other[0])
            break
        b, step = high, 2 * step
    return a, b


def pieces(rare: np.ndarray, least: int = WORDS) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that aren't rare, of ``least`` words or more."""
    return _islands(rare, np.zeros(len(rare), bool), least)


def rare_words(words: np.ndarray) -> np.ndarray:
    """Whether each word occurs less than TIMES times: such words are in no run."""
    _, code, count = np.unique(words, return_inverse=True, return_counts=True)
    return count[code] < TIMES


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words (codes), by start, then period."""
    out, todo = [], [(0, len(words))]
    while todo:
        a, b = todo.pop()
        rare = rare_words(words[a:b])
        if rare.any():  # what lies between such words is a text of its own, in which others may be rare
            todo += [(a + i, a + j) for i, j in pieces(rare)]
        else:
            out += [(a + i, size, q) for i, size, q in _piece_runs(words[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _piece_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``runs`` of words each of which occurs TIMES times or more."""
    found: dict[tuple[int, int], int] = {}
    owner: list[tuple[int, int, int]] = []
    n = len(words)
    held = np.full(n, -1, np.int32)  # of each word the longest run met so far

    def known(a: int, b: int) -> tuple[int, int, int] | None:
        """The run that holds the words a..b-1, as far as the middle one tells."""
        k = held[(a + b) // 2]
        return owner[k] if k >= 0 and owner[k][0] <= a and owner[k][1] >= b else None

    def look(q: int, base: int, part: np.ndarray) -> None:
        least, m = int(need(np.int64(q))), len(part) - q
        step, regions = max(1, q // SAMPLES), [(0, m)]
        while regions:
            near = []
            for low, high in regions:
                for i, j in _islands(part[low:high:step], part[low + q : high + q : step], least // step):
                    one, two = low + i * step, low + (j - 1) * step  # the first and last match that was looked at
                    run = known(base + one, base + two + q + 1)
                    if not run or q % run[2]:  # else its words are that run's, with a smaller period
                        near.append((max(low, one - step + 1), min(high, two + step)))
            if step == 1:
                break
            step, regions = max(1, step // SAMPLES), near
        else:
            return
        for a, b in near:
            a, b = _extended(words, q, base + a, base + b)
            key = (a, b + q)
            if found.setdefault(key, q) >= q:
                found[key] = q
                if known(*key) is None:
                    owner.append((*key, q))
                    held[a : b + q] = len(owner) - 1

    for lo, hi, span in bands(n):
        least = need(np.arange(lo, hi))
        over = TIMES * hi
        for base in range(0, max(1, n - over), span - over):
            part = words[base : base + span]
            if len(part) < max(WORDS, TIMES * lo):
                continue
            run = known(base, base + len(part))
            end = min(hi, run[2]) if run else hi  # other periods than a run's own are shorter when they lie inside of it
            if end > lo:
                for q in (lo + np.flatnonzero(lag_matches(part, lo, end) >= least[: end - lo])).tolist():
                    look(q, base, part)
    return [(a, b - a, q) for (a, b), q in found.items()]


def repeated_places(n: int, doc_id: int | None) -> np.ndarray:
    """Places of the words as the query has them: of every tenth document, told by a hash of its id, a tail repeats."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def collapsed(length: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of every run only the first period does."""
    edge = np.zeros(length + 1, np.int64)
    for a, size, q in found:
        edge[a + q] += 1
        edge[a + size] -= 1
    return np.cumsum(edge[:-1]) == 0


class Texts:
    """The words of some texts, and the runs of each."""

    def __init__(self, batch: pa.RecordBatch, planted: bool = False):
        words = Words(batch.column("text"))
        self.doc_ids, self.uniques, self.offsets, self.codes = batch.column("doc_id").to_pylist(), words.uniques, words.offsets, words.codes
        if planted:
            self.codes = self.codes.copy()
            for k, doc_id in enumerate(self.doc_ids):
                own = self.codes[self.offsets[k] : self.offsets[k + 1]]
                own[:] = own[repeated_places(len(own), doc_id)]
        # Words that are rare in their text, of all texts at once; most texts have no stretch without any.
        owner = np.repeat(np.arange(len(self.doc_ids), dtype=np.int64), np.diff(self.offsets))
        rare = rare_words(owner * max(1, len(self.uniques)) + self.codes)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in self.doc_ids]
        for k, (a, b) in enumerate(zip(self.offsets[:-1], self.offsets[1:], strict=True)):
            for i, j in pieces(rare[a:b]):
                self.runs[k] += [(i + x, size, q) for x, size, q in runs(self.codes[a + i : a + j])]

    def joined(self, stay: np.ndarray) -> list[bytes]:
        """Each text's words that stay, with one space between them."""
        offsets = np.r_[0, np.cumsum(stay)][self.offsets]
        words = pc.cast(self.uniques, pa.large_binary()).take(pa.array(self.codes[stay]))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words), pa.scalar(b" ", pa.large_binary())).to_pylist()


def _rows(batch: pa.RecordBatch, planted: bool) -> list[tuple]:
    texts, rows = Texts(batch, planted), []
    stay = np.concatenate([np.zeros(0, bool), *(collapsed(n, found) for n, found in zip(np.diff(texts.offsets), texts.runs, strict=True))])
    for doc_id, found, text in zip(texts.doc_ids, texts.runs, texts.joined(stay), strict=True):
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
        rows.append((doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: how many runs it has, the longest one, and hashes of all runs and of the words that stay when every run is collapsed to one period. With ``planted`` texts are changed by ``repeated_places`` before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text"):
                columns = list(zip(*_rows(part, planted), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])
        tidy()

    return _texts(docs).mapInArrow(run, SCHEMA)


def runs_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period, exponent_milli, unit): a row for each run of each document, with the words of its first period."""
    names = ("doc_id", "start", "length", "period", "exponent_milli", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text"):
                texts, rows = Texts(part), []
                for k, found in enumerate(texts.runs):
                    for a, size, q in found:
                        at = int(texts.offsets[k]) + a
                        rows.append((texts.doc_ids[k], a, size, q, 1000 * size // q, " ".join(texts.uniques.take(pa.array(texts.codes[at : at + q])).to_pylist())))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "unit" else pa.int64()) for c, name in zip(columns, names, strict=True)], list(names))
        tidy()

    return _texts(docs).mapInArrow(run, "doc_id long, start long, length long, period long, exponent_milli long, unit string")

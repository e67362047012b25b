"""Topics of texts: k-means clusters of their words, for the marginals of a mix.

A text's features are the counts of its words of 3 to 15 letters, in lower case, hashed to `FEATURES` numbers, weighted by how rare they are and divided by their length. The clusters are fitted
on all texts: their features are written once, then read by each pass, of which there is one for the weights, some for the seeds (drawn far from the seeds before) and one for each round of
moving the centres. What the driver gets of a pass are sums by centre and feature, or the features of `CANDIDATES` texts. Every text gets the cluster nearest to its whole text, where its words are split for
the tokenizer.

Cases. A null text and one without such words get the cluster nearest to nothing. Texts of equal features count once. Points and centres are whole multiples of 1 / `UNIT`, so that their products
and sums are exact, and draws go by hash of the features: clusters depend on the texts, not on their order, partitions or keys. Without a text with words there is one cluster."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import PIECE, _pieces, split
from tidemark.shipping import shipped
from tidemark.storage import written

TOPICS = 16
#: Numbers that words are hashed to. SAMPLE_ROWS has no effect any more, since nothing is sampled; a test sets it.
SAMPLE_ROWS, FEATURES = 5_000, 1_024
ROUNDS = 20
#: Texts whose features are held at once, and those of them that are compared with the centres at once.
ROWS, CHUNK = 2_000, 250
UNIT = 1 << 24
#: Texts that a pass finds for the next seeds; they spare passes and change no seed.
CANDIDATES = 250
#: Bits of a count that stand in one entry of a text's packed features.
COUNT_BITS = 22


def _features(codes: np.ndarray, words: list[str], per_text: np.ndarray) -> Iterator[np.ndarray]:
    """Counts by text and feature, for some texts after the other. Arguments: as by split()."""
    feature = np.full(len(words) + 1, -1, np.int64)
    for i, word in enumerate(words):
        word = word.strip().lower()
        if 3 <= len(word) <= 15 and word.isalpha():
            feature[i] = zlib.crc32(word.encode()) % FEATURES
    ends = np.append(0, np.cumsum(per_text))
    for i in range(0, len(per_text), ROWS):
        n = min(ROWS, len(per_text) - i)
        own = feature[codes[ends[i] : ends[i + n]]]
        at = np.repeat(np.arange(n), per_text[i : i + n]) * FEATURES + own
        yield np.bincount(at[own >= 0], minlength=n * FEATURES).reshape(n, FEATURES)


@lru_cache(1)
def _mix() -> np.ndarray:
    """A fixed random number for each feature."""
    return np.random.default_rng(1).integers(1, 2**63, FEATURES, dtype=np.uint64)


@dataclass(frozen=True)
class Counts:
    """The features that some texts have: the text's number, the feature and its count, in order of text and feature; and how many texts they are."""

    row: np.ndarray
    feature: np.ndarray
    n: np.ndarray
    rows: int


def _sparse(counts: np.ndarray) -> Counts:
    row, feature = np.nonzero(counts)
    return Counts(row, feature, counts[row, feature], len(counts))


def _packed(c: Counts) -> pa.Array:
    """By text, 4 bytes for each feature: the count above the feature's 10 bits. A higher part of a count, if any, stands in a second entry of the feature."""
    high = c.n >> COUNT_BITS
    entry = np.repeat(np.arange(len(c.n)), 1 + (high > 0))
    second = np.append(False, entry[1:] == entry[:-1])[: len(entry)]
    n = np.where(second, high[entry], c.n[entry] & ((1 << COUNT_BITS) - 1))
    data = (n.astype(np.uint32) << np.uint32(10)) | c.feature[entry].astype(np.uint32)
    ends = np.append(0, np.cumsum(np.bincount(c.row[entry], minlength=c.rows))) * 4
    return pa.Array.from_buffers(pa.binary(), c.rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array) -> Iterator[Counts]:
    """The texts of _packed(), some after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for i in range(0, len(column), CHUNK):
        own = ends[i : i + CHUNK + 1]
        data = bytes_[own[0] : own[-1]].view(np.uint32)
        row = np.repeat(np.arange(len(own) - 1), np.diff(own) // 4)
        feature, n = (data & np.uint32(FEATURES - 1)).astype(np.int64), (data >> np.uint32(10)).astype(np.int64)
        second = np.flatnonzero((feature[1:] == feature[:-1]) & (row[1:] == row[:-1])) + 1
        if len(second):
            n[second - 1] += n[second] << COUNT_BITS
            row, feature, n = (np.delete(x, second) for x in (row, feature, n))
        yield Counts(row, feature, n, len(own) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centres: np.ndarray

    def points(self, c: Counts) -> np.ndarray:
        """The weight in its text of each feature that a text has."""
        x = c.n * self.weights[c.feature]
        length = np.sqrt(np.bincount(c.row, x * x, c.rows))
        return np.rint(x / np.maximum(length, 1e-12)[c.row] * UNIT) / UNIT

    def away(self, c: Counts, points: np.ndarray) -> np.ndarray:
        """By text and centre: the square of their distance less the square of the text's own length."""
        wide = np.zeros((c.rows, FEATURES))
        wide.reshape(-1)[c.row * FEATURES + c.feature] = points
        return (self.centres * self.centres).sum(axis=1) - 2 * wide @ self.centres.T

    def __call__(self, codes: np.ndarray, words: list[str], per_text: np.ndarray) -> np.ndarray:
        """The topic of each of some texts, given as by split()."""
        out = [np.zeros(0, np.int64)]
        for counts in _features(codes, words, per_text):
            for i in range(0, len(counts), CHUNK):
                c = _sparse(counts[i : i + CHUNK])
                out.append(self.away(c, self.points(c)).argmin(axis=1))
        return np.concatenate(out)


def _having(c: Counts) -> np.ndarray:
    """How many texts have each feature; at the end, how many texts there are."""
    return np.append(np.bincount(c.feature, minlength=FEATURES), c.rows)


def _sums(model: Model, c: Counts) -> np.ndarray:
    """By the nearest centre: the sums of its texts by feature, in 1 / `UNIT`, and how many they are. A text of nothing but features that all have counts nowhere."""
    x = model.points(c)
    near = model.away(c, x).argmin(axis=1)
    width = FEATURES + 1
    out = np.bincount(near[c.row] * width + c.feature, x * UNIT, len(model.centres) * width).astype(np.int64)
    some = np.bincount(c.row, x * x, c.rows) > 0
    out[FEATURES::width] = np.bincount(near[some], minlength=len(model.centres))
    return out


def _due(model: Model, times: list[float], c: Counts) -> np.ndarray:
    """When each text (each with a feature) would be the next seed, if model has the seeds so far and they were due at times.

    A text is due at a rate of the square of its distance from the nearest seed, so the next seed is drawn in proportion to that; the first is any text. Rates only fall, so with more seeds a
    text is due no earlier."""
    x = model.points(c)
    own = np.bincount(c.row, x * x, c.rows)[:, None]
    rate = np.minimum.accumulate(np.hstack([np.full_like(own, 3), own + model.away(c, x)]), axis=1)
    rate[(rate <= 1e-9) | (own == 0)] = 0
    mark = np.add.reduceat(c.n.astype(np.uint64) * _mix()[c.feature], np.searchsorted(c.row, np.arange(c.rows)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mark = (mark ^ (mark >> np.uint64(shift))) * np.uint64(factor)
    chance = (((mark ^ (mark >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2**53
    left = np.maximum(-np.log(chance) - (rate[:, :-1] * np.diff([0.0, *times])).sum(axis=1), 0)
    return np.divide(left, rate[:, -1], out=np.full(c.rows, np.inf), where=rate[:, -1] > 0) + (times[-1] if times else 0.0)


def _soonest(model: Model, times: list[float], some: Iterable[Counts]) -> list[tuple[float, bytes]]:
    """Of some texts the `CANDIDATES` that are due first: when, and their features."""
    best: list[tuple[float, bytes]] = []
    for c in some:
        due = _due(model, times, c)
        most = best[-1][0] if len(best) == CANDIDATES else np.inf
        at = np.flatnonzero(np.isfinite(due) & (due <= most))
        best = sorted([*best, *((float(due[i]), _one(c, i)) for i in at)])[:CANDIDATES]
    return best


def _one(c: Counts, i: int) -> bytes:
    own = slice(*np.searchsorted(c.row, [i, i + 1]))
    return _packed(Counts(c.row[own] - i, c.feature[own], c.n[own], 1))[0].as_py()


def _fit(k: int, summed: Callable[[Callable[[Counts], np.ndarray], int], np.ndarray], soonest: Callable[[Model, list[float]], list[tuple[float, bytes]]]) -> Model:
    """summed: the sum over all texts of a function of some of them, with so many values. soonest: _soonest() of all texts."""
    having = summed(_having, FEATURES + 1)
    model = Model(np.log((1 + having[-1]) / (1 + having[:-1])), np.zeros((0, FEATURES)))
    times: list[float] = []
    found: list[tuple[float, bytes]] = []
    bound = -np.inf  # no other text is due before
    while len(times) < k:
        best = _soonest(model, times, _unpacked(pa.array([f for _, f in found], pa.binary())))
        if not best or best[0][0] > bound:
            best = found = soonest(model, times)
            bound = found[-1][0] if len(found) == CANDIDATES else np.inf
            if not found:
                break
        new = next(_unpacked(pa.array([best[0][1]], pa.binary())))
        centre = np.zeros(FEATURES)
        centre[new.feature] = model.points(new)
        times.append(best[0][0])
        model = Model(model.weights, np.vstack([model.centres, centre]))
    if not times:
        return Model(model.weights, np.zeros((1, FEATURES)))
    for _ in range(ROUNDS):
        sums = summed(lambda c, model=model: _sums(model, c), len(model.centres) * (FEATURES + 1)).reshape(-1, FEATURES + 1)
        size = sums[:, -1:]
        new = np.where(size > 0, np.rint(sums[:, :-1] / np.maximum(size, 1)) / UNIT, model.centres)
        if np.allclose(new, model.centres):
            break
        model = Model(model.weights, new)
    return model


def clustered(counts: np.ndarray, k: int) -> Model:
    """The same as fitted() in one process. counts: by text and feature."""
    column = _packed(_sparse(np.unique(counts[counts.any(axis=1)], axis=0)))
    return _fit(k, lambda f, size: sum((f(c) for c in _unpacked(column)), np.zeros(size, np.int64)), lambda model, times: _soonest(model, times, _unpacked(column)))


def fitted(documents: DataFrame, text: str = "text", k: int = TOPICS) -> Model:
    """The clusters of all texts of documents."""
    shipped(documents.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _pieces(batches, PIECE):
            for counts in _features(*split(texts)):
                yield pa.RecordBatch.from_arrays([_packed(_sparse(counts[counts.any(axis=1)]))], ["features"])

    rows = documents.filter(F.trim(text) != "").select(F.lit(0).alias("key"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(count, "features binary").distinct(), "features")

    def summed(f: Callable[[Counts], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(size, np.int64)
            for batch in batches:
                for c in _unpacked(batch.column(0)):
                    own += f(c)
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], ["at", "n"])

        got = rows.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[got["at"].to_numpy()] = got["n"].to_numpy()
        return out

    def soonest(model: Model, times: list[float]) -> list[tuple[float, bytes]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _soonest(model, times, (c for batch in batches for c in _unpacked(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array([due for due, _ in best], pa.float64()), pa.array([f for _, f in best], pa.binary())], ["due", "features"])

        got = rows.mapInArrow(run, "due double, features binary").orderBy("due", "features").limit(CANDIDATES).toArrow()  # collect() would merge the tasks' candidates on the driver
        return sorted(zip(got["due"].to_pylist(), got["features"].to_pylist(), strict=True))

    return _fit(k, summed, soonest)

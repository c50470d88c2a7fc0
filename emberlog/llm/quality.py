"""Text quality by a factorisation machine.

A text's features are its hashed words, structure statistics cut into the bins of the learned texts, and the table's
``n_chars``. The machine adds to a linear model the product of every pair of features, weighed by the inner product of
their short factors; ``sum of squares`` makes that linear in the number of features: the pairs of a text sum to half
of the square of the summed factors less the summed squares. It is fitted by Adagrad on the log loss, over a bounded sample of
labelled texts in one task; only its parameters pass through the driver. Every whole text is scored.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import crc_mod

#: Labelled texts learned from at most, each of them whole.
SAMPLE_ROWS = 4000
#: Slots of hashed words, factors of a feature, bins of a statistic.
SLOTS, RANK, BINS = 1 << 14, 8, 12
#: Passes over the sample, more where they would make fewer than ``STEPS`` batches.
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 600, 64, 0.1, 1e-4
STATISTICS = 14
WIDTH = SLOTS + (STATISTICS + 1) * (BINS + 1)
#: Texts taken from an Arrow batch, and features scored, at a time.
TEXTS, FEATURES = 64, 200_000
CACHE_BYTES = 8 << 20


def _classes() -> np.ndarray:
    kind = np.full(256, 5, np.int64)  # marks
    for code in range(256):
        if code >= 128:
            kind[code] = 0  # part of a letter beyond ASCII, mostly
        elif chr(code).isalpha():
            kind[code] = 1 + chr(code).isupper()
        elif chr(code).isdigit():
            kind[code] = 3
        elif chr(code).isspace():
            kind[code] = 4
        elif chr(code) in ".,;:!?'\"-()":
            kind[code] = 6
    return kind


KINDS = _classes()


def statistics(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text: what it is made of, how often it repeats itself, how long its parts are."""
    size, n = max(1, len(data)), max(1, len(words))
    kinds = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=7) / size
    lines = data.split(b"\n")
    top = max(counts.values(), default=0)
    ends = sum(1 for line in lines if line.rstrip()[-1:] in (b".", b"!", b"?", b":"))
    return [
        *kinds.tolist(),
        len(counts) / n,
        top / n,
        sum(map(len, words)) / n,
        np.log1p(len(data)),
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        ends / len(lines),
    ]


class Extractor:
    """Slots and weights of a text's words, and its statistics; remembers slots of frequent words within a bound of bytes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.room = CACHE_BYTES

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        counts = Counter(words)
        slots = np.fromiter((self.slot(w) for w in counts), np.int32, len(counts))
        weights = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        weights = np.bincount(slots, weights, SLOTS) if len(slots) > SLOTS // 8 else weights
        if len(weights) == SLOTS:  # very long texts: a slot once
            slots = np.flatnonzero(weights).astype(np.int32)
            weights = weights[slots]
        weights /= max(1e-12, float(np.sqrt((weights**2).sum())))
        meta = -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))
        return slots, weights.astype(np.float32), [*statistics(data, words, counts), meta]

    def slot(self, word: bytes) -> int:
        slot = self.known.get(word)
        if slot is None:
            slot = zlib.crc32(word.lower()) % SLOTS
            if self.room > len(word) + 100:
                self.room -= len(word) + 100
                self.known[word] = slot
        return slot


@dataclass
class Machine:
    edges: np.ndarray  # statistics x inner bin edges
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def columns(self, slots: np.ndarray, weights: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        return with_bins(self.edges, slots, weights, stats)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1."""
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        return sigmoid(_raw(self.bias, self.linear, self.factors, index, value, starts)[0])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, edges=self.edges, bias=self.bias, linear=self.linear, factors=self.factors)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Machine:
        held = np.load(io.BytesIO(blob))
        return cls(held["edges"], float(held["bias"]), held["linear"], held["factors"])


def with_bins(edges: np.ndarray, slots: np.ndarray, weights: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """A text's feature numbers and values: its words, then one bin of each statistic."""
    bins = (edges < np.array(stats)[:, None]).sum(axis=1)
    places = SLOTS + np.arange(len(stats)) * (BINS + 1) + bins
    share = np.full(len(stats), 1 / np.sqrt(len(stats)), np.float32)
    return np.concatenate([slots, places.astype(np.int32)]), np.concatenate([weights, share])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _raw(bias, linear, factors, index, value, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each text, summed factors of each text, and weighed factors of each feature."""
    weighed = factors[index] * value[:, None]
    summed = np.add.reduceat(weighed, starts)
    squares = np.add.reduceat((weighed**2).sum(axis=1), starts)
    return bias + np.add.reduceat(linear[index] * value, starts) + 0.5 * ((summed**2).sum(axis=1) - squares), summed, weighed


def fit(texts: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad over shuffled batches; ``labels`` in [0, 1]. The same input gives the same machine."""
    rng = np.random.default_rng(seed)
    stats = np.array([t[2] for t in texts])
    edges = np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    rows = [with_bins(edges, *t) for t in texts]
    linear, factors = np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            index, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            raw, summed, weighed = _raw(bias, linear, factors, index, value, starts)
            error = np.repeat(sigmoid(raw) - labels[part], sizes)
            slots, at = np.unique(index, return_inverse=True)
            pulled = (error * value)[:, None] * (np.repeat(summed, sizes, axis=0) - weighed)
            gradient = np.bincount(at, error * value, len(slots)) / len(part) + DECAY * linear[slots]
            seen_linear[slots] += gradient**2
            linear[slots] -= RATE * gradient / np.sqrt(seen_linear[slots])
            for f in range(RANK):
                gradient = np.bincount(at, pulled[:, f], len(slots)) / len(part) + DECAY * factors[slots, f]
                seen_factors[slots, f] += gradient**2
                factors[slots, f] -= RATE * gradient / np.sqrt(seen_factors[slots, f])
            step = float((sigmoid(raw) - labels[part]).mean())
            seen_bias += step**2
            bias -= RATE * step / seen_bias**0.5
    return Machine(edges, bias, linear, factors)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: features of the sampled texts, in an order of their own, and the machine fitted to them."""
    extract, held = Extractor(), []
    for batch in batches:
        for begin in range(0, batch.num_rows, TEXTS):
            for key, text, n_chars, label in zip(*(c.to_pylist() for c in batch.slice(begin, TEXTS).columns)):
                held.append((key, label, extract(text, n_chars)))
    if held:
        held.sort(key=lambda x: x[0])
        machine = fit([x[2] for x in held], np.array([x[1] for x in held]))
        yield pa.RecordBatch.from_arrays([pa.array([machine.dump()], pa.binary())], ["machine"])


def learned(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, rows: int) -> bytes | None:
    """The machine fitted to at most ``rows`` labelled training texts, those of least hash of the id; None without any."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .filter(training & F.col("label").isNotNull() & ~F.isnan("label"))
        .groupBy("doc_id")
        .agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("label"))).alias("label"))
    )
    chosen = marks.join(docs.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` small rows
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", "n_chars")).alias("own"), F.first("label").alias("label"))
        .select("doc_id", "own.text", "own.n_chars", "label")
    )
    found = sample.repartition(1).mapInArrow(_fit_task, "machine binary").collect()
    return bytes(found[0]["machine"]) if found else None


def _scorer(blob: bytes | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, extract = (Machine.load(blob) if blob else None), Extractor()
        for batch in batches:
            scores: list[float] = []
            for begin in range(0, batch.num_rows if machine else 0, TEXTS):
                part = batch.slice(begin, TEXTS)
                rows, size = [], 0
                for text, n_chars in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "n_chars"))):
                    rows.append(machine.columns(*extract(text, n_chars)))
                    size += len(rows[-1][0])
                    if size >= FEATURES:
                        scores += machine.scores(rows).tolist()
                        rows, size = [], 0
                if rows:
                    scores += machine.scores(rows).tolist()
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(scores if machine else [0.5] * batch.num_rows, pa.float64())], [*names, "score"]
            )

    return score


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text, n_chars) for how likely its label is 1.

    Learned are at most ``sample_rows`` labelled documents whose crc32 of the id is not ``held_out_fold`` modulo ``folds``, each
    read whole. Labels of an id are averaged, null ones ignored; of rows that repeat an id the least text is learned from. Returns
    doc_id, held_out, score in [0, 1] and predicted (score at least ``threshold``), a row per row. A null text counts as empty, a null n_chars as
    a value of its own; a null id is neither held out nor learned from. Where nothing could be learned every score is
    0.5. Other columns are ignored. No rows in: no rows out.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars")
    )
    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    machine = learned(docs, labels, label_col, F.col("doc_id").isNotNull() & ~held_out, sample_rows)
    scored = docs.withColumn("held_out", held_out).mapInArrow(
        _scorer(machine, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))

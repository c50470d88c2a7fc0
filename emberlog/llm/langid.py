"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (lengths 1 to 3 together, each counted once) that both
hold, over the geometric mean of what each holds. A Nyström model keeps a few landmark texts; one-versus-rest kernel
ridge regression on kernels to the landmarks gives a value per language. Whole texts are scored in batches: a
presence matrix times the landmarks' presence matrix is the kernel, and that times the coefficients the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import crc_mod

UNKNOWN = "und"
#: The fit reads at most so many labelled texts of a language, each of them whole.
TEXTS_PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 24
RIDGE = 1e-4
#: Score below which a text is taken for none of the languages; one of 10,000 given texts, a mere list of insults, is below.
LEAST_SCORE = 0.4
#: Texts scored in one matrix product.
BATCH = 128


def letter_table() -> np.ndarray:
    """Lower-case code of each letter of the basic plane, a space for all else."""
    codes = np.full(0x10000, 32, np.uint64)
    for code in range(0x10000):
        if chr(code).isalpha():
            codes[code] = code
    return codes


def spectrum(text: str, table: np.ndarray) -> np.ndarray:
    """Sorted distinct n-grams of lengths 1 to 3, packed in 21 bits a character; non-letters are one kind of gap."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 0x10000, table[np.minimum(code, 0xFFFF)], code.astype(np.uint64))
    code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))] if len(code) else code
    shift = np.uint64(21)
    pairs = (code[:-1] << shift) | code[1:]
    return np.unique(np.concatenate([code, pairs, (pairs[:-1] << shift) | code[2:]]))


@dataclass
class KernelModel:
    languages: list[str]
    grams: np.ndarray  # distinct n-grams of the landmarks, sorted
    landmarks: np.ndarray  # presence of each n-gram in each landmark
    sizes: np.ndarray  # distinct n-grams of each landmark
    coefficients: np.ndarray | None = None  # landmarks x languages

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(spectra), len(self.grams)), np.float32)
        for row, found in enumerate(spectra):
            at = np.searchsorted(self.grams, found)
            at[at == len(self.grams)] = 0
            present[row, at[self.grams[at] == found]] = 1
        sizes = np.sqrt(np.array([max(1, len(s)) for s in spectra], np.float64))
        shared = (present @ self.landmarks.astype(np.float32).T).astype(np.float64)
        return shared / sizes[:, None] / np.sqrt(np.maximum(1, self.sizes))[None, :]

    def predict(self, spectra: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text and its value, moved from [-1, 1] to [0, 1]."""
        values = self.kernel(spectra) @ self.coefficients
        best = values.argmax(axis=1)
        return best, np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)


def fit(texts: list[str], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE):
    """Ridge regression on kernels to the first texts of each language; None without a labelled text."""
    table = letter_table()
    return fit_spectra([spectrum(text, table) for text in texts], labels, landmarks_per_language, ridge)


def fit_spectra(
    spectra: list[np.ndarray], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE
) -> KernelModel | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    chosen = [i for one in languages for i in [k for k, x in enumerate(labels) if x == one][:landmarks_per_language]]
    grams = np.unique(np.concatenate([spectra[i] for i in chosen]))
    presence = np.array([np.isin(grams, spectra[i], assume_unique=True) for i in chosen], np.uint8)
    model = KernelModel(languages, grams, presence, np.array([len(spectra[i]) for i in chosen], np.float64))
    to_all, among = model.kernel(spectra), model.kernel([spectra[i] for i in chosen])
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1 / np.array([labels.count(x) for x in labels], np.float64)[:, None]  # every language counts the same
    system = to_all.T @ (weight * to_all) + ridge * among + 1e-9 * np.eye(len(chosen))
    model.coefficients = np.linalg.solve(system, to_all.T @ (weight * target))
    return model


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = letter_table()
    for batch in batches:
        ids, labels, texts = batch.columns
        grams = pa.array([spectrum(t or "", table).tobytes() for t in texts.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, labels, grams], ["doc_id", "lang", "grams"])


def labelled_sample(docs: DataFrame, training: Column, per_language: int) -> tuple[list[np.ndarray], list[str]]:
    """Spectra of whole texts and labels of at most ``per_language`` training rows a language, those of least hash of the id.

    Only the distinct n-grams come to the driver, whose number the length of a text hardly moves.
    """
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r.doc_id for r in known.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id").collect()]
    if not ids:
        return [], []
    rows = (
        docs.filter(training & F.col("lang").isNotNull() & F.col("doc_id").isin(ids))
        .select("doc_id", "lang", "text")
        .mapInArrow(_spectra, "doc_id long, lang string, grams binary")
        .collect()
    )
    rows.sort(key=lambda r: (hash_order(r.doc_id), r.lang, bytes(r.grams)))
    return [np.frombuffer(r.grams, np.uint64) for r in rows], [r.lang for r in rows]


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF


def _scorer(
    model: KernelModel | None, columns: list[str], answer: tuple[str, str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for begin in range(0, len(texts), BATCH):
                part = texts.slice(begin, BATCH).to_pylist()
                languages, scores = [UNKNOWN] * len(part), [0.0] * len(part)
                usable = [i for i, t in enumerate(part) if model and t and any(map(str.isalpha, t))]
                if usable:
                    best, value = model.predict([spectrum(part[i], table) for i in usable])
                    for i, language, v in zip(usable, best.tolist(), value.tolist()):
                        languages[i], scores[i] = model.languages[language], v
                kept = [batch.column(batch.schema.get_field_index(c)).slice(begin, BATCH) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    [*columns, *answer],
                )

    return score


def identify_language(
    docs: DataFrame,
    folds: int = 4,
    held_out_fold: int = 2,
    keep: tuple[str, ...] | None = None,
    answer: tuple[str, str] = ("lang_pred", "score"),
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (doc_id, text, lang).

    Only rows whose crc32 of the id is not ``held_out_fold`` modulo ``folds`` and whose label is known are learned
    from, ``texts_per_language`` whole texts of each at most. Returns doc_id and held_out, or instead the
    columns named in ``keep``, and lang_pred and score in [0, 1], which ``answer`` may name differently. ``und`` with score 0 stands for a null text, a text without letters, and
    every text if nothing could be learned. A null id is not held out and not learned from. Repeated rows each
    get the same answer; equal values go to the language that sorts first. No rows in: no rows out.
    """
    docs, held_out, model = _learned(docs, folds, held_out_fold, texts_per_language, landmarks_per_language)
    if keep is None:
        return _marked(docs.select("doc_id", held_out.alias("held_out"), "text"), ["doc_id", "held_out"], model, answer)
    return _marked(docs, list(keep), model, answer)


def _learned(
    docs: DataFrame, folds: int, held_out_fold: int, texts_per_language: int, landmarks_per_language: int
) -> tuple[DataFrame, Column, KernelModel | None]:
    """The rows with plain ids and texts, which of them are held out, and what the others teach."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    training = F.col("doc_id").isNotNull() & ~held_out
    return docs, held_out, fit_spectra(*labelled_sample(docs, training, texts_per_language), landmarks_per_language)


def _marked(docs: DataFrame, columns: list[str], model: KernelModel | None, answer: tuple[str, str]) -> DataFrame:
    rows = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes) + "".join(
        f", `{name}` {kind}" for name, kind in zip(answer, ("string", "double"))
    )
    return rows.mapInArrow(_scorer(model, columns, answer), schema)


def keep_identified(
    docs: DataFrame,
    wanted: list[str] | None = None,
    least_score: float = LEAST_SCORE,
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
) -> DataFrame:
    """The rows of ``docs``, all columns, that the model takes for one of the ``wanted`` languages (default: all that it has learned).

    A row goes if its answer is ``und``, a language not wanted, or has a score below ``least_score``. Where no row is
    labelled, nothing can be told of any language, and all texts with letters stay. All learn and answer as in
    ``identify_language``.
    """
    columns = docs.columns
    pred, sure = (next(n for n in (f"{name}{'_' * k}" for k in range(1, 99)) if n not in columns) for name in ("pred", "sure"))
    typed, _, model = _learned(docs, 4, 2, texts_per_language, landmarks_per_language)
    if model is None:
        return typed.filter(F.col("text").rlike("\\p{L}"))
    marked = _marked(typed, columns, model, (pred, sure))
    fits = (F.col(pred) != UNKNOWN) & (F.col(sure) >= least_score)
    if wanted is not None:
        fits &= F.col(pred).isin(list(wanted))
    return marked.filter(fits).select(*columns)

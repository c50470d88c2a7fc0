"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has one binary context tree over the preceding bytes, newest first, up
to ``depth`` of them. A node estimates the next bit by Krichevsky-Trofimov from its counts, and mixes that with what
the longer contexts below it say; the weights follow from how well each explained the training texts. All depths
take part. A text is its lower-cased words joined by one space, as UTF-8, then the byte 255 as its end; before its
first byte stand bytes 255.

Counts of all byte n-grams of one more than ``depth`` are gathered from the corpus. The contexts that share their two
newest bytes form one subtree, of at most 256**(depth - 1) n-grams, weighted in one task; only the upper two levels,
whose size is fixed, are weighted on the driver. The result is one log-probability per n-gram of the corpus, seen in
training or not, and a text's score is the sum over its n-grams: from a broadcast table while that is small, by a join
beyond.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import crc_mod, stage

DEPTH = 5
END = 255
#: N-grams that a broadcast table may hold (12 bytes each), and words (about 60 bytes each).
TABLE_GRAMS = 6_000_000
TABLE_WORDS = 400_000
#: Bytes of text whose n-grams are sorted together, and distinct ones a task holds before it hands them on.
CHUNK = 2_000_000
HELD_GRAMS = 1_500_000
HELD_WORDS = 250_000
#: The end of a text as a token; no word holds white space.
END_TOKEN = b" "


def normal(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z change


def gram_codes(words: list[bytes], depth: int) -> np.ndarray:
    """Code of the n-gram that ends at each byte of the text, its end included; the newest byte is the lowest."""
    data = np.frombuffer(bytes([END]) * depth + b" ".join(words) + bytes([END]), np.uint8).astype(np.uint64)
    size = len(data) - depth
    code = np.zeros(size, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | data[k : k + size]
    return code


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield text.as_py() or b""


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _gather(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """N-grams of all texts with their training counts, and training words with theirs, summed within the task."""

    def rows(grams=None, words=None) -> pa.RecordBatch:
        if grams is not None:
            code, n = pa.array(grams[0].view(np.int64)), pa.array(grams[1])
            return pa.RecordBatch.from_arrays([code, pa.nulls(len(code), pa.binary()), n], ["gram", "word", "n"])
        word, n = pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(word), pa.int64()), word, n], ["gram", "word", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size, words = 0, Counter()

        def fold(held):
            parts = [held]
            for trained, codes in waiting.items():
                if codes:
                    found, n = np.unique(np.concatenate(codes), return_counts=True)
                    parts.append((found, n if trained else np.zeros_like(n)))
                    waiting[trained] = []
            return _summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))

        for batch in batches:
            for text, trained in zip(_texts(batch), batch.column(batch.schema.get_field_index("training")).to_pylist()):
                tokens = normal(text)
                codes = gram_codes(tokens, depth)
                waiting[trained].append(codes)
                size += len(codes)
                if trained:
                    words.update(tokens)
                    words[END_TOKEN] += 1
                if size > CHUNK:
                    held, size = fold(held), 0
                    if len(held[0]) > HELD_GRAMS:
                        yield rows(grams=held)
                        held = (held[0][:0], held[1][:0])
                if len(words) > HELD_WORDS:
                    yield rows(words=words)
                    words = Counter()
        yield rows(grams=fold(held))
        yield rows(words=words)

    return gather


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of positive numbers: the recurrence up to 10, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


class Level:
    """The binary nodes of all contexts of one length: counts, and per n-gram and bit the node it passes.

    ``context`` is a number for each n-gram's context of that length, ``symbol`` its newest byte.
    """

    def __init__(self, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray):
        # a node is a context and the bits decided so far, with a leading 1
        path = (256 | symbol.astype(np.int64))[:, None] >> np.arange(8, 0, -1)[None, :]
        keys = context.astype(np.int64)[:, None] * 256 + path
        self.nodes, at = np.unique(keys, return_inverse=True)
        self.at = at.reshape(keys.shape)
        self.bit = (symbol.astype(np.int64)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1
        weight = np.repeat(counts.astype(np.float64), 8)
        flat = self.at.ravel()
        ones = np.bincount(flat, weights=weight * self.bit.ravel(), minlength=len(self.nodes))
        self.ones, self.zeros = ones, np.bincount(flat, weights=weight, minlength=len(self.nodes)) - ones
        self.own = log_kt(self.zeros, self.ones)

    def bit_probability(self) -> np.ndarray:
        """KT probability of each n-gram's bits after all training counts."""
        zeros, ones = self.zeros[self.at], self.ones[self.at]
        return (np.where(self.bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def _mix(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the mean of the two probabilities, and the weight that the first has in it."""
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _weigh_subtree(depth: int) -> Callable[[pa.Table], pa.Table]:
    """For the n-grams of one pair of newest context bytes: the bit probabilities that context lengths 2 to ``depth``
    give together, and for each node of length 2 the log of its weighted probability.

    Rows with a gram: its eight bit probabilities. Rows without: the bits decided so far and the log-probability.
    """

    def weigh(group: pa.Table) -> pa.Table:
        codes = group["gram"].to_numpy().view(np.uint64)
        counts = group["n"].to_numpy()
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        symbol = (codes & np.uint64(255)).astype(np.int64)
        level = weighted = None
        probability = None
        for length in range(depth, 1, -1):
            mask = np.uint64((1 << (8 * length)) - 1)
            _, context = np.unique((codes >> np.uint64(8)) & mask, return_inverse=True)
            here = Level(context, symbol, counts)
            bits = here.bit_probability()
            if level is None:
                weighted, probability = here.own, bits
            else:
                # children of a node: the nodes of the next longer contexts, each counted once
                first = np.unique(level.at.ravel(), return_index=True)[1]
                below = np.bincount(here.at.ravel()[first], weights=weighted, minlength=len(here.nodes))
                weighted, share = _mix(here.own, below)
                probability = share[here.at] * bits + (1 - share[here.at]) * probability
            level = here
        pair = int((codes[0] >> np.uint64(8)) & np.uint64(0xFFFF))
        size, tops = len(codes), len(level.nodes)
        lists = pa.ListArray.from_arrays(np.arange(0, 8 * size + 1, 8, dtype=np.int32), probability.ravel())
        return pa.table(
            {
                "pair": pa.array(np.full(size + tops, pair, np.int32)),
                "gram": pa.concat_arrays([pa.array(codes.view(np.int64)), pa.nulls(tops, pa.int64())]),
                "bits": pa.concat_arrays([lists, pa.nulls(tops, lists.type)]),
                "path": pa.concat_arrays([pa.nulls(size, pa.int32()), pa.array((level.nodes % 256).astype(np.int32))]),
                "weighted": pa.concat_arrays([pa.nulls(size, pa.float64()), pa.array(weighted)]),
            }
        )

    return weigh


def _top_levels(below: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bit probabilities of context lengths 1 and 0, as tables over (newest byte, bits so far).

    ``below``: log-probability of the nodes of length 2 by newest byte and bits; ``symbols``: counts by newest byte
    and symbol. All have 256 x 256 entries.
    """
    shares, chances = np.zeros((2, 256, 256)), np.zeros((2, 256, 256, 2))
    every = np.arange(256)
    for place in (1, 0):
        number = np.zeros((256, 256, 2))
        for shift in range(8):
            np.add.at(number, (slice(None), (256 | every) >> (shift + 1), (every >> shift) & 1), symbols)
        weighted, shares[place] = _mix(log_kt(number[..., 0], number[..., 1]), below)
        chances[place] = (number + 0.5) / (number.sum(axis=-1, keepdims=True) + 1)
        below, symbols = np.zeros((256, 256)), np.vstack([symbols.sum(axis=0)] + [np.zeros((255, 256))])
        below[0] = weighted.sum(axis=0)
    return shares, chances


def _finish(shares: np.ndarray, chances: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Log10 of each n-gram's probability from its bit probabilities and the two upper levels."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            bits = batch.column(1).flatten().to_numpy().reshape(-1, 8)
            symbol = (codes & np.uint64(255)).astype(np.int64)
            newest = ((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            path = (256 | symbol)[:, None] >> np.arange(8, 0, -1)[None, :]
            bit = (symbol[:, None] >> np.arange(7, -1, -1)[None, :]) & 1
            for place, context in ((1, newest), (0, np.zeros_like(newest))):
                share = shares[place][context[:, None], path]
                bits = share * chances[place][context[:, None], path, bit] + (1 - share) * bits
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(bits).sum(axis=1))], ["gram", "log10"])

    return finish


def context_tree(grams: DataFrame, depth: int) -> DataFrame:
    """Log10 probability of the newest byte after the others, for each n-gram (gram, n: its training count)."""
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    symbol = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
    keyed = grams.withColumn("pair", pair)
    schema = "pair int, gram long, bits array<double>, path int, weighted double"
    weighed = stage(keyed.groupBy("pair").applyInArrow(_weigh_subtree(depth), schema))
    newest = F.col("pair").bitwiseAND(F.lit(255)).alias("newest")
    tops = weighed.filter("gram is null").groupBy(newest, "path").agg(F.sum("weighted")).collect()
    counted = keyed.groupBy(newest, symbol.alias("symbol")).agg(F.sum("n")).collect()
    below, symbols = np.zeros((256, 256)), np.zeros((256, 256))  # at most so many rows were collected
    for table, rows in ((below, tops), (symbols, counted)):
        for one, two, value in rows:
            table[one, two] = value
    shares, chances = _top_levels(below, symbols)
    bits = weighed.filter("gram is not null").select("gram", "bits")
    return bits.mapInArrow(_finish(shares, chances), "gram long, log10 double")


ROW = ["row_id", "doc_id", "held_out"]
SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
RARE = "rare array<struct<word: binary, times: long>>"


def _score(depth: int, grams, words, total: int, distinct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of whole texts from the broadcast tables; words that the table lacks are listed."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of, floor = words.value, np.log10(total + distinct + 1)
        table = grams.value if grams is not None else None
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            codes, tokens, known, base, rare = [], [], [], [], []
            for text in _texts(batch):
                found = normal(text)
                if table is not None:
                    codes.append(gram_codes(found, depth))
                found.append(END_TOKEN)
                tokens.append(len(found))
                counts = [count_of.get(w, -1) for w in found]
                have = np.array(counts, np.float64)
                have = have[have >= 0]
                known.append(int((have > 0).sum()))
                base.append(float(np.log10(have + 1).sum() - len(have) * floor))
                rare.append(list(Counter(w for w, c in zip(found, counts) if c < 0).items()))
            scores = [None] * len(tokens)
            if table is not None:
                scores = _sums(codes, *table)
            lists = pa.array([[{"word": w, "times": n} for w, n in r] for r in rare], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))
            columns = [*batch.columns[:3], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores, pa.float64()), lists], [*ROW, "n_tokens", "known", "base", "score", "rare"]
            )

    return score


def _sums(codes: list[np.ndarray], grams: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Per text the sum of its n-grams' log-probabilities, a text's n-grams in ascending order."""
    out = np.zeros(len(codes))
    begin = 0
    while begin < len(codes):
        end, size = begin + 1, len(codes[begin])
        while end < len(codes) and size + len(codes[end]) <= CHUNK:
            size += len(codes[end])
            end += 1
        # an n-gram takes 48 bits at most, the number of the text the other 16
        keys = np.concatenate([(c << np.uint64(16)) | np.uint64(i) for i, c in enumerate(codes[begin:end])])
        keys.sort()
        gram = keys >> np.uint64(16)
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        values = np.repeat(logs[np.searchsorted(grams, gram[first])], np.diff(np.append(first, len(gram))))
        text = (keys & np.uint64(0xFFFF)).astype(np.int64)
        out[begin:end] = np.bincount(text, weights=values, minlength=end - begin)
        begin = end
    return out


def _own_grams(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), _texts(batch)):
                codes, times = np.unique(gram_codes(normal(text), depth), return_counts=True)
                columns = [pa.array(np.full(len(codes), row_id)), pa.array(codes.view(np.int64)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "gram", "times"])

    return own


def score_documents(
    docs: DataFrame,
    depth: int = DEPTH,
    folds: int = 7,
    held_out_fold: int = 2,
    table_grams: int = TABLE_GRAMS,
    table_words: int = TABLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text with the context tree and, for comparison, with smoothed word frequencies.

    Learns from rows whose crc32 of the id is not ``held_out_fold`` modulo ``folds``; a row without an id is scored,
    neither held out nor learned from. A null text is empty: it has the end token only. Per row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score. Repeated rows are scored each and counted each in training.
    ``depth`` is from 2 to 5. Without training rows every bit has probability one half. No rows in: no rows out.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth must be from 2 to 5")
    spark = docs.sparkSession
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    held_out = F.coalesce(crc_mod(doc_id, folds) == held_out_fold, F.lit(False))
    rows = docs.select(
        F.xxhash64(doc_id, F.xxhash64(text)).alias("row_id"), doc_id.alias("doc_id"), held_out.alias("held_out"), text.alias("text")
    )
    counted = stage(
        rows.select((F.col("doc_id").isNotNull() & ~F.col("held_out")).alias("training"), "text")
        .mapInArrow(_gather(depth), "gram long, word binary, n long")
    )
    grams = counted.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    vocabulary = stage(counted.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    model = stage(context_tree(stage(grams), depth))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent words that fit the table, all words of one frequency or none
    frequencies, least, room = vocabulary.groupBy("n").count().orderBy(F.col("n").desc()), None, table_words
    for n, words in frequencies.limit(table_words).collect():
        if words > room:
            break
        room, least = room - words, n
    frequent = {}
    if least is not None:
        listed = vocabulary.filter(F.col("n") >= least).toArrow()
        frequent = dict(zip(listed["word"].to_pylist(), listed["n"].to_pylist()))
    grams_table = None
    if model.count() <= table_grams:
        found = model.orderBy("gram").toArrow()
        codes = found["gram"].to_numpy().view(np.uint64)
        grams_table = spark.sparkContext.broadcast((codes, found["log10"].to_numpy()))
    words_table = spark.sparkContext.broadcast(frequent)
    scored = stage(rows.mapInArrow(_score(depth, grams_table, words_table, total, distinct), SCORED + RARE))
    rare = (
        scored.select("row_id", "rare").dropDuplicates(["row_id"]).select("row_id", F.explode("rare").alias("r"))
        .select("row_id", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
        .join(vocabulary, "word", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))).alias("rare_base"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    out = scored.drop("rare").join(rare, "row_id", "left")
    if grams_table is None:
        sums = (
            rows.select("row_id", "text").dropDuplicates(["row_id"])
            .mapInArrow(_own_grams(depth), "row_id long, gram long, times long")
            .join(model, "gram").groupBy("row_id").agg(F.sum(F.col("times") * F.col("log10")).alias("by_join"))
        )
        out = out.drop("score").join(sums.withColumnRenamed("by_join", "score"), "row_id")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )

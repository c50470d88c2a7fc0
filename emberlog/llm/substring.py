"""Removal of repeated passages with repeated-phrase automata.

A window is ``length`` consecutive words of one document. A word goes if a window covers it whose words also start in a
document with a smaller id. Four passes:

1. Every window names the word n-gram of least hash within it, its anchor; equal windows name equal anchors. Runs of
   windows with one anchor are one row. Anchors of more than one document are the places where passages may recur.
2. Recurring passages are confirmed: runs of windows that are equal as a whole share a class, whose first document
   owns it. Where an anchor has several classes, single windows of each class's first run are compared as well.
3. The owners' passages are dealt to shards and compiled to Aho-Corasick automata over blocks of half a window, so
   that any window within a passage holds a whole block.
4. All documents are streamed: stretches that may repeat a passage go to its shard, where the automaton locates every
   block in them; occurrences are extended word by word, and those of a window or more are cut.

Hashes only propose; what is cut has been compared word by word. An owner with many followers is split over several
shards, each with the owner's passages and a share of the followers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import shuffle_width, stage

#: Words of an anchor; must be less than a window.
ANCHOR_WORDS = 16
#: Followers of an owner that one shard takes.
FOLLOWERS_PER_SHARD = 1000
#: Words whose hash a task remembers.
REMEMBERED = 400_000
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
KEY = ["doc_id", "text_key"]


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, count - 1), base, np.uint64)), dtype=np.uint64)[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequences:
    """Hashes of word sequences of one document from running sums: any (from, to) costs a constant."""

    def __init__(self, hashes: np.ndarray, factor: np.uint64):
        self.back = _powers(pow(int(factor), -1, 2**64), len(hashes) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * _powers(int(factor), len(hashes)), dtype=np.uint64))

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def anchored_runs(hashes: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, hash of all words of the run, first and last window."""
    if len(hashes) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    sequences = Sequences(hashes, FACTORS[0])
    at = np.arange(len(hashes) - anchor + 1)
    grams = sequences.hash(at, at + anchor)
    windows = np.arange(len(hashes) - length + 1)
    least = np.lib.stride_tricks.sliding_window_view(grams, length - anchor + 1).argmin(axis=1) + windows
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(windows)) - 1
    whole = sequences.hash(first, last + length)
    return grams[least[first]].view(np.int64), whole.view(np.int64), first.astype(np.int32), last.astype(np.int32)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield text.as_py() or b""


def _anchors(length: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found, counts = [], []
            for text in _texts(batch):
                found.append(anchored_runs(known.of(text.split()), length, anchor))
                counts.append(len(found[-1][0]))
            rows = np.repeat(np.arange(len(counts)), counts)
            columns = [np.concatenate([f[k] for f in found]) if found else [] for k in range(4)]
            keys = [batch.column(k).take(pa.array(rows)) for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*keys, *map(pa.array, columns)], [*KEY, "anchor", "words", "first", "last"]
            )

    return anchors


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count and digest of whole texts, as they are if nothing is removed."""
    for batch in batches:
        words = [text.split() for text in _texts(batch)]
        counts = pa.array([len(w) for w in words], pa.int64())
        digests = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts, digests], [*KEY, "n_words", "sha256"])


def _single_windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index("runs"))
            parts: list[list] = [[], [], [], []]
            for row, (text, mine) in enumerate(zip(_texts(batch), runs)):
                hashes = known.of(text.split())
                at = np.unique(np.concatenate([np.arange(r["first"].as_py(), r["last"].as_py() + 1) for r in mine]))
                for k in (0, 1):
                    parts[k].append(Sequences(hashes, FACTORS[k]).hash(at, at + length).view(np.int64))
                parts[2].append(at.astype(np.int32))
                parts[3].append(np.full(len(at), row))
            if parts[3]:
                one, two, at, rows = map(np.concatenate, parts)
                keys = [batch.column(k).take(pa.array(rows)) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(one), pa.array(two), pa.array(at)], [*KEY, "one", "two", "first"]
                )

    return windows


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


PASSAGES = "doc_id long, text_key long, shard long, kind int, owner long, start int, words string"


def _passages(length: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts for the automata: what a document owns (kind 0), and its stretches that may repeat others (kind 1)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("owned", "follows"))
            for doc_id, key, text, owned, follows in zip(*(c.to_pylist() for c in batch.columns[:2]), _texts(batch), *lists):
                words = text.split()
                for kind, ranges in ((0, owned), (1, follows)):
                    by_shard = defaultdict(list)
                    for r in ranges or ():
                        by_shard[r["owner"], r["shard"]].append((r["first"], r["last"] + 1))
                    for (owner, shard), found in by_shard.items():
                        for begin, end in merged(found):
                            stretch = b" ".join(words[begin : end + length - 1]).decode()
                            out.append((doc_id, key, shard, kind, owner, begin, stretch))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "text_key", "shard", "kind", "owner", "start", "words"), r)) for r in out],
                pa.schema(
                    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()),
                     ("owner", pa.int64()), ("start", pa.int32()), ("words", pa.string())]
                ),
            )

    return cut


class PhraseAutomaton:
    """Aho-Corasick automaton over blocks of half a window of every passage."""

    def __init__(self, length: int):
        self.length, self.block = length, length // 2
        self.passages: list[tuple[int, list[str]]] = []
        self.places: dict[str, list[tuple[int, int]]] = {}
        self.automaton = None

    def add(self, owner: int, text: str) -> None:
        words = text.split(" ")
        for at in range(0, len(words) - self.block + 1, self.block):
            block = " " + " ".join(words[at : at + self.block]) + " "
            self.places.setdefault(block, []).append((len(self.passages), at))
        self.passages.append((owner, words))
        self.automaton = None

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for block, places in self.places.items():
            self.automaton.add_word(block, (len(block), places))
        if self.places:
            self.automaton.make_automaton()

    def covered(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Word ranges of ``text`` that repeat a window or more of a passage whose owner comes before ``doc_id``."""
        if self.automaton is None:
            self.compile()
        if not self.places:
            return []
        words, found = text.split(" "), []
        word_at, at = {}, 0
        for index, word in enumerate(words):
            word_at[at] = index
            at += len(word) + 1
        reached: dict[tuple[int, int], int] = {}  # passage and shift: how far that alignment has been followed
        for end, (size, places) in self.automaton.iter(f" {text} "):
            begin = word_at[end - size + 1]
            for passage, offset in places:
                owner, theirs = self.passages[passage]
                shift = begin - offset
                if owner >= doc_id or reached.get((passage, shift), -1) > begin:
                    continue
                low, high = begin, begin + self.block
                while low > 0 and low > shift and words[low - 1] == theirs[low - 1 - shift]:
                    low -= 1
                while high < len(words) and high - shift < len(theirs) and words[high] == theirs[high - shift]:
                    high += 1
                reached[passage, shift] = high
                if high - low >= self.length:
                    found.append((low, high))
        return merged(found)


def _locate(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passages of the partition's shards come first and are compiled; then the documents' stretches stream by."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = PhraseAutomaton(length)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    phrases.add(r["owner"], r["words"])
                    continue
                for begin, end in phrases.covered(r["doc_id"], r["words"]):
                    for column, value in zip(out, (r["doc_id"], r["text_key"], r["start"] + begin, r["start"] + end)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*KEY, "begin", "end"])

    return locate


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, digests = [], [], []
        for text, ranges in zip(_texts(batch), batch.column(batch.schema.get_field_index("ranges")).to_pylist()):
            words = text.split()
            keep, at = [], 0
            for begin, end in merged((r["begin"], r["end"]) for r in ranges):
                keep += words[at:begin]
                at = end
            kept = b" ".join([*keep, *words[at:]])
            texts.append(kept.decode())
            removed.append(len(words) - len(keep) - len(words[at:]))
            digests.append(hashlib.sha256(kept).hexdigest())
        names = ["row_no", "kept_text", "n_removed", "kept_sha256"]
        columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names)


def covered_ranges(docs: DataFrame, length: int, anchor: int, followers: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of words to cut per (doc_id, text_key), and the texts they belong to.

    ``docs``: doc_id, text_key, text, one row per document and text; rows without an id take no part.
    """
    spark = docs.sparkSession
    runs = stage(
        docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(
            _anchors(length, anchor),
            "doc_id long, text_key long, anchor long, words long, first int, last int",
        )
    )
    # pass 1: anchors of two documents or more
    recurring = runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    flagged = stage(runs.join(recurring.select("anchor"), "anchor", "left_semi"))
    # pass 2: classes of equal runs, and anchors with several classes
    classes = stage(
        flagged.groupBy("anchor", "words").agg(
            F.min(F.struct("doc_id", "first", "text_key")).alias("own"), F.max("doc_id").alias("latest")
        )
    )
    several = classes.groupBy("anchor").count().filter("count > 1").select("anchor", F.lit(True).alias("several"))
    classed = stage(flagged.join(classes, ["anchor", "words"]).join(several, "anchor", "left"))
    repeats = classed.filter("doc_id > own.doc_id").select(*KEY, "first", "last", "own")
    # texts of all documents with such runs, once
    alone = classed.filter("doc_id = own.doc_id and several").select(*KEY, "first", "last")
    needed = classed.filter("doc_id > own.doc_id or several or latest > doc_id").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("runs")
    )
    texts = stage(docs.join(needed.select(*KEY), KEY, "left_semi").dropDuplicates(KEY))
    per_doc = alone.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    windows = stage(
        texts.join(per_doc, KEY)
        .select(*KEY, "text", "runs")
        .mapInArrow(_single_windows(length), "doc_id long, text_key long, one long, two long, first int")
    )
    shared = windows.groupBy("one", "two").agg(
        F.min(F.struct("doc_id", "first", "text_key")).alias("own"), F.max("doc_id").alias("latest")
    ).filter("own.doc_id < latest")
    single = windows.join(shared, ["one", "two"]).filter("doc_id > own.doc_id")
    repeats = stage(repeats.unionByName(single.select(*KEY, "first", F.col("first").alias("last"), "own")))
    # pass 3: shards by owner, several for an owner with many followers
    parts = repeats.groupBy(F.col("own.doc_id").alias("owner")).agg(
        F.ceil(F.approx_count_distinct("doc_id") / followers).alias("parts")
    )
    shards = 4 * shuffle_width(spark)
    dealt = repeats.withColumn("owner", F.col("own.doc_id")).join(parts, "owner")
    key_of = lambda part: F.pmod(F.xxhash64("owner", part), F.lit(shards))
    follows = (
        dealt.withColumn("shard", key_of(F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("owner", "shard", "first", "last")).alias("follows"))
    )
    owned = (
        dealt.select(
            "owner",
            F.col("own.text_key").alias("text_key"),
            F.col("own.first").alias("first"),
            (F.col("own.first") + F.col("last") - F.col("first")).alias("last"),
            "parts",
        )
        .distinct()
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("shard", key_of(F.col("part")))
        .groupBy(F.col("owner").alias("doc_id"), "text_key")
        .agg(F.collect_set(F.struct("owner", "shard", "first", "last")).alias("owned"))
    )
    passages = (
        texts.join(owned, KEY, "left")
        .join(follows, KEY, "left")
        .filter("owned is not null or follows is not null")
        .select(*KEY, "text", "owned", "follows")
        .mapInArrow(_passages(length, shards), PASSAGES)
    )
    # pass 4: every occurrence, by the automata
    ranges = (
        passages.repartition(shards, "shard")
        .sortWithinPartitions("kind", "shard")
        .mapInArrow(_locate(length), "doc_id long, text_key long, begin int, end int")
    )
    return stage(ranges), texts


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key and text of every row, and the whole row beside them so that no names clash."""
    text = F.col(f"row.`{text_col}`").cast("string")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), "row"
    )


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    anchor: int = ANCHOR_WORDS,
    followers: int = FOLLOWERS_PER_SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut from the text.

    A text that loses nothing stays byte for byte; of others the kept words are joined by one space. Null texts stay
    null. See :func:`repeat_report` for rows without an id and repeated rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    cut = _cut_texts(*covered_ranges(keyed.select(*KEY, "text"), length, anchor, followers)).select(*KEY, "kept_text")
    new = {text_col: F.coalesce("kept_text", F.col("row").getField(text_col))}
    joined = keyed.select(*KEY, "row").join(cut, KEY, "left")
    return joined.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _cut_texts(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """Kept text, removed words and digest of every document with something to cut."""
    per_doc = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    rows = texts.join(per_doc, KEY).select(F.struct(*KEY).alias("row_no"), "text", "ranges")
    out = rows.mapInArrow(
        _cut_words, "row_no struct<doc_id: bigint, text_key: bigint>, kept_text string, n_removed long, kept_sha256 string"
    )
    return out.select("row_no.*", "kept_text", "n_removed", "kept_sha256")


def repeat_report(
    docs: DataFrame,
    length: int = 50,
    anchor: int = ANCHOR_WORDS,
    followers: int = FOLLOWERS_PER_SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words are runs of bytes other than ASCII white space, unchanged; a null text has none. Rows without an id lose
    nothing and come before no other. Repeated rows are one document: neither is the smaller. Rows that share an id
    but not a text are judged each against smaller ids. An empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col).select(*KEY, "text")
    base = keyed.mapInArrow(_base, "doc_id long, text_key long, n_words long, sha256 string")
    cut = _cut_texts(*covered_ranges(keyed, length, anchor, followers)).select(*KEY, "n_removed", "kept_sha256")
    return (
        base.join(cut, KEY, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        )
    )

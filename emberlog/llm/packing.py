"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt to partitions and packed there by
best-fit decreasing. A lower bound from dual-feasible functions says how many bins a partition needs at least; where
the packing uses no more, it is certified, and only its bins with much room are opened again. The other partitions
keep their full bins and hand in the documents of all bins with room left; these exchange documents by being dealt
anew, to ever fewer partitions, and are packed again. The last round leaves open bins in few partitions only. Every
piece tells the certificate of the partition that it was placed in: bins used and bins needed at least.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers; beyond that it forgets most of them, and those of more bytes at once.
REMEMBERED = 400_000
REMEMBERED_BYTES = 64
#: Texts encoded together, at most so many and of about so many bytes; longer texts are encoded in parts.
TEXTS = 64
TEXT_BYTES = 1 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20
#: Pieces of one packing task, about.
PIECES_PER_TASK = 20_000


#: What ``bytes.split()`` splits at.
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


class WordEncoder:
    """Encoder of whole UTF-8 texts to little-endian 32-bit ids that remembers words.

    The vocabulary's pattern never crosses white space, so the ids of a text are those of its words in turn. It is
    blind to case, and a mark behind ASCII letters is a token of its own, so fewer words need to be learned; words of
    ASCII letters skip normalising and splitting, which would leave them as they are.
    """

    MARKS = (b",", b".", b";", b":", b"!", b"?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.full = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # texts that may spell a special token keep their case
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]
        missing = set().union(*words).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:  # words met first are the frequent ones
            self.known = dict(islice(self.known.items(), REMEMBERED // 3))
            missing = set().union(*words).difference(self.known)
        self._learn(missing)
        known = self.known.__getitem__
        out = [b"".join(map(known, w)) for w in words]
        for word in [w for w in missing if len(w) > REMEMBERED_BYTES]:
            del self.known[word]
        return out

    def encode_in_parts(self, text: bytes) -> bytes:
        """Ids of one text of any length, of about ``TEXT_BYTES`` at a time, cut at white space."""
        out, at = [], 0
        while at < len(text):
            end = SPACE.search(text, at + TEXT_BYTES)
            end = end.end() if end else len(text)
            out.extend(self.encode([text[at:end]]))
            at = end
        return b"".join(out)

    def _learn(self, missing: set[bytes]) -> None:
        marked = [w for w in missing if w[-1:] in self.MARKS and w[:-1].isalpha()]
        needed = missing.difference(marked).union(w[:-1] for w in marked).union(w[-1:] for w in marked)
        needed = {w for w in needed if w not in self.known}
        plain = [w for w in needed if w.isalpha() and w.islower()]
        self._learn_joined(self.bare, plain)
        rest = list(needed.difference(plain))
        letters = [w for w in rest if w.decode().isalpha()]
        self._learn_joined(self.full, letters)
        self._learn_each([w for w in rest if w not in self.known])
        for word in marked:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1:]]

    def _learn_joined(self, steps: tuple, words: list[bytes]) -> None:
        """Words of letters only, encoded as one text: each ends with the one closing id in it."""
        if not words:
            return
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.full
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._learn_each(words)  # a letter whose lower case is no single letter
            return
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.known[word] = data[at:end]
            at = end

    def _learn_each(self, words: list[bytes]) -> None:
        encodings = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for word, encoding in zip(words, encodings):
            self.known[word] = np.array(encoding.ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a worker process, kept from task to task."""
    return WordEncoder(path)


def _in_groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and (len(group) == TEXTS or size + len(text) > TEXT_BYTES):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of a document; a null text counts as empty and still has its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), np.array([end_id], "<u4").tobytes()
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            out, encoded = [], []
            for group in _in_groups([text.as_py() or b"" for text in batch.column(1).cast(pa.binary())]):
                encoded.extend([encoder.encode_in_parts(group[0])] if len(group) == 1 else encoder.encode(group))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def dual_feasible_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that the sizes need at least: the best of the plain sum and two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    values, counts = np.unique(sizes, return_counts=True)
    best = -(-int((values * counts).sum()) // capacity)
    # sizes over capacity - e count as whole bins, those of e and more as they are, smaller ones as nothing
    number, weight = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * values))
    e = values[values <= capacity // 2]
    first, beyond = np.searchsorted(values, e), np.searchsorted(values, capacity - e, side="right")
    if len(e):
        best = max(best, int((number[-1] - number[beyond] - (weight[first] - weight[beyond]) // capacity).max()))
    # staircases with k steps: x counts as floor((k+1) x) / k, or as x where (k+1) x is whole
    for k in range(1, 25):
        scaled = (k + 1) * values
        steps = np.where(scaled % capacity == 0, values * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((steps * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the room left in each bin.

    A piece goes to the bin with the least sufficient room; one bit per amount of room finds it.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            place = with_room[left].pop()
            if not with_room[left]:
                mask &= ~(1 << left)
        else:
            left, place = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[place] = place, capacity - left, left - size
        if left > size:
            with_room[left - size].append(place)
            mask |= 1 << (left - size)
    return bins, offsets, np.array(room, np.int64)


def _pack_group(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packer of one partition's pieces; adds bin, offset, the partition's certificate and whether a row is final."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32"))])
        sizes = group["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(sizes, capacity)
        bound = dual_feasible_bound(sizes, capacity)
        # without a gap only bins with much room are opened again, with a gap all that are not full
        final = last | (room[bins] < (1 if len(room) > bound else capacity // 64))
        used, needed = np.full(len(bins), len(room), np.int64), np.full(len(bins), bound, np.int64)
        more = {"bin": bins, "offset": offsets, "partition_bins": used, "partition_bound": needed, "final": final}
        for name, column in more.items():
            group = group.append_column(name, pa.array(column))
        return group

    return pack


def pack_pieces(pieces: DataFrame, capacity: int, per_task: int = PIECES_PER_TASK, rounds: int = 4) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; offsets of a sequence leave no gap.

    ``partition_bins`` and ``partition_bound`` are the certificate of the partition that placed the piece: bins that
    its packing used, and bins that any packing of its pieces needs; equal numbers prove that packing the best.

    Every round deals the open pieces by hash to about one partition per ``per_task`` of them, at most half as many
    as before, and ends with each partition's certificate. The last round keeps whatever it has packed.
    """
    left, done, parts = pieces, [], None
    for round_no in range(rounds):
        needed = max(1, -(-left.count() // per_task))
        parts = needed if parts is None else max(1, min(parts // 2, needed))
        last = parts == 1 or round_no == rounds - 1
        key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no))
        dealt = left.withColumn("dealt", F.pmod(key, F.lit(parts)))
        schema = f"{PIECES}, dealt long, bin long, offset long, partition_bins long, partition_bound long, final boolean"
        packed = stage(dealt.groupBy("dealt").applyInArrow(_pack_group(capacity, last), schema))
        sequence = F.lit(round_no).cast("long") * 2**58 + F.col("dealt") * 2**34 + F.col("bin")
        done.append(packed.filter("final").withColumn("sequence_id", sequence))
        left = packed.filter("not final").select("doc_id", "piece", "start", "length", "ids_crc32")
        if last or left.isEmpty():
            break
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound"]
    out = done[0].select(names)
    for more in done[1:]:
        out = out.unionByName(more.select(names))
    return out


def sequence_bound(pieces: DataFrame, capacity: int) -> int:
    """Sequences that all pieces together need at least, from the counts of each length (at most ``capacity`` rows)."""
    counts = pieces.groupBy("length").count().toPandas()
    return dual_feasible_bound(np.repeat(counts["length"].to_numpy(), counts["count"].to_numpy()), capacity)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its ids and then ``end_id``; only longer ones are cut, into pieces of ``capacity`` and a rest. A
    null or empty text is the end id alone. Repeated rows are packed each for itself, equal lengths in order of id,
    piece and checksum. An empty table gives no rows; other columns are not read. One row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and the partition's certificate (see ``pack_pieces``).
    """
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), BATCH_BYTES)
    return pack_pieces(pieces, capacity, per_task)

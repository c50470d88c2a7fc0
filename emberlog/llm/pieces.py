"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations form a lattice of vocabulary pieces; a segmentation's probability is the product of its pieces'
weights over the sum of all segmentations' products. The Gumbel top-k trick draws k different ones: every segmentation
gets its log-probability plus Gumbel noise, and the k largest are emitted, largest first.

The noise is never drawn for single segmentations. An A* search walks the lattice from the end of the text: an entry of
its queue is a set of segmentations, those that share the last pieces and then differ, and its priority is the largest
perturbed value in the set, drawn directly from the set's total probability, which the forward sums give exactly. The
first entry is the set of all. Taking an entry draws its best segmentation piece by piece; at every decision on the way
the alternatives form a new set, whose largest value is a Gumbel value cut off at the value of the set it came from.

No piece holds the word mark behind another character, so no piece crosses from one word to the next and the lattice is
a chain of word lattices: forward sums are computed once per distinct word of a chunk of texts, and all texts of a chunk
walk together. All noise is a hash of the row's key, so that a row's samples do not depend on partitions or retries.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of texts that walk together.
CHUNK = 1_000_000
#: Decisions at the start of a path that leave one set together until its turn comes; each next run is twice as long.
RUN = 8
#: Offset of the rank in the weight 1 / (rank + offset) of pieces of a vocabulary without probabilities.
RANK_OFFSET = 2.7


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model with log-weights, as a trie in sorted arrays."""

    ids: np.ndarray  # id of each usable piece
    weights: np.ndarray  # log-weight of each
    byte_ids: np.ndarray  # id of each byte's fallback piece
    byte_weights: np.ndarray
    keys: np.ndarray  # trie: state << 21 | character, sorted
    child: np.ndarray  # state that each key leads to
    piece: np.ndarray  # piece that a state spells, or -1
    depth: int
    surface: list[bytes]  # text of each id, for decoding
    pattern: str  # matches words one after another

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        surface, byte_ids = [n.replace(MARK, " ").encode() for n in names], np.full(256, -1)
        usable = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                surface[i] = bytes([int(name[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface[i] = b""
            else:
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {name!r} holds a word mark behind another character")
                usable.append(i)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces to spell unknown characters with")
        if np.all(scores == np.round(scores)):  # merge ranks: weight by rank, bytes last
            order = sorted(range(size), key=lambda i: (i in set(byte_ids.tolist()), -scores[i], i))
            weights = np.zeros(size)
            weights[order] = -np.log(np.arange(size) + RANK_OFFSET)
        else:
            weights = scores.copy()
            weights[byte_ids] = scores[usable].min() - 2
        inside = {name[k : k + 2] for i in usable for name in [names[i]] for k in range(len(name) - 1)}
        marks = [c for c in ",.;:!?" if not any(pair[0].isascii() and pair[0].isalpha() and pair[1] == c for pair in inside)]
        lines = "\n" if not any("\n" in names[i] for i in usable) else ""
        states, spelled = {}, [-1]
        for number, i in enumerate(usable):
            state = 0
            for char in names[i]:
                key = state << 21 | ord(char)
                if key not in states:
                    states[key] = len(spelled)
                    spelled.append(-1)
                state = states[key]
            spelled[state] = number
        keys = np.array(sorted(states), np.int64)
        children = np.array([states[k] for k in keys.tolist()], np.int32)
        depth = max(len(names[i]) for i in usable)
        return cls(
            np.array(usable, np.int32), weights[usable], byte_ids.astype(np.int32), weights[byte_ids],
            keys, children, np.array(spelled, np.int32), depth, surface, word_pattern(marks, lines),
        )

    def spell(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of a segmentation, as :meth:`decode`."""
        if not hasattr(self, "buffer"):
            lengths = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
            self.buffer, self.lengths = np.frombuffer(b"".join(self.surface), np.uint8), lengths
            self.begins = np.cumsum(lengths) - lengths
        lengths = self.lengths[ids]
        shift = self.begins[ids] - (np.cumsum(lengths) - lengths)
        return self.buffer[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes().removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the mark that encoding puts before the first word is taken off."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


def word_pattern(marks: list[str], lines: str) -> str:
    """Pattern of the words of an escaped text. Line ends that no piece holds, and marks that no piece holds behind a
    letter, are words of their own: cutting there changes no segmentation."""
    stop = f"[^{MARK}{lines}]"
    cut = f"{MARK}*[A-Za-z]+(?=[{re.escape(''.join(marks))}])|" if marks else ""
    return f"{cut}{MARK}+{stop}*|{stop}+" + (f"|[{lines}]" if lines else "")


def units_of(text: str, pattern: re.Pattern) -> list[str]:
    """The words of a text, marks in front, last word first."""
    return pattern.findall((MARK + text).replace(" ", MARK))[::-1] if text else []


class Lattices:
    """The lattices of distinct words, side by side.

    Node ``base[u] + p`` is the place behind the p-th character of word u. The edges that end at a node lie together,
    the likelier ones first; ``chance`` is the log-probability of taking an edge from its end node, given that the
    rest of the word in front of it is drawn by weight too, and ``upto`` the sum of chances up to with the edge.
    """

    def __init__(self, units: list[str], vocabulary: Vocabulary):
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.base = np.append(0, np.cumsum(lengths + 1))[:-1]
        self.last = self.base + lengths
        owner = np.repeat(np.arange(len(units)), lengths)
        node = np.arange(len(chars)) + owner  # node in front of each character
        place = node - self.base[owner]
        remaining = lengths[owner] - place
        sizes = self._pieces_by_size(chars, remaining, vocabulary)
        # forward sums, for all words' p-th places together
        total = np.full(len(chars) + len(units), -np.inf)
        total[self.base] = 0.0
        longest = int(lengths.max(initial=0))
        kind = np.uint16 if longest < 2**16 else np.int64
        edges = []
        for size, (begin, piece, weight) in enumerate(sizes, 1):
            order = np.argsort(place[begin].astype(kind), kind="stable")
            begin = begin[order]
            bounds = np.searchsorted(place[begin], np.arange(longest + 2))
            edges.append((size, node[begin], piece[order], weight[order], bounds.tolist()))
        for at in range(1, longest + 1):
            for size, start, _, weight, bounds in edges[:at]:
                low, high = bounds[at - size], bounds[at - size + 1]
                if low < high:
                    here = start[low:high]
                    total[here + size] = np.logaddexp(total[here + size], total[here] + weight[low:high])
        start = np.concatenate([e[1] for e in edges])
        end = np.concatenate([e[1] + e[0] for e in edges])
        # longer pieces first: they are likelier as a rule
        order = np.argsort(end * 64 + 63 - np.minimum(end - start, 63))
        self.start, self.end = start[order], end[order]
        self.piece = np.concatenate([e[2] for e in edges])[order]
        weight = np.concatenate([e[3] for e in edges])[order]
        self.chance = np.minimum(total[self.start] + weight - total[self.end], 0.0)
        self.first = np.searchsorted(self.end, np.arange(len(total) + 1))
        # summed node by node, so that a word's numbers do not depend on the words beside it
        self.upto = np.exp(self.chance)
        rank = np.arange(len(self.end)) - self.first[self.end]
        for r in range(1, int(rank.max(initial=0)) + 1):
            at = np.flatnonzero(rank == r)
            self.upto[at] += self.upto[at - 1]
        closing = np.append(self.end[1:] != self.end[:-1], True)
        self.upto[closing] = np.inf  # rounding must not run over the last edge
        begins = np.zeros(len(total), bool)
        begins[self.base] = True
        self.opens = begins[self.start]  # edges at the front of a word
        self.ids = vocabulary.ids

    def _pieces_by_size(self, chars: np.ndarray, remaining: np.ndarray, vocabulary: Vocabulary) -> list[tuple]:
        """Per length the characters that pieces of it start at, the pieces and their weights, by walking the trie from
        all characters at once. A character that is no piece is spelled in bytes: one edge, numbered below zero."""
        sizes = []
        begin, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for size in range(1, vocabulary.depth + 1):
            inside = remaining[begin] >= size
            begin, state = begin[inside], state[inside]
            key = state << 21 | chars[begin + size - 1]
            at = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
            found = vocabulary.keys[at] == key
            begin, state = begin[found], vocabulary.child[at[found]].astype(np.int64)
            piece = vocabulary.piece[state]
            spells = piece >= 0
            sizes.append((begin[spells], piece[spells].astype(np.int64), vocabulary.weights[piece[spells]]))
        single = np.zeros(len(chars), bool)
        single[sizes[0][0]] = True
        odd = np.flatnonzero(~single)
        codes, number = np.unique(chars[odd], return_inverse=True)
        spelled = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in codes.tolist()]
        weights = np.array([vocabulary.byte_weights[s].sum() for s in spelled], np.float64)
        self.spelled = [vocabulary.byte_ids[s] for s in spelled]
        more = (odd, -1 - number, weights[number])
        sizes[0] = tuple(np.concatenate(both) for both in zip(sizes[0], more))
        return sizes

    def pieces_of(self, edges: np.ndarray) -> np.ndarray:
        """Ids along a path of edges, which runs from the end of the text to its start."""
        numbers = self.piece[edges[::-1]]
        ids = self.ids[np.maximum(numbers, 0)]
        odd = np.flatnonzero(numbers < 0)
        if not len(odd):
            return ids
        parts, at = [], 0
        for k in odd.tolist():
            parts += [ids[at:k], self.spelled[-1 - numbers[k]]]
            at = k + 1
        return np.concatenate([*parts, ids[at:]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, sample: int, place: np.ndarray, step: int, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the arguments."""
    salt = np.uint64((sample * 0x9E3779B97F4A7C15 + step * 0xD6E8FEB86659FD93 + stream * 0xA0761D6478BD642F) % 2**64)
    bits = _mix(key + _mix(place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + salt))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def walk(lattices: Lattices, nodes: np.ndarray, keys: np.ndarray, places: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path from each node to the front of its word. Edges of all paths in turn, and each path's length."""
    who, taken = [], []
    active = np.arange(len(nodes))
    node, step = nodes, 0
    while len(active):
        here = uniform(keys[active], sample, places[active], step, 1)
        edge = lattices.first[node]
        ahead = np.flatnonzero(lattices.upto[edge] <= here)
        while len(ahead):
            edge[ahead] += 1
            ahead = ahead[lattices.upto[edge[ahead]] <= here[ahead]]
        who.append(active)
        taken.append(edge)
        on = ~lattices.opens[edge]
        active, node = active[on], lattices.start[edge[on]]
        step += 1
    counts = np.zeros(len(nodes), np.int64)
    for active in who:
        counts[active] += 1
    offset = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for step, (active, edge) in enumerate(zip(who, taken)):
        out[offset[active] + step] = edge
    return out, counts


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.6931, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def _below(limit: float | np.ndarray, location: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel values of those locations, cut off at the limit; -inf for an empty set."""
    with np.errstate(invalid="ignore"):
        value = -np.logaddexp(-limit, np.log(-np.log(noise)) - location)
    return np.where(np.isneginf(location), -np.inf, value)


class Searches:
    """The searches of a chunk of texts, a step of all of them at a time."""

    def __init__(self, texts: list[list[str]], keys: np.ndarray, vocabulary: Vocabulary):
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        word = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64)
        self.lattices = Lattices(list(index), vocabulary) if index else None
        self.words = np.append(0, np.cumsum([len(t) for t in texts]))
        self.ends = self.lattices.last[word] if index else word
        self.keys = keys
        self.paths: list[list[np.ndarray]] = [[] for _ in texts]
        self.values: list[list[float]] = [[] for _ in texts]
        self.queues: list[list[tuple]] = [[] for _ in texts]

    def run(self, k: int) -> None:
        if self.lattices is None:
            return
        self._draw([(t, -1, 0, (), self._root(t)) for t in range(len(self.keys)) if self.words[t] < self.words[t + 1]], 0, k)
        for sample in range(1, k):
            best = []
            for t, queue in enumerate(self.queues):
                self._settle(t)
                if queue:
                    value, parent, decision, _, excluded = heapq.heappop(queue)
                    best.append((t, parent, decision, excluded, -value))
            self._draw(best, sample, k)
        for t in range(len(self.keys)):
            self._settle(t)

    def _settle(self, t: int) -> None:
        """Divide the sets of several decisions for as long as one of them is first in the queue.

        The largest value of such a set belongs to one of its decisions, each by its share of the set's probability;
        the others' values are Gumbel values cut off at it.
        """
        queue = self.queues[t]
        while queue and not queue[0][4]:
            value, parent, begin, end, _ = heapq.heappop(queue)
            edges = self.paths[t][parent][begin:end]
            chance = self.lattices.chance[edges]
            # only the probabilities relative to each other count, up to the shared front of the path
            front = self.lattices.chance[self.paths[t][parent][:begin]].sum()
            location = front + (np.cumsum(chance) - chance) + _log1mexp(chance)
            share = np.cumsum(np.exp(location - location.max()))
            noise = uniform(self.keys[t : t + 1], parent, np.arange(begin, end + 1), 0, 5)
            winner = min(int(np.searchsorted(share, noise[-1] * share[-1], side="right")), len(share) - 1)
            left = _below(-value, location, noise[:-1])
            left[winner] = -value
            for j in np.flatnonzero(left > -np.inf).tolist():
                heapq.heappush(queue, (-float(left[j]), parent, begin + j, begin + j + 1, (int(edges[j]),)))

    def _root(self, t: int) -> float:
        return float(-np.log(-np.log(uniform(self.keys[t : t + 1], 0, np.zeros(1), 0, 0)[0])))

    def _draw(self, sets: list[tuple], sample: int, k: int) -> None:
        """Draw the best segmentation of one set per text, and queue the sets that it leaves."""
        lat, fronts, nodes, texts, places = self.lattices, [], [], [], []
        for t, parent, decision, excluded, value in sets:
            front, at = np.zeros(0, np.int64), 0
            if parent >= 0:
                path = self.paths[t][parent][:decision]
                edge = self._other_edge(t, sample, self.paths[t][parent][decision], excluded, decision)
                front = np.append(path, edge)
                at = int(lat.opens[front].sum())
                if not lat.opens[edge]:  # the word goes on in front of the edge
                    nodes.append(lat.start[edge : edge + 1])
                    places.append(np.array([at]))
                    texts.append(t)
                    at += 1
            fronts.append(front)
            rest = self.ends[self.words[t] + at : self.words[t + 1]]
            nodes.append(rest)
            places.append(np.arange(at, at + len(rest)))
            texts.append(t)
        if not sets:
            return
        sizes = np.fromiter(map(len, nodes), np.int64, len(nodes))
        owner = np.repeat(np.array(texts), sizes)
        edges, counts = walk(lat, np.concatenate(nodes), self.keys[owner], np.concatenate(places), sample)
        per_text = np.bincount(owner, weights=counts, minlength=len(self.keys)).astype(np.int64)
        low = 0
        for (t, parent, decision, excluded, value), front in zip(sets, fronts):
            path = np.concatenate([front, edges[low : low + per_text[t]]])
            low += per_text[t]
            self.paths[t].append(path)
            self.values[t].append(value)
            number = len(self.paths[t]) - 1
            chance = lat.chance[path]
            skip = len(front)
            reached = np.append(0.0, np.cumsum(chance))
            # runs of decisions: all that share the pieces before a run and differ within it
            number_of_runs = ((len(path) - skip) // RUN + 1).bit_length()
            bounds = np.minimum(skip + RUN * (2 ** np.arange(number_of_runs + 1) - 1), len(path))
            low_at, high_at = reached[bounds[:-1]], reached[bounds[1:]]
            noise = uniform(self.keys[t : t + 1], sample, bounds[:-1], 0, 2)
            left = _below(value, low_at + _log1mexp(high_at - low_at), noise)
            for j in np.flatnonzero(left > -np.inf).tolist():
                heapq.heappush(self.queues[t], (-float(left[j]), number, int(bounds[j]), int(bounds[j + 1]), ()))
            if parent >= 0:  # what is left of the set that this segmentation came from
                gone = (*excluded, int(path[decision]))
                share = 1.0 - np.exp(lat.chance[list(gone)]).sum()
                if len(gone) < lat.first[lat.end[gone[0]] + 1] - lat.first[lat.end[gone[0]]] and share > 0:
                    noise = uniform(self.keys[t : t + 1], sample, np.array([decision]), 0, 3)
                    value = _below(value, np.array([reached[decision] + np.log(share)]), noise)[0]
                    heapq.heappush(self.queues[t], (-float(value), parent, decision, decision + 1, gone))

    def _other_edge(self, t: int, sample: int, chosen: int, excluded: tuple, decision: int) -> int:
        """An edge to the same node that is not excluded, drawn by its chance among those."""
        lat = self.lattices
        node = lat.end[chosen]
        among = np.setdiff1d(np.arange(lat.first[node], lat.first[node + 1]), excluded)
        chance = np.cumsum(np.exp(lat.chance[among]))
        here = uniform(self.keys[t : t + 1], sample, np.array([decision]), 0, 4)[0] * chance[-1]
        return int(among[min(np.searchsorted(chance, here, side="right"), len(among) - 1)])

    def samples(self, t: int, k: int) -> Iterator[tuple[np.ndarray, float, float, float]]:
        """Ids, log-probability, perturbed value and log of the inclusion probability of each sample of a text."""
        queue = self.queues[t]
        threshold = -queue[0][0] if queue else -np.inf
        for path, value in zip(self.paths[t][:k], self.values[t]):
            log_p = float(self.lattices.chance[path].sum())
            if threshold == -np.inf:
                inclusion = 0.0
            else:
                over = log_p - threshold  # the probability is 1 - exp(-exp(over))
                inclusion = over if over < -30 else float(_log1mexp(np.array([-np.exp(min(over, 700.0))]))[0])
            yield self.lattices.pieces_of(path), log_p, value, inclusion


SAMPLES = "doc_id long, rank int, ids array<int>, n_pieces long, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long"


def _sampler(vocabulary: Vocabulary, k: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pattern = re.compile(vocabulary.pattern)

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        known = np.array([(i or 0) % 2**64 for i in ids], np.uint64) + np.array([i is None for i in ids], np.uint64) * np.uint64(977)
        keys = _mix(known + np.uint64(seed % 2**64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        searches = Searches([units_of(t, pattern) for t in texts], keys, vocabulary)
        searches.run(k)
        out: list[list] = [[] for _ in range(7)]
        found = []
        for t, (doc_id, text) in enumerate(zip(ids, texts)):
            samples = searches.samples(t, k) if text else [(np.zeros(0, np.int32), 0.0, searches._root(t), 0.0)]
            for rank, (pieces, log_p, value, inclusion) in enumerate(samples, 1):
                found.append(pieces)
                crc = zlib.crc32(vocabulary.spell(pieces))
                for column, x in zip(out, (doc_id, rank, len(pieces), log_p, value, inclusion, crc)):
                    column.append(x)
        offsets = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        columns = [pa.array(c, kind) for c, kind in zip(out, kinds)]
        names = [part.split()[0] for part in SAMPLES.split(", ")]
        return pa.RecordBatch.from_arrays([*columns[:2], lists, *columns[2:]], names)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held > CHUNK:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            yield rows(ids, texts)

    return sample


def sample_segmentations(
    docs: DataFrame, model_path: str, k: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ``k`` segmentations of every whole text that Gumbel top-k sampling without replacement draws.

    Per sample: doc_id, rank (from 1, falling perturbed value), ids, n_pieces, log_prob of the segmentation among all
    of the text, perturbed, log_inclusion (log of the probability that it is among the k, given the value of the next
    one; 0 if no other exists), decoded_crc32 (of the text decoded from the ids). Pieces weigh by the model's scores
    where those are log-probabilities; of a model with merge ranks by 1 / (rank + 2.7). Characters without a piece are
    spelled in byte pieces. A text with fewer segmentations gives all of them; an empty text has one, without pieces; a
    null text has none and gives no row. Rows with one id and text get the same samples; a null id is a key like any
    other. Only models whose pieces hold word marks in front are taken, and no other normalisation is applied.
    """
    vocabulary = Vocabulary.load(model_path)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_sampler(vocabulary, k, seed), SAMPLES)


def decode_segmentations(samples: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``samples`` with the column ``decoded``: the text that the ids spell; null for null."""
    surface = Vocabulary.load(model_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if ids is None else surface.decode(ids) for ids in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    columns = [c for c in samples.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in samples.select(*columns).dtypes) + ", decoded string"
    return samples.select(*columns).mapInArrow(decode, schema)

"""N-gram Jaccard join by vertical partitioning.

All distinct word n-grams (shingles) stand in one global order: those of crowded counters of a sketch last, otherwise by
hash. The order is cut into fragments, and what two sets share is counted fragment by fragment and summed per pair.

1. Equal sets are one node from here on.
2. The first fragment of a node is its prefix: two sets as similar as asked for must share a shingle of their
   prefixes. Only shingles that several prefixes hold are kept.
3. Families: in every list of a shingle all sets meet the list's most typical member, and each set takes the member
   it meets most often as its pivot. What a set and its pivot do not share is counted fragment by fragment and kept.
   Two sets of one pivot differ in what exactly one of them differs from the pivot in. So they are linked through the
   pivot if the two differences are small, and otherwise only if the differences have enough shingles in common: a
   prefix join over the differences, rarest first, finds those pairs. Near copies that reach the threshold with their
   pivot thus need one comparison each; of those below it only pairs whose rarest differences meet are compared.
   Sets that are not linked to their pivot choose another one among themselves.
4. Pairs of one list that have no pivot in common and are not yet connected: shared shingles are summed over the short
   lists (the first partial overlap); the members of long lists are ordered anew, by how many of them hold a shingle,
   and meet in the rarest. Pairs that cannot reach the threshold whatever the other fragments hold go.
5. The remaining pairs' overlaps are counted in each of the fragments' sets and summed; the threshold decides.

Hashes have 64 bits. No list, group or pair is left out: step 3 settles what step 4 then need not compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import components, stage, thinned
from emberlog.llm.substring import FACTORS, Sequences, WordHashes

#: Counters of the sketch that tells common shingles from rare ones; the order of shingles only affects speed.
SLOT_BITS = 22
CHUNKS = 64
#: Fragments of the order that a set's overlap is counted in.
FRAGMENTS = 8
#: Members of a list whose pairs are all looked at; members of longer lists meet in the shingles that few of them hold.
SHORT_LIST = 16


def shingle_hashes(text: bytes, known: WordHashes, words_each: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of a shorter text the one of all its words; none without words."""
    words = text.lower().split()  # bytes: only A-Z change
    if not words:
        return np.zeros(0, np.uint64)
    hashes = known.of(words)
    size = min(words_each, len(words))
    at = np.arange(len(words) - size + 1)
    return np.unique(Sequences(hashes, FACTORS[0]).hash(at, at + size))


def prefix_length(n: Column | int, percent: int) -> Column | int:
    """Shingles of a set of n of which a set as similar as asked for must share one."""
    if isinstance(n, int):
        return n - -(-percent * n // 100) + 1 if n else 0
    return n - F.ceil(n * percent / 100) + 1


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield text.as_py() or b""


def _node(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def _measure(words_each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its node and number of shingles; at the end of the task the counters, as rows without an id."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counters = WordHashes(), np.zeros(1 << SLOT_BITS, np.uint32)
        names = ["row_id", "doc_id", "node", "n", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            nodes, sizes, waiting, held = [], [], [], 0
            for text in _texts(batch):
                hashes = shingle_hashes(text, known, words_each)
                nodes.append(_node(hashes))
                sizes.append(len(hashes))
                waiting.append((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                held += len(hashes)
                if held > 1 << SLOT_BITS:
                    counters += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.uint32)
                    waiting, held = [], 0
            if held:
                counters += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.uint32)
            blank = pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *blank], names
            )
        parts = counters.reshape(CHUNKS, -1)
        used = [k for k in range(CHUNKS) if parts[k].any()]
        columns = [*[[None] * len(used)] * 4, used, [parts[k].tobytes() for k in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return measure


def _sum_counters(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64) for c in group["counts"])
    return pa.table({"chunk": group["chunk"].slice(0, 1), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def crowded_slots(counters: DataFrame, partitions: int) -> np.ndarray:
    """Bit per counter that stands well above the mean: at most 2**SLOT_BITS bits, whatever the corpus."""
    parts = max(1, partitions // 64)
    salted = counters.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(parts)))
    schema = "chunk int, counts binary"
    some = salted.groupBy("chunk", "salt").applyInArrow(_sum_counters, schema)
    rows = some.groupBy("chunk").applyInArrow(_sum_counters, schema).collect()
    counts = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.uint32)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    mean = counts.mean()
    return np.packbits(counts.ravel() > mean + 6 * mean**0.5 + 8)


def _prefixes(words_each: int, percent: int, crowded: np.ndarray) -> Callable:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, is_crowded = WordHashes(), np.unpackbits(crowded)
        for batch in batches:
            nodes, sizes, found = [], [], []
            for text in _texts(batch):
                hashes = shingle_hashes(text, known, words_each)
                if len(hashes):
                    last = is_crowded[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    order = np.argsort(last, kind="stable")[: prefix_length(len(hashes), percent)]
                    nodes.append(_node(hashes))
                    sizes.append(len(hashes))
                    found.append(hashes[order].view(np.int64))
            offsets = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists], ["node", "n", "prefix"]
            )

    return prefixes


def _fragments(words_each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sets of texts, cut at fixed places of the hash order: one row per set and fragment that holds any."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        width = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for batch in batches:
            nodes, numbers, parts = [], [], []
            for text in _texts(batch):
                hashes = shingle_hashes(text, known, words_each)
                of = hashes >> width
                for number in np.unique(of).tolist():
                    nodes.append(_node(hashes))
                    numbers.append(number)
                    parts.append(hashes[of == number].view(np.int64))
            offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), lists], ["node", "fragment", "hashes"]
            )

    return fragments


def linked(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return overlap * 100 >= (n_a + n_b - overlap) * percent


class _Texts:
    """Sets of nodes on demand: only texts of the nodes in question are read to the end and shuffled."""

    def __init__(self, docs: DataFrame, measured: DataFrame, words_each: int):
        self.docs, self.words_each = docs, words_each
        self.rows = measured.filter("n > 0").groupBy("node").agg(F.min("row_id").alias("row_id"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        rows = stage(self.rows.join(nodes, "node", "left_semi").select("row_id"))
        texts = thinned(self.docs, F.col("row_id"), rows, F.col("row_id")).join(rows, "row_id", "left_semi")
        return texts.mapInArrow(_fragments(self.words_each), "node long, fragment int, hashes array<long>").dropDuplicates(
            ["node", "fragment"]
        )


def verified(pairs: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose overlap, counted in each fragment and summed, reaches the threshold."""
    pairs = stage(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stage(texts.sets(nodes))
    second = pairs.join(sets.select(F.col("node").alias("b"), "fragment", F.col("hashes").alias("hashes_b")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), "fragment", "hashes"), ["a", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("hashes", "hashes_b")).alias("shared"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return stage(total.filter(linked(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))


def similar_sizes(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _labelled(lists: DataFrame, links: DataFrame, settled: DataFrame) -> DataFrame:
    """Members of the lists with the component that the links so far give them, and their family's pivot.

    A pivot that has a pivot itself stays with its own; it was compared with each of its members.
    """
    labels = components(links, "a", "b")
    own = settled.groupBy("node").agg(F.max_by("root", F.col("root") != F.col("node")).alias("root"))
    known = lists.join(labels, "node", "left").join(own, "node", "left")
    return known.withColumns({"component": F.coalesce("component", "node"), "root": F.coalesce("root", "node")})


def _pivots(lists: DataFrame, percent: int) -> DataFrame:
    """Sets (a, n_a) with a pivot (root, n_root): the most typical member of the lists they are in, met most often.

    Typical is who shares the most shingles with the most others: the length of the lists of its prefix, summed. The
    pivot of a pivot takes its place, so that a family comes to one. Sets that meet it in less than a third of their
    prefix get none.
    """
    lengths = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("length"))
    typical = lists.join(lengths, "shingle").groupBy("node", "n").agg(F.sum("length").alias("typical"))
    typical = typical.select("node", F.struct("typical", "node", "n").alias("rank"))
    chief = lists.join(typical, "node").groupBy("shingle").agg(F.max("rank").alias("chief"))
    met = lists.join(chief, "shingle").groupBy("node", "n", "chief").agg(F.count(F.lit(1)).alias("times"))
    best = met.filter("node <> chief.node").groupBy("node", "n").agg(F.max(F.struct("times", "chief")).alias("best"))
    near = stage(
        best.filter(F.col("best.times") * 3 >= prefix_length(F.col("n"), percent)).select(
            F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("best.chief.node").alias("root"),
            F.col("best.chief.n").alias("n_root"),
        )
    )
    above = near.select(F.col("a").alias("root"), F.col("root").alias("top"), F.col("n_root").alias("n_top"))
    up = near.join(above, "root", "left")
    return up.select("a", "n_a", F.coalesce("top", "root").alias("root"), F.coalesce("n_top", "n_root").alias("n_root"))


def _differences(pivots: DataFrame, texts: _Texts) -> DataFrame:
    """Per set of ``pivots`` and fragment the shingles that either it or its pivot holds, but not both."""
    pivots = stage(pivots)
    nodes = pivots.select(F.col("a").alias("node")).unionByName(pivots.select(F.col("root").alias("node"))).distinct()
    sets = stage(texts.sets(nodes))
    parts = pivots.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    mine = sets.select(F.col("node").alias("a"), "fragment", F.col("hashes").alias("mine"))
    other = sets.select(F.col("node").alias("root"), "fragment", F.col("hashes").alias("other"))
    none = F.array().cast("array<long>")
    both = parts.join(mine, ["a", "fragment"], "left").join(other, ["root", "fragment"], "left")
    both = both.withColumns({"mine": F.coalesce("mine", none), "other": F.coalesce("other", none)})
    differ = F.concat(F.array_except("mine", "other"), F.array_except("other", "mine"))
    return stage(both.select("a", "n_a", "root", "n_root", differ.alias("differ")))


def _weight(n: Column, d: Column | int, percent: int) -> Column:
    """Of a set of n shingles of which d differ from the pivot's: two sets are linked if their weights and
    2 * (100 + percent) for each difference that they have in common sum to 0 or more."""
    return (100 - percent) * n.cast("long") - (100 + percent) * d


def _sizes_of_differences(differences: DataFrame, percent: int) -> DataFrame:
    """(a, root, n_a, d, weight, weight_root) of the sets that are at least half like their pivot."""
    sizes = differences.groupBy("a", "n_a", "root", "n_root").agg(F.sum(F.size("differ")).alias("d"))
    near = sizes.filter(F.col("d") * 2 <= F.col("n_a") + F.col("n_root"))
    n_a, n_root = F.col("n_a"), F.col("n_root")
    return near.select(
        "a", "root", "n_a", "d", _weight(n_a, F.col("d"), percent).alias("weight"),
        _weight(n_root, 0, percent).alias("weight_root"),
    )


def _pairs_of_families(differences: DataFrame, sizes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one pivot, in different components, whose differences may have enough shingles in common.

    A set linked to the pivot needs a partner that is not, and one that is not linked anyhow has a lesser weight than
    the pivot: both tell how many differences the two must have in common at least, and so how many of the rarest
    have to be looked at. Sets alike but for what differs from the pivot alike are found through any of these.
    """
    unit = 2 * (100 + percent)
    placed = sizes.join(labels.select(F.col("node").alias("a"), "component"), "a", "left")
    placed = placed.withColumns(
        {"component": F.coalesce("component", "a"), "inside": F.col("weight") + F.col("weight_root") >= 0}
    )
    open_roots = placed.filter("not inside").select("root").distinct()
    placed = placed.filter("d > 0").join(open_roots, "root", "left_semi")
    least = F.when(F.col("inside"), F.col("weight_root") - F.col("weight")).otherwise(
        2 * percent - F.col("weight") - F.col("weight_root")
    )
    placed = stage(placed.withColumn("needed", F.greatest(F.ceil(least / unit), F.lit(1))))
    elements = differences.join(placed, ["a", "root", "n_a"]).select(
        "a", "n_a", "root", "d", "weight", "component", "needed", F.explode("differ").alias("element")
    )
    elements = stage(elements)
    held = elements.groupBy("root", "element").agg(F.count(F.lit(1)).alias("held"))
    rarest = Window.partitionBy("root", "a").orderBy("held", "element")
    ranked = elements.join(held, ["root", "element"]).withColumn("place", F.row_number().over(rarest) - 1)
    prefix = ranked.filter("held > 1 and place <= d - needed").withColumn("left", F.col("d") - F.col("place"))
    prefix = stage(prefix.select("root", "element", "a", "n_a", "weight", "component", "left"))
    others = prefix.select(
        "root", "element", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("weight").alias("weight_b"),
        F.col("component").alias("component_b"), F.col("left").alias("left_b"),
    )
    reach = F.col("weight") + F.col("weight_b") + unit * F.least("left", "left_b") >= 0
    met = prefix.join(others, ["root", "element"]).filter(
        (F.col("a") < F.col("b")) & (F.col("component") != F.col("component_b")) & reach
    )
    return met.select("a", "b", "n_a", "n_b").distinct()


def _family_links(lists: DataFrame, texts: _Texts, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets to pivots and within families, and (node, root) of the sets whose family is thereby settled."""
    differences = _differences(_pivots(lists, percent), texts)
    sizes = stage(_sizes_of_differences(differences, percent))
    linked_to_pivot = sizes.filter("weight + weight_root >= 0")
    links = linked_to_pivot.select("a", F.col("root").alias("b"))
    # the others choose a pivot among themselves: families beside the family
    rest = lists.join(linked_to_pivot.select(F.col("a").alias("node")), "node", "left_anti")
    again = _sizes_of_differences(_differences(_pivots(stage(rest), percent), texts), percent)
    links = stage(links.unionByName(again.filter("weight + weight_root >= 0").select("a", F.col("root").alias("b"))))
    pairs = _pairs_of_families(differences, sizes, components(links, "a", "b"), percent)
    settled = sizes.select(F.col("a").alias("node"), "root").unionByName(
        sizes.select(F.col("root").alias("node"), "root").distinct()
    )
    return stage(links.unionByName(verified(pairs, texts, percent))), settled


def _promising(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that may reach the threshold if they share ``shared`` shingles of their prefixes.

    Beyond the end of the prefix that ends first, one of the two has only n - prefix shingles left to share.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    left = F.greatest(n_a - prefix_length(n_a, percent), n_b - prefix_length(n_b, percent))
    return met.filter(linked(F.col("shared") + left, n_a, n_b, percent)).drop("shared")


def _open_lists(labelled: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components and families, with the list's ``length``."""
    lists = labelled.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("length"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("root").alias("first"), F.max("root").alias("last"),
    ).filter("low < high and first < last").select("shingle", "length")
    return stage(labelled.join(lists, "shingle").select("shingle", "length", "node", "n", "component", "root"))


def _met(rows: DataFrame, together: Column, percent: int, *measures: Column) -> DataFrame:
    """(a, b, n_a, n_b) and ``measures`` of pairs of one shingle's rows in different components and families."""
    other = rows.select("shingle", *(F.col(c).alias(f"{c}_b") for c in rows.columns if c != "shingle"))
    return (
        rows.join(other, "shingle")
        .filter((F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")))
        .filter((F.col("root") != F.col("root_b")) & similar_sizes(F.col("n"), F.col("n_b"), percent) & together)
        .groupBy(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("n").alias("n_a"), "n_b")
        .agg(*measures)
    )


def _pairs_of_short_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the threshold if they meet in these lists only."""
    met = _met(lists, F.lit(True), percent, F.count(F.lit(1)).alias("shared"))
    return _promising(met, percent)


def _pairs_of_long_lists(lists: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """Pairs of members of these lists that may reach the threshold, from whole sets in another order.

    The sketch counts rows, so copies make all of a text's shingles look common, and a passage of many texts then stands
    in their prefixes. Here the order is by the number of members that hold a shingle, the rarest first, and two members
    meet only in shingles from which both have as many left as they must share. They share those that they met in, and
    at most all from the last of these on.
    """
    members = stage(lists.select("node", "n", "component", "root").distinct())
    shingles = stage(texts.sets(members.select("node")).select("node", F.explode("hashes").alias("shingle")))
    held = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    of_node = Window.partitionBy("node")
    # shingles that no other member holds come first; ``left`` counts the shingle itself
    left = F.count(F.lit(1)).over(of_node) - F.row_number().over(of_node.orderBy("held", "shingle")) + 1
    placed = shingles.join(held, "shingle").withColumn("left", left).drop("held").join(members, "node")
    prefix = stage(placed.filter(F.col("left") > F.col("n") - prefix_length(F.col("n"), percent)))
    left = F.least("left", "left_b")
    enough = linked(left, F.col("n"), F.col("n_b"), percent)
    met = _met(prefix, enough, percent, (F.count(F.lit(1)) + F.min(left) - 1).alias("most"))
    return met.filter(linked(F.col("most"), F.col("n_a"), F.col("n_b"), percent)).drop("most")


def _open_pairs(labelled: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """Pairs of one list in different components and families that may reach the threshold.

    A pair that meets in a long list is found there; one that does not has all it shares in the short ones. The rows of a
    short list's pairs grow with its length, those of the long lists with the pairs that are alike in rare shingles.
    """
    lists = _open_lists(labelled)
    short = _pairs_of_short_lists(lists.filter(F.col("length") <= SHORT_LIST).drop("length"), percent)
    long = _pairs_of_long_lists(lists.filter(F.col("length") > SHORT_LIST), texts, percent)
    return short.unionByName(long).distinct()


def jaccard_components(
    docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links of similar texts reach.

    A set holds the distinct ``words_each``-word shingles of the whole text, A-Z in lower case, words being runs other
    than ASCII white space; a shorter text is one shingle, one without words (or null) none. Two rows are linked if
    100 * shared >= percent * union. Rows without shingles are linked with nothing. Rows with equal sets, repeated
    rows too, share a component. A null id is never the smallest, and stands alone if nothing else is reached. An
    empty table gives no rows; other columns are not read.
    """
    rows, nodes = _components_of_rows(_keyed(docs, id_col, text_col), words_each, percent)
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = nodes.select("node", "component").distinct().join(least, "component").select("node", "component_id")
    return rows.join(by_node, "node", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one_of_component(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: one of the smallest id.

    Rows without shingles all stay; a row without an id stays if its component holds no other.
    """
    keyed = _keyed(docs, "doc_id", "text")
    rows, nodes = _components_of_rows(keyed, words_each, percent)
    last = F.lit(2**63 - 1)
    first = nodes.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("doc_id"), "row_id")).alias("first"))
    kept = first.select(F.col("first.row_id").alias("row_id"), F.lit(True).alias("single")).unionByName(
        rows.filter("n = 0").select("row_id", F.lit(False).alias("single")).distinct()
    )
    copy = F.row_number().over(Window.partitionBy("row_id").orderBy("doc_id"))
    joined = keyed.drop("text").join(kept, "row_id").withColumn("copy", copy).filter("not single or copy = 1")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id (of id and text), doc_id and text of every row, and the whole row beside them so that no names clash."""
    text, doc_id = F.col(f"row.`{text_col}`").cast("string"), F.col(f"row.`{id_col}`").cast("long")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        F.xxhash64(doc_id, F.xxhash64(text)).alias("row_id"), doc_id.alias("doc_id"), text.alias("text"), "row"
    )


def _components_of_rows(keyed: DataFrame, words_each: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Measured rows (row_id, doc_id, node, n), and those with shingles with their component."""
    schema = "row_id long, doc_id long, node long, n int, chunk int, counts binary"
    found = stage(keyed.select("row_id", "doc_id", "text").mapInArrow(_measure(words_each), schema))
    rows = found.filter("chunk is null").select("row_id", "doc_id", "node", "n")
    counters = found.filter("chunk is not null").select("chunk", "counts")
    crowded = crowded_slots(counters, counters.count() // CHUNKS)
    texts = keyed.select("row_id", "text")
    sets = _Texts(texts, rows, words_each)
    prefixes = texts.mapInArrow(_prefixes(words_each, percent, crowded), "node long, n int, prefix array<long>")
    nodes = stage(prefixes.dropDuplicates(["node"]))
    postings = nodes.select("node", "n", F.explode("prefix").alias("shingle"))
    # a set holds a shingle once; most shingles are held by one set only and are not worth a shuffle
    live = stage(postings.groupBy("shingle").count().filter("count > 1").select("shingle"))
    maybe = thinned(postings, F.col("shingle"), live, F.col("shingle"), bits=26)
    lists = stage(maybe.join(live, "shingle", "left_semi"))
    links, settled = _family_links(lists, sets, percent)
    rest = verified(_open_pairs(_labelled(lists, links, settled), sets, percent), sets, percent)
    labels = components(links.unionByName(rest), "a", "b")
    placed = rows.filter("n > 0").join(labels, "node", "left")
    return rows, placed.withColumn("component", F.coalesce("component", "node"))

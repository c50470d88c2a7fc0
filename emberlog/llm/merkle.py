"""Merkle manifest of a dataset over a postorder append log.

Each source is a tree of fan-out 16 over its rows in order; the sources' roots are the leaves of one more tree. Aligned
builders, each over 256 consecutive leaves, write their nodes in the order in which they are complete: a run of leaves,
their parent, the next run, and the builder's top last. Such a segment is a gapless stretch of the tree's log, because
the place of node ``index`` of ``level`` follows from subtree sizes alone (``node_position``). Nodes above the builders
are written by builders over 256 tops, and so on, at the places left for them. A proof addresses its siblings by place:
the two lowest levels lie in the leaf's own segment, the others are joined by place, once for 256 leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import crc_mod, stage
from emberlog.operators.ordering import with_dense_position

#: A run has at most 16 nodes: 4 bits an index and level. A builder covers two levels.
BITS = 4
RUN = 1 << BITS
BLOCK_BITS = 2 * BITS
#: Rows that share one small row of their source's bounds.
SPAN_BITS = 12
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One level of a proof: the digests of the run before and after the node, joined.
PATH = "array<struct<before:string,after:string>>"


def node_position(level: int, index: Column, leaves: Column, levels: int) -> Column:
    """Place, from 0, of a node in the log of a tree with ``leaves`` leaves and at most ``levels`` levels above them.

    Written before it are, of its own level and below, all nodes complete with its last leaf, and of the levels above
    those complete with an earlier leaf.
    """
    end = F.least(F.shiftleft(index + 1, BITS * level), leaves)
    last = end == leaves
    place = F.lit(-1).cast("long")
    for k in range(levels + 1):
        done = F.shiftright(end, BITS * k)
        if k > level:
            place = place + F.shiftright(end - 1, BITS * k)
        else:
            place = place + F.when(last, F.shiftright(leaves + ((1 << BITS * k) - 1), BITS * k)).otherwise(done)
    return place


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of every field as UTF-8 byte count, colon and value, or a dash where it is null."""
    texts = [fields[name].cast("string") for name in FIELDS]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``leaf_no``, their place in their ``tree``, and ``leaves``, the tree's size; a hot tree stays dealt out."""
    spans_of = F.shiftright("_g", SPAN_BITS)
    ranked = with_dense_position(rows, ["tree", *order], "_g").withColumn("_span", spans_of)
    spans = stage(ranked.groupBy("tree", "_span").agg(F.min("_g").alias("_low"), F.count("*").alias("_n")))
    trees = spans.groupBy("tree").agg(F.min("_low").alias("_first"), F.sum("_n").alias("leaves"))
    bounds = spans.join(trees, "tree").select("tree", "_span", "_first", "leaves")
    return ranked.join(bounds, ["tree", "_span"]).withColumn("leaf_no", F.col("_g") - F.col("_first")).drop("_g", "_span", "_first")


def _hashed_runs(digests: Column) -> Column:
    """Parents of the runs of an array of at least one digest."""
    runs = F.sequence(F.lit(0), F.shiftright(F.size(digests) - 1, BITS))
    return F.transform(runs, lambda r: F.sha2(_joined(F.slice(digests, r * RUN + 1, F.lit(RUN))), 256))


def _completed(block: DataFrame) -> DataFrame:
    """Add ``parents`` and ``top`` to aligned blocks of ``digests``, with ``width`` nodes on the tree's level."""
    one, two = F.col("width") > 1, F.col("width") > RUN
    return block.withColumn("parents", F.when(one, _hashed_runs(F.col("digests")))).withColumn(
        "top", F.when(two, F.sha2(_joined(F.col("parents")), 256)).when(one, F.col("parents")[0]).otherwise(F.col("digests")[0])
    )


def _segment() -> Column:
    """Nodes of a block in completion order: each run, its parent, and in the end the top."""
    runs = F.sequence(F.lit(0), F.size("parents") - 1)
    lower = F.flatten(
        F.transform(runs, lambda r: F.concat(F.slice("digests", r * RUN + 1, F.lit(RUN)), F.array(F.col("parents")[r])))
    )
    return F.when(F.col("width") <= 1, F.col("digests")).when(F.col("width") <= RUN, lower).otherwise(
        F.concat(lower, F.array("top"))
    )


def _width(level: int) -> Column:
    """Nodes of the tree on a level."""
    return F.shiftright(F.col("leaves") + ((1 << BITS * level) - 1), BITS * level)


def _step(own: Column, low: Column, high: Column, at) -> Column:
    """Siblings of node ``own`` of the run low..high, each read at its place."""
    before = F.filter(F.sequence(low, high), lambda j: j < own)
    after = F.filter(F.sequence(low, high), lambda j: j > own)
    return F.struct(_joined(F.transform(before, at)).alias("before"), _joined(F.transform(after, at)).alias("after"))


class Log:
    """The staged log of a forest: ``segments`` of the lowest builders and ``tiers`` of single nodes above them."""

    def __init__(self, rows: DataFrame, payload: list[str]):
        """``rows``: tree, leaf_no, leaves, digest and ``payload`` columns, one row per leaf."""
        members = F.sort_array(F.collect_list(F.struct("leaf_no", "digest", *payload)))
        blocks = (
            rows.withColumn("block", F.shiftright("leaf_no", BLOCK_BITS))
            .groupBy("tree", "block")
            .agg(F.max("leaves").alias("leaves"), members.alias("members"))
            .withColumns({"digests": F.col("members.digest"), "width": F.col("leaves")})
        )
        self.payload = payload
        self.segments = stage(_completed(blocks).select("tree", "block", "leaves", "members", _segment().alias("log"), "top"))
        largest = self.segments.agg(F.max("leaves")).first()[0] or 0
        self.levels = 0
        while largest > 1 << BITS * self.levels:
            self.levels += 1
        #: tiers[t]: nodes of level 2 * (t + 1), one row each
        self.tiers = [self.segments.select("tree", F.col("block").alias("index"), "leaves", "top")]
        self.above: list[DataFrame] = []
        for level in range(2, self.levels, 2):
            grouped = (
                self.tiers[-1].filter(_width(level) > 1)
                .groupBy("tree", F.shiftright("index", BLOCK_BITS).alias("block"))
                .agg(F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("index", "top"))).alias("kept"))
                .withColumns({"digests": F.col("kept.top"), "width": _width(level)})
            )
            built = stage(_completed(grouped).select("tree", "block", "leaves", "parents", "top"))
            self.above.append(built)
            self.tiers.append(built.select("tree", F.col("block").alias("index"), "leaves", "top"))

    def roots(self) -> DataFrame:
        """``tree, leaves, subroot``."""
        tops = None
        for tier, nodes in enumerate(self.tiers):
            one = nodes.filter(_width(2 * (tier + 1)) == 1)
            if tier:  # those that were complete below are listed there
                one = one.filter(_width(2 * tier) > 1)
            one = one.select("tree", "leaves", F.col("top").alias("subroot"))
            tops = one if tops is None else tops.unionByName(one)
        return tops

    def _addressed(self, tier: int) -> DataFrame:
        """``tree, place, node`` of levels 2 * (tier + 1) and the one above it, as the log has them."""
        level = 2 * (tier + 1)
        children = self.tiers[tier].filter(_width(level) > 1)
        lower = children.select(
            "tree", node_position(level, F.col("index"), F.col("leaves"), self.levels).alias("place"), F.col("top").alias("node")
        )
        runs = (
            self.above[tier].filter(_width(level + 1) > 1)
            .select("tree", "block", "leaves", F.posexplode("parents").alias("_r", "node"))
        )
        upper = runs.select(
            "tree",
            node_position(level + 1, F.col("block") * RUN + F.col("_r"), F.col("leaves"), self.levels).alias("place"),
            "node",
        )
        return lower.unionByName(upper)

    def _tier_paths(self, tier: int, outer: DataFrame) -> DataFrame:
        """Proofs of the nodes of a tier, ``tree, index, path, ...``; ``outer`` has those of the tier above or of whole trees."""
        level = 2 * (tier + 1)
        nodes = self.tiers[tier].filter(_width(level) > 1).select("tree", "index", "leaves")
        asked = []
        for up in (0, 1):
            own = F.shiftright("index", BITS * up)
            low = F.shiftleft(F.shiftright(own, BITS), BITS)
            high = F.least(low + (RUN - 1), _width(level + up) - 1)
            wanted = nodes.filter(_width(level + up) > 1).select(
                "tree", "index", "leaves", F.lit(up).alias("up"), own.alias("own"), F.explode(F.sequence(low, high)).alias("sibling")
            )
            asked.append(
                wanted.select(
                    "tree", "index", "up", "own", "sibling",
                    node_position(level + up, F.col("sibling"), F.col("leaves"), self.levels).alias("place"),
                )
            )
        found = asked[0].unionByName(asked[1]).join(self._addressed(tier), ["tree", "place"])
        # the node itself is asked for too, so that a node alone in its run still gives a step
        side = lambda keep: _joined(F.transform(F.filter(F.col("run"), keep), lambda s: s["node"]))
        steps = (
            found.groupBy("tree", "index", "up")
            .agg(F.sort_array(F.collect_list(F.struct("sibling", "node"))).alias("run"), F.first("own").alias("own"))
            .select(
                "tree", "index", "up",
                F.struct(
                    side(lambda s: s["sibling"] < F.col("own")).alias("before"),
                    side(lambda s: s["sibling"] > F.col("own")).alias("after"),
                ).alias("step"),
            )
            .groupBy("tree", "index")
            .agg(F.sort_array(F.collect_list(F.struct("up", "step"))).alias("steps"))
        )
        own_path = F.col("steps.step").cast(PATH)
        higher = outer.withColumnsRenamed({"index": "_parent", "path": "_path"})
        return (
            steps.withColumn("_parent", F.shiftright("index", BLOCK_BITS))
            .join(higher, ["tree", "_parent"])
            .withColumn("path", F.concat(own_path, "_path"))
            .drop("steps", "_parent", "_path")
        )

    def leaves_with_paths(self, of_tree: DataFrame) -> DataFrame:
        """Every leaf with its payload, ``digest``, ``position`` in the log, ``path``, and the further columns of ``of_tree``.

        ``of_tree``: one row per tree with ``path``, what the proofs end with.
        """
        outer_columns = [c for c in of_tree.columns if c not in ("tree", "path")]
        heads = self.roots().select("tree", "leaves").join(of_tree, "tree")
        paths = None
        for tier in reversed(range(len(self.tiers))):
            whole = heads.filter(_width(2 * (tier + 1)) == 1)
            if tier:
                whole = whole.filter(_width(2 * tier) > 1)
            whole = whole.select("tree", F.lit(0).cast("long").alias("index"), "path", *outer_columns)
            paths = whole if paths is None else self._tier_paths(tier, paths).unionByName(whole)
            paths = stage(paths)
        held = self.segments.join(paths.withColumnsRenamed({"index": "block", "path": "_outer"}), ["tree", "block"])
        def place(level: int, index: Column) -> Column:
            return node_position(level, index, F.col("leaves"), self.levels)

        def reader(level: int):
            return lambda j: F.get("log", (place(level, j) - F.col("_first")).cast("int"))

        held = held.withColumn("_first", place(0, F.shiftleft("block", BLOCK_BITS)))

        def lower_path(leaf_no: Column) -> Column:
            steps = []
            for level in (0, 1):
                own = F.shiftright(leaf_no, BITS * level)
                low = F.shiftleft(F.shiftright(own, BITS), BITS)
                high = F.least(low + (RUN - 1), _width(level) - 1)
                steps.append(_step(own, low, high, reader(level)))
            return (
                F.when(F.col("leaves") <= 1, F.array().cast(PATH))
                .when(F.col("leaves") <= RUN, F.array(steps[0]).cast(PATH))
                .otherwise(F.array(*steps).cast(PATH))
            )

        proven = F.transform("members", lambda m: F.struct(m.alias("leaf"), lower_path(m["leaf_no"]).alias("lower")))
        out = held.select("tree", "leaves", "_outer", *outer_columns, F.explode(proven).alias("m"))
        return out.select(
            "tree",
            *(F.col(f"m.leaf.{c}").alias(c) for c in ("leaf_no", "digest", *self.payload)),
            place(0, F.col("m.leaf.leaf_no")).alias("position"),
            F.concat("m.lower", "_outer").alias("path"),
            *outer_columns,
        )


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda done, step: F.sha2(F.concat(step["before"], done, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(_joined(F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


def merkle_manifest(docs: DataFrame, tamper_every: int = 5) -> DataFrame:
    """Leaf, place, proof and verification of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Returns doc_id, source, leaf, subroot, root, position (of the leaf in its source's log), path (siblings level by
    level), tampered (the leaf after tampering, null where none is done), folded_root and verified. Where the crc32 of the decimal doc_id is
    divisible by ``tamper_every``, tampering lower-cases the text's A-Z. Null fields count as a dash; null sources form a tree of their own,
    the first. In a source rows ascend by doc_id, null first, and rows of one doc_id by leaf digest; rows that are the same
    throughout take places next to each other. Other columns are ignored. No rows in: no rows out.
    """
    spark = docs.sparkSession
    fields = {name: F.col(name) for name in FIELDS}
    tampered = leaf_digest(fields | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)})
    rows = stage(
        docs.select(
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
            F.col("doc_id").cast("long").alias("doc_id"),
            leaf_digest(fields).alias("digest"),
            F.when(crc_mod(F.col("doc_id"), tamper_every) == 0, tampered).alias("tampered"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    log = Log(_ranked(rows, ["doc_id", "digest", "_row"]), ["doc_id", "tampered"])
    subroots = log.roots().select("tree", F.col("subroot").alias("digest"))
    sources = with_dense_position(subroots, ["tree"], "leaf_no").withColumnRenamed("tree", "source")
    head = Log(
        sources.withColumns({"tree": F.lit(""), "leaves": F.lit(sources.count()).cast("long")}), ["source"]
    )
    top = head.roots().first()
    root = F.lit(top["subroot"] if top else None).cast("string")
    no_more = spark.createDataFrame([("", [])], f"tree string, path {PATH}")
    of_tree = head.leaves_with_paths(no_more).select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "path")
    proven = log.leaves_with_paths(stage(of_tree))
    return proven.select(
        "doc_id",
        F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("source"),
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        "position",
        "path",
        "tampered",
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest with each proof as one digest."""
    return merkle_manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )

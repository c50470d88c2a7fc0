"""Find which of many needles occur in which texts: an equi-join on each needle's rarest trigram."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage_table


def grams(text: Column, size: int = 3) -> Column:
    """Distinct substrings of ``size`` characters."""
    n = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def rarest_gram(needles: DataFrame, key: list[str], pieces: Column, counts: DataFrame | None = None) -> DataFrame:
    """(key…, gram): for each needle one gram of its ``pieces`` (array of texts) that is least common.

    ``counts`` (gram, n) says how common a gram is; by default it is counted over the needles.
    A needle with no piece of three characters falls back to two.
    """
    three = F.flatten(F.transform(pieces, lambda p: grams(p, 3)))
    two = F.flatten(F.transform(pieces, lambda p: grams(p, 2)))
    each = needles.select(*key, F.explode(F.array_distinct(F.when(F.size(three) > 0, three).otherwise(two))).alias("gram"))
    return _rarest(each, key, counts).select(*key, "gram")


def _rarest(each: DataFrame, key: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(key…, n, gram): of the rows (key…, gram) of each needle that of the least common gram."""
    if counts is None:
        counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    weighed = each.join(counts.hint("merge"), "gram")
    return weighed.groupBy(*key).agg(F.min(F.struct("n", "gram")).alias("_g")).select(*key, "_g.n", "_g.gram")


#: Needles that may share a word before grams are looked at too; what tells a word from a gram.
COMMON_WORD = 64
WORD = "word:"
_SPACE = r"[\t\n\x0B\f\r ]"


def _words(text: Column, inner: bool) -> Column:
    """Distinct words between white space; ``inner`` leaves out a word that may go on outside the text."""
    held = F.split(text, _SPACE)
    if inner:
        held = F.slice(held, 2, F.greatest(F.size(held) - 2, F.lit(0)))
    return F.transform(F.array_distinct(F.filter(held, lambda w: w != "")), lambda w: F.concat(F.lit(WORD), w))


def rarest_part(needles: DataFrame, key: str, pieces: Column) -> DataFrame:
    """(key, gram): for each needle a whole word or a gram of its ``pieces`` that few other needles have.

    A word with white space on both sides inside a piece is a word of every text with that piece. The number of words
    grows with the needles where that of grams does not, so most needles get one they hardly share; grams are taken
    where a needle has no such word, or only common ones.
    """
    held = needles.select(key, pieces.alias("_p"))
    words = F.array_distinct(F.flatten(F.transform("_p", lambda p: _words(p, True))))
    by_word = stage_table(_rarest(held.select(key, F.explode(words).alias("gram")), [key]))
    rare = by_word.filter(F.col("n") <= COMMON_WORD).select(key, "gram")
    rest = held.join(rare.hint("merge"), key, "left_anti")
    three = F.flatten(F.transform("_p", lambda p: grams(p, 3)))
    two = F.flatten(F.transform("_p", lambda p: grams(p, 2)))
    each = rest.select(key, F.explode(F.array_distinct(F.when(F.size(three) > 0, three).otherwise(two))).alias("gram"))
    other = _rarest(each, [key]).unionByName(by_word.filter(F.col("n") > COMMON_WORD))
    least = other.groupBy(key).agg(F.min(F.struct("n", "gram")).alias("_g")).select(key, "_g.gram")
    return rare.unionByName(least)


def part_filter(anchors: DataFrame) -> Callable[[Column], Column]:
    """Words and grams of a text that may be among the ``gram`` of ``anchors``: all that are, and few others."""
    is_word = F.startswith("gram", F.lit(WORD))
    longest = anchors.filter(is_word).agg(F.max(F.char_length("gram"))).first()[0]
    keep_words, keep_grams = gram_filter(anchors.filter(is_word)), gram_filter(anchors.filter(~is_word))
    nothing = F.array().cast("array<string>")

    def keep(text: Column) -> Column:
        found = nothing if longest is None else keep_words(
            F.filter(_words(text, False), lambda w: F.char_length(w) <= longest)
        )
        return found if keep_grams is None else F.concat(found, keep_grams(text_grams(text)))

    return keep


def text_grams(text: Column, with_pairs: bool = True) -> Column:
    """Grams of a text to look anchors up with."""
    return F.array_distinct(F.concat(grams(text, 3), grams(text, 2))) if with_pairs else grams(text, 3)


#: Bits of the map that wanted grams are looked up in, in words of 64.
MAP_BITS = 1 << 16


def gram_filter(anchors: DataFrame) -> Callable[[Column], Column] | None:
    """Keeps of an array of grams those that may be among the ``gram`` of ``anchors``: all that are, and few others.

    None when there are no anchors.
    The map is 8 KB whatever the number of anchors; with very many of them it lets all pass.
    """
    place = F.pmod(F.xxhash64("gram"), F.lit(MAP_BITS))
    bits = anchors.select(place.alias("b")).distinct().groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")
    )
    words = [0] * (MAP_BITS // 64)
    for row in bits.collect():  # at most 1024 rows
        words[row["w"]] = row["bits"]
    if not any(words):
        return None
    held = F.array(*(F.lit(w).cast("bigint") for w in words))

    def keep(grams: Column) -> Column:
        slot = lambda g: F.pmod(F.xxhash64(g), F.lit(MAP_BITS))
        return F.filter(grams, lambda g: F.getbit(F.get(held, F.floor(slot(g) / 64).cast("int")), (slot(g) % 64).cast("int")) == 1)

    return keep

"""From a message back to the line of code whose string literal it came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.grams import gram_filter, rarest_gram, text_grams
from emberlog.operators.relevance import in_skipped_folder
from emberlog.session import small_side, stage_table

# Least needle length, searched extensions.
MIN_NEEDLE_BYTES = 8
EXTENSIONS = (
    "rs", "go", "py", "js", "ts", "jsx", "tsx", "java", "kt", "rb", "c", "cc", "cpp", "h", "hpp", "swift", "scala",
    "php", "cs", "ex", "exs", "elm", "lua", "sh", "bash", "zsh",
)

_CUT = "\x01"
# Stand for an escaped backslash and an escaped quote.
_BACKSLASHES, _QUOTE = "\x02", "\x03"
_DYNAMIC = r"(?U)(?<!\S)(?:\S*[0-9/\\]\S*|[0-9a-fA-F]{8,})(?!\S)"
_EDGE = r"\A[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+\z"


def message_needle(msg: Column) -> Column:
    """Longest run of static words of a message, trimmed; null when nothing long enough is left."""
    runs = F.transform(
        F.split(F.regexp_replace(msg, _DYNAMIC, _CUT), _CUT),
        lambda r: F.regexp_replace(r, r"(?U)\A\s+|\s+\z", ""),
    )
    best = F.aggregate(
        runs, F.lit(""), lambda acc, r: F.when(F.octet_length(r) > F.octet_length(acc), r).otherwise(acc)
    )
    needle = F.regexp_replace(best, _EDGE, "")
    return F.when(F.octet_length(needle) >= MIN_NEEDLE_BYTES, needle)


def code_lines(files: DataFrame) -> DataFrame:
    """(root, path, line, text) of every line of a file."""
    return files.select("root", "path", F.posexplode(F.split("content", r"\r?\n")).alias("_p", "text")).select(
        "root", "path", (F.col("_p") + 1).cast("bigint").alias("line"), "text"
    )


def _restored(quote: str) -> Callable[[Column], Column]:
    def restored(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(_QUOTE), F.lit("\\" + quote)), F.lit(_BACKSLASHES), F.lit("\\\\"))

    return restored


def string_literals(lines: DataFrame) -> DataFrame:
    """(root, path, line, literal): quoted texts of each line, each quote character on its own.

    Escaped backslashes and quotes are set aside first, so that a literal is a plain run between two quotes and a
    line of any length is read in one pass.
    """
    found = []
    for q in ('"', "'", "`"):
        aside = F.replace(F.replace("text", F.lit("\\\\"), F.lit(_BACKSLASHES)), F.lit("\\" + q), F.lit(_QUOTE))
        runs = F.regexp_extract_all(aside, F.lit(f"{q}([^{q}]*){q}"), F.lit(1))
        found.append(F.transform(runs, _restored(q)))
    return lines.select("root", "path", "line", F.explode(F.array_distinct(F.concat(*found))).alias("literal"))


def searchable(files: DataFrame) -> DataFrame:
    ext = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    return files.filter(
        ext.isin(*EXTENSIONS) & ~in_skipped_folder(F.col("path"))
    )


def emission_sites(events: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, rel_path, line): the first code line whose string literal holds the event's static text.

    Needles are looked up once per distinct text, and equal literals stand for their first place. Needle and literal
    meet on the needle's rarest trigram among the literals; containment is then checked on those few. Only grams that
    are such a trigram become rows with their literal, and no side is broadcast for the size of its files.
    """
    roots = small_side(stage_table(roots.select("source", "root")))
    wanted = events.select("id", "source", message_needle(F.col("msg")).alias("needle")).filter("needle is not null")
    wanted = stage_table(wanted.join(roots, "source").select("id", "root", "needle"))
    needles = stage_table(wanted.select("root", "needle").distinct())
    literals = string_literals(code_lines(searchable(files)))
    literals = literals.filter(F.octet_length("literal") >= MIN_NEEDLE_BYTES)
    literals = stage_table(literals.groupBy("root", "literal").agg(F.min(F.struct("path", "line")).alias("site")))
    held = text_grams(F.col("literal"))
    counts = literals.select(F.explode(held).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    anchors = stage_table(rarest_gram(needles, ["root", "needle"], F.array("needle"), counts))
    keep = gram_filter(anchors)
    if keep is None:
        return wanted.limit(0).select("id", F.lit("").alias("rel_path"), F.lit(0).cast("bigint").alias("line"))
    keyed = literals.select("*", F.explode(keep(held)).alias("gram"))
    sites = stage_table(
        keyed.join(small_side(anchors), ["root", "gram"])
        .filter(F.contains("literal", F.col("needle")))
        .groupBy("root", "needle")
        .agg(F.min("site").alias("_s"))
    )
    return wanted.join(small_side(sites), ["root", "needle"]).select(
        "id", F.col("_s.path").alias("rel_path"), F.col("_s.line").alias("line")
    )


def code_slice(files: DataFrame, path: str, line: int, context: int) -> DataFrame:
    """Lines around a place in a file."""
    near = code_lines(files.filter(F.col("path") == path))
    return near.filter(F.col("line").between(max(line - context, 0), line + context))

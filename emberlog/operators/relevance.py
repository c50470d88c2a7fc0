"""Which log lines come from changed code: diffs, log-call patterns and their matches in events.

Code comes as tables: source files (root, path, content), diff lines (root, seq, line) and which
source runs from which root. Nothing here reads a working tree or runs a version-control tool.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.logcalls import log_calls
from emberlog.functions.values import once
from emberlog.operators.carry import running_max
from emberlog.operators.grams import part_filter, rarest_part
from emberlog.session import materialise_small, small_side, stage_table

# File extensions per language, skipped folders.
LANGUAGES = {
    "ts": "web", "tsx": "web", "js": "web", "jsx": "web", "mjs": "web", "cjs": "web", "rs": "rust", "java": "java",
}
SKIP_FOLDERS = (
    ".git", "node_modules", "target", "dist", "build", "out", "vendor", ".next", ".turbo", ".cache", ".venv", "venv",
    "__pycache__", ".idea", ".vscode",
)
DIFF_CHUNK = 50_000

# Import and re-export statements per language.
WEB_IMPORT = (
    r"""(?m)(?:from\s+["']([^"']+)["']|require\(\s*["']([^"']+)["']|import\(\s*["']([^"']+)["']"""
    r"""|^\s*import\s+["']([^"']+)["'])"""
)
WEB_EXPORT = (
    r"""(?m)^\s*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+["']([^"']+)["']"""
)
RUST_IMPORT = r"(?U)\b(?:use|mod)\s+([\w:]+)"
RUST_IMPORT_GROUP = r"(?U)\b(?:pub(?:\s*\([^)]+\))?\s+)?use\s+([\w:]+)::\{([^}]+)\}"
RUST_EXPORT = r"(?U)\bpub(?:\s*\([^)]+\))?\s+use\s+([\w:]+)"
RUST_EXPORT_GROUP = r"(?U)\bpub(?:\s*\([^)]+\))?\s+use\s+([\w:]+)::\{([^}]+)\}"
JAVA_IMPORT = r"(?U)import\s+(?:static\s+)?([\w.]+)\s*;"


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def in_skipped_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIP_FOLDERS]))


def code_files(files: DataFrame) -> DataFrame:
    """Files in a known language, outside vendor folders."""
    return files.filter(
        language(F.col("path")).isNotNull() & ~in_skipped_folder(F.col("path"))
    )


# ---- diffs -----------------------------------------------------------------------------------


def touched_files(diffs: DataFrame) -> DataFrame:
    """(root, path): distinct new-side paths of a unified diff."""
    header = r"^\+\+\+ [ab]/([\s\S]*)$"
    path = F.regexp_extract("line", header, 1)
    return (
        diffs.filter(F.col("line").rlike(header))
        .select("root", path.alias("path"))
        .filter("path <> '/dev/null'")
        .distinct()
    )


def diff_added_lines(diffs: DataFrame) -> DataFrame:
    """(root, path, line_no, text) of every added line, numbered in the new file.

    Header and hunk of a line are running maxima over its root's diff; only the count inside a hunk
    is a window, and a hunk is part of one file.
    """
    line = F.col("line")
    skip = line.rlike(r"^(--- |diff --git|index |similarity|rename|new file|deleted file|Binary )")
    kind = (
        F.when(line.startswith("+++ "), "file")
        .when(skip, "skip")
        .when(line.startswith("@@"), "hunk")
        .when(line.startswith("+"), "add")
        .when(line.startswith(" "), "keep")
        .otherwise("skip")
    )
    span = F.regexp_extract("line", r"^@@[^+]*\+(\d+)(?:,\d+)?(?: |\z)", 1)
    marked = diffs.withColumn("_kind", kind).withColumn("_start", F.when(span != "", span.cast("bigint")))
    marked = marked.withColumn("_f", F.when(F.col("_kind") == "file", F.col("seq"))).withColumn(
        "_h", F.when((F.col("_kind") == "hunk") & F.col("_start").isNotNull(), F.col("seq"))
    )
    scoped = running_max(marked, "root", "seq", "_f", "_file", DIFF_CHUNK)
    scoped = running_max(scoped, "root", "seq", "_h", "_hunk", DIFF_CHUNK)
    path = F.regexp_extract("line", r"^\+\+\+ [ab]/([\s\S]*)$", 1)
    heads = marked.filter("_f is not null").select(
        "root", F.col("seq").alias("_file"), F.when((path != "") & (path != "/dev/null"), path).alias("path")
    )
    starts = marked.filter("_h is not null").select("root", F.col("seq").alias("_hunk"), F.col("_start").alias("_first"))
    rows = scoped.filter(F.col("_kind").isin("add", "keep")).join(heads.filter("path is not null"), ["root", "_file"])
    earlier = Window.partitionBy("root", "_hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_off", F.coalesce(F.count("*").over(earlier), F.lit(0)))
    return (
        numbered.join(starts, ["root", "_hunk"], "left")
        .filter("_kind = 'add'")
        .select("root", "path", (F.coalesce("_first", F.lit(0)) + F.col("_off")).alias("line_no"),
                F.col("line").substr(F.lit(2), F.char_length("line")).alias("text"))
    )


# ---- calls -----------------------------------------------------------------------------------


def mine_log_calls(files: DataFrame) -> DataFrame:
    """(root, path, line, raw_call, pieces): log calls with static text, file by file."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (root, path, line, call, pieces)
                for root, path, content in zip(batch["root"], batch["path"], batch["content"])
                for line, call, pieces in log_calls(content)
            ]
            yield pd.DataFrame(rows, columns=["root", "path", "line", "raw_call", "pieces"])

    wanted = code_files(files).select("root", "path", "content")
    return wanted.mapInPandas(
        scan, "root string, path string, line bigint, raw_call string, pieces array<string>"
    )


def log_template(calls: DataFrame) -> DataFrame:
    """Add ``regex``: the quoted pieces joined by a lazy gap."""
    quoted = F.transform("pieces", lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|&\-#~])", r"\\$1"))
    return calls.withColumn("regex", F.array_join(quoted, ".*?"))


# ---- modules ---------------------------------------------------------------------------------


def _file_name(path: Column) -> Column:
    clean = F.regexp_replace(path, r"(/\.?)+$", "")
    name = F.substring_index(clean, "/", -1)
    return F.when(~name.isin("..", ".", ""), name)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def _parent_name(path: Column) -> Column:
    return _file_name(F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")))


def _web_id(spec: Column) -> Column:
    stem = _stem(_file_name(spec))
    return F.when(stem == "index", _parent_name(spec)).otherwise(stem)


def _last_segment(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def _plain_rust(content: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), _last_segment)
    return F.filter(found, lambda x: ~x.isin("", "self", "super", "crate"))


def _grouped_rust(content: Column, pattern: str) -> Column:
    pairs = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("base"),
        F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("items"),
    )

    def ids(pair: Column) -> Column:
        owner = _last_segment(pair["base"])

        def one(item: Column) -> Column:
            head = F.regexp_extract(item, r"(?U)\A\s*(\S+)", 1)
            name = F.regexp_replace(_last_segment(head), r"\A[^\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_]+\z", "")
            return F.when(head == "self", F.when(~owner.isin("", "crate", "super"), owner)).when(
                ~name.isin("", "super"), name
            )

        return F.transform(F.split(pair["items"], ","), one)

    return F.array_compact(F.flatten(F.transform(pairs, ids)))


def _ids_of(files: DataFrame, per_language: dict[str, Column], name: str) -> DataFrame:
    found = F.lit(None).cast("array<string>")
    for lang, ids in per_language.items():
        found = F.when(language(F.col("path")) == lang, ids).otherwise(found)
    return (
        code_files(files)
        .select("root", "path", F.explode(F.array_distinct(F.array_compact(found))).alias(name))
    )


def extract_imports(files: DataFrame) -> DataFrame:
    """(root, path, module): ids of the modules each file imports."""
    content = F.col("content")
    web = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(WEB_IMPORT), F.lit(i)) for i in range(1, 5)]))
    web = F.transform(F.filter(web, lambda s: s != ""), _web_id)
    rust = F.concat(_plain_rust(content, RUST_IMPORT), _grouped_rust(content, RUST_IMPORT_GROUP))
    java = F.transform(
        F.regexp_extract_all(content, F.lit(JAVA_IMPORT), F.lit(1)), lambda p: F.substring_index(p, ".", -1)
    )
    java = F.filter(java, lambda x: x != "")
    return _ids_of(files, {"web": web, "rust": rust, "java": java}, "module")


def extract_reexports(files: DataFrame) -> DataFrame:
    """(root, path, module): ids each file hands on to its importers."""
    content = F.col("content")
    web = F.transform(F.regexp_extract_all(content, F.lit(WEB_EXPORT), F.lit(1)), _web_id)
    rust = F.concat(_plain_rust(content, RUST_EXPORT), _grouped_rust(content, RUST_EXPORT_GROUP))
    return _ids_of(files, {"web": web, "rust": rust}, "module")


def module_id(path: Column) -> Column:
    """The id a file is imported as: its stem, or its folder for an index or mod file."""
    stem = _stem(_file_name(path))
    parent = _parent_name(path)
    lang = language(path)
    folder = ((lang == "web") & (stem == "index")) | ((lang == "rust") & (stem == "mod"))
    return F.when(lang.isNotNull(), F.when(folder & parent.isNotNull(), parent).otherwise(stem))


def module_ids(files: DataFrame) -> DataFrame:
    ids = files.select("root", "path", module_id(F.col("path")).alias("module"))
    return ids.filter("module is not null")


def expand_barrels(origins: DataFrame, reexports: DataFrame) -> DataFrame:
    """(root, module, origin) grown through files that re-export a module, until nothing new is reached."""
    key = ["root", "module", "origin"]
    hand_on = reexports.select("root", "module", module_id(F.col("path")).alias("_own")).filter("_own is not null")
    hand_on = small_side(stage_table(hand_on.distinct()))
    grown = fresh = stage_table(origins.select(*key).distinct())
    while True:  # only what the last round reached can reach more
        more = fresh.join(hand_on, ["root", "module"]).select("root", F.col("_own").alias("module"), "origin")
        fresh = stage_table(more.distinct().join(grown.hint("merge"), key, "left_anti"))
        if fresh.isEmpty():
            return grown
        grown = grown.unionByName(fresh)


# ---- patterns and matches --------------------------------------------------------------------


def relevance_patterns(files: DataFrame, diffs: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, rel_path, line, raw_call, pieces, regex, kind, via_files) of changed and importing code.

    Direct patterns are calls in touched files; indirect ones are calls in files that import a
    touched module, straight or through a re-exporting file.
    """
    touched = materialise_small(touched_files(diffs))
    calls = log_template(mine_log_calls(files)).withColumnRenamed("path", "rel_path")
    origins = touched.select("root", module_id(F.col("path")).alias("module"), F.col("path").alias("origin"))
    origins = expand_barrels(origins.filter("module is not null"), extract_reexports(files))
    via = (
        extract_imports(files)
        .join(small_side(origins), ["root", "module"])
        .join(touched, ["root", "path"], "left_anti")
        .groupBy("root", "path")
        .agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("via_files"))
    )
    reach = touched.select("root", F.col("path").alias("rel_path"), F.lit("direct").alias("kind"), F.lit("").alias("via_files"))
    reach = reach.unionByName(
        via.select("root", F.col("path").alias("rel_path"), F.lit("indirect").alias("kind"), "via_files")
    )
    return (
        calls.join(reach, ["root", "rel_path"])
        .join(roots.select("source", "root"), "root")
        .select("source", "rel_path", "line", "raw_call", "pieces", "regex", "kind", "via_files")
    )


def _folded(text: Column) -> Column:
    """Lower case for looking grams up; the long s folds to s like in a caseless match."""
    return F.translate(F.lower(text), "ſ", "s")


def match_relevance(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, source, rel_path, line, raw_call, kind): the pattern each event's text comes from.

    The message counts first, the raw text second. Leftmost match wins, then direct patterns, path
    and line. Texts and patterns meet on (source, rarest word or gram of the pattern), so a pattern is
    tried only on texts that can match, and no pattern set has to fit into one expression. Of patterns with one regex the
    one that wins stands for all. Only texts with such a part are written; one that many events have is tried once.
    """
    named = F.struct(
        F.when(F.col("kind") == "direct", 0).otherwise(1).alias("_k"), "rel_path", "line", "raw_call", "kind"
    )
    patterns = patterns.groupBy("source", "regex", "pieces").agg(F.min(named).alias("_p"))
    patterns = stage_table(patterns.withColumn("_needle", F.monotonically_increasing_id()))
    anchors = rarest_part(patterns, "_needle", F.transform("pieces", _folded))
    anchors = stage_table(anchors.join(patterns.drop("pieces").hint("merge"), "_needle").drop("_needle"))
    held = part_filter(anchors)
    sources = small_side(stage_table(patterns.select("source").distinct()))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("msg").alias("text")), F.struct(F.lit(1).alias("part"), F.col("raw").alias("text")))
    told = (
        events.select("id", "source", F.explode(parts).alias("_t")).select("id", "source", "_t.part", "_t.text")
        .filter("text is not null").join(sources, "source", "left_semi")
    )
    told = once(told, {"_any": F.size(held(_folded(F.col("text")))) > 0}).filter("_any").drop("_any")
    told = stage_table(told.withColumn("text_id", F.unhex(F.md5("text"))))
    texts = stage_table(told.groupBy("source", "text_id").agg(F.first("text").alias("text")))
    probes = texts.select("source", "text_id", F.explode(held(_folded(F.col("text")))).alias("gram"))
    pattern = F.concat(F.lit("(?iud)"), F.col("regex"))
    tried = (
        probes.join(small_side(anchors), ["source", "gram"]).drop("gram")
        .join(texts.hint("merge"), ["source", "text_id"])
        .withColumn("_at", F.regexp_instr("text", pattern)).filter("_at > 0")
    )
    best = tried.groupBy("source", "text_id").agg(F.min(F.struct("_at", "_p")).alias("_b"))
    found = told.select("id", "source", "part", "text_id").join(best.hint("merge"), ["source", "text_id"])
    first = found.groupBy("id", "source").agg(F.min(F.struct("part", "_b")).alias("_f"))
    return first.select("id", "source", *(F.col(f"_f._b._p.{c}").alias(c) for c in ("rel_path", "line", "raw_call", "kind")))


def relevance_ids(matches: DataFrame) -> DataFrame:
    return matches.select("id").orderBy("id")


def relevance_sites(matches: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, rel_path, line, raw_call, kind, emitted_count, snippet) per call site, with its neighbour lines."""
    counts = stage_table(matches.groupBy("source", "rel_path", "line", "raw_call", "kind").agg(F.count("*").alias("emitted_count")))
    emitting = small_side(counts.select("source", "rel_path").distinct())
    code = files.join(roots.select("source", "root"), "root").withColumn("rel_path", F.col("path"))
    code = code.join(emitting, ["source", "rel_path"], "left_semi").select(  # other files aren't split into lines
        "source", "rel_path", F.split("content", r"\r?\n").alias("_lines")
    )
    near = F.slice("_lines", F.greatest(F.col("line") - 1, F.lit(1)).cast("int"),
                   F.when(F.col("line") > 1, 3).otherwise(2))
    return counts.join(code.hint("merge"), ["source", "rel_path"], "left").select(
        "source", "rel_path", "line", "raw_call", "kind", "emitted_count",
        F.coalesce(F.array_join(near, "\n"), F.lit("")).alias("snippet"),
    )


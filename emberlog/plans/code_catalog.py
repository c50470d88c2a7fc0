"""Registered queries about code: diffs, log calls, imports, relevance and emission sites.

The code corpus is derived from ``part``: one file per part (TypeScript, Rust or Java by key), some
re-exporting index files, and a diff that touches one part in fifty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import codesites as S
from emberlog.operators import relevance as R
from emberlog.session import spread
from emberlog.sources.fixtures import log_events, table

ENTRIES: dict = {}


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def source_files(spark: SparkSession, sf: str, chained: bool = False) -> DataFrame:
    """(root, path, content); ``chained`` lets nine of ten hubs re-export the next hub too."""
    k = F.col("p_partkey")
    web = _t("import { step } from './p", k + 3, "';\nimport x from \"./hub", F.floor(k / 10), "/index\";\n"
             "export function run(n) {\n  console.log(`loading widget ${n} from shelf p", k, " ready`);\n  logger.warn('part %d of ", F.col("p_brand"), " low', n);\n}\n")
    rust = _t("use crate::p", k + 3, ";\nuse crate::core::{self, q", k, "::{A}, io};\nfn run(n: u32) {\n    info!(\"crate p", k,
              " stored {} items\", n);\n}\n")
    java = _t("import com.acme.p", k + 3, ";\nimport static com.acme.util.*;\nclass P {\n  void run(int n) {\n    logger.info(\"java job p", k,
              " took \" + n + \" seconds\");\n    log.debug(n);\n  }\n}\n")
    kind = F.when(k % 3 == 0, "rs").when(k % 3 == 1, "java").otherwise("ts")
    content = F.when(k % 3 == 0, rust).when(k % 3 == 1, java).otherwise(web)
    parts = spread(table(spark, sf, "part"))
    files = parts.select(F.lit("/app").alias("root"), _t("src/p", k, ".", kind).alias("path"), content.alias("content"))
    exports = _t("export * from '../p", k + 1, "';\nexport { a, b } from \"../p", k + 2, "\";\n")
    if chained:
        hub = F.floor(k / 10)
        exports = F.concat(exports, F.when(hub % 10 != 9, _t("export * from '../hub", hub + 1, "/index';\n")).otherwise(""))
    hubs = parts.filter(k % 10 == 0).select(
        F.lit("/app").alias("root"), _t("src/hub", F.floor(k / 10), "/index.ts").alias("path"), exports.alias("content"))
    return files.unionByName(hubs)


def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(root, seq, line) of a unified diff over every part."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "rs").when(k % 3 == 1, "java").otherwise("ts")
    name = _t("src/p", k, ".", kind)
    lines = F.array(
        _t("diff --git a/", name, " b/", name), F.lit("index 1..2 100644"), _t("--- a/", name),
        F.when(k % 200 == 51, F.lit("+++ /dev/null")).otherwise(_t("+++ b/", name)),
        _t("@@ -", k, ",2 +", k + 1, ",3 @@ fn"), F.lit(" same"), _t("+added ", k), F.lit("-gone"), F.lit("+"), F.lit(" tail"),
        F.lit("@@ -90 +95 @@"), _t("+late ", k))
    return table(spark, sf, "part").select(k.alias("_k"), F.posexplode(lines).alias("_p", "line")).select(
        F.lit("/app").alias("root"), (F.col("_k") * 100 + F.col("_p")).alias("seq"), "line")


def roots(spark: SparkSession, sf: str) -> DataFrame:
    """Which source runs from the corpus: all but one."""
    sources = table(spark, sf, "events").select(F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("source")).distinct()
    return sources.filter("source <> 'svc-3'").withColumn("root", F.lit("/app"))


def with_code_messages(events: DataFrame, parts: int) -> DataFrame:
    """Log events (batch or streaming) whose messages are those the corpus would print, naming every one of so many parts in turn."""
    part = (F.col("id") - F.floor(F.col("id") / 4)) % parts  # ids divisible by four print no code
    msg = (
        F.when(part % 3 == 0, _t("crate P", part, " stored ", F.col("id"), " items"))
        .when(part % 3 == 1, _t("java job p", part, " took ", F.col("id"), " seconds"))
        .otherwise(_t("loading widget ", F.col("id"), " from shelf p", part, " ready"))
    )
    plain = F.col("id") % 4 == 0
    return events.withColumn("raw", F.when(F.col("id") % 8 == 1, msg).otherwise(F.col("msg"))).withColumn(
        "msg", F.when(plain | (F.col("id") % 8 == 1), F.col("msg")).otherwise(msg)).drop("fields")


def part_count(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "part").count()


def code_events(spark: SparkSession, sf: str) -> DataFrame:
    return with_code_messages(log_events(spark, sf), part_count(spark, sf))


def patterns(spark: SparkSession, sf: str) -> DataFrame:
    return R.relevance_patterns(source_files(spark, sf), diff_lines(spark, sf), roots(spark, sf))


def _add(name: str, run, sql: str | None) -> None:
    ENTRIES[name] = (run, sql)


PARTS = """p AS (SELECT p_partkey AS k, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'rs' WHEN 1 THEN 'java' ELSE 'ts' END AS ext FROM part),
files AS (SELECT k, ext, 'src/p' || k || '.' || ext AS path FROM p),
hubs AS (SELECT k // 10 AS h, k, 'src/hub' || (k // 10) || '/index.ts' AS path FROM p WHERE k % 10 = 0),
touched AS (SELECT k, ext, path FROM files WHERE k % 200 <> 51)"""
CALLS = """calls AS (
  SELECT k, path, 4 AS line, 'console.log(`loading widget ${n} from shelf p' || k || ' ready`)' AS raw_call, 'loading widget.*?from shelf p' || k || ' ready' AS regex FROM files WHERE ext = 'ts'
  UNION ALL SELECT f.k, path, 5, 'logger.warn(''part %d of ' || p_brand || ' low'', n)', 'part.*?of ' || replace(p_brand, '#', '\\#') || ' low' FROM files f JOIN p ON p.k = f.k WHERE f.ext = 'ts'
  UNION ALL SELECT k, path, 4, 'info!("crate p' || k || ' stored {} items", n)', 'crate p' || k || ' stored.*?items' FROM files WHERE ext = 'rs'
  UNION ALL SELECT k, path, 5, 'logger.info("java job p' || k || ' took " + n + " seconds")', 'java job p' || k || ' took.*?seconds' FROM files WHERE ext = 'java')""".replace("\\\\#", "\\#")
_add("touched_files", lambda s, d: R.touched_files(diff_lines(s, d)), "WITH " + PARTS + " SELECT '/app' AS root, path FROM touched")
_add("diff_added_lines", lambda s, d: R.diff_added_lines(diff_lines(s, d)),
     "WITH " + PARTS + """ SELECT '/app' AS root, path, k + 2 AS line_no, 'added ' || k AS text FROM touched
     UNION ALL SELECT '/app', path, k + 3, '' FROM touched UNION ALL SELECT '/app', path, 95, 'late ' || k FROM touched""")
_add("mine_log_calls", lambda s, d: R.mine_log_calls(source_files(s, d)).select("path", "line", "raw_call", F.array_join("pieces", "|").alias("pieces")),
     "WITH " + PARTS + ", " + CALLS + r" SELECT path, line, raw_call, replace(replace(regex, '.*?', '|'), '\#', '#') AS pieces FROM calls")
_add("log_template", lambda s, d: R.log_template(R.mine_log_calls(source_files(s, d))).select("path", "line", "regex"),
     "WITH " + PARTS + ", " + CALLS + " SELECT path, line, regex FROM calls")

# What each statement shape of the corpus imports, read off the language rules by hand.
_add("extract_imports", lambda s, d: R.extract_imports(source_files(s, d)).select("path", "module"),
     "WITH " + PARTS + """ SELECT path, 'p' || (k + 3) AS module FROM files
     UNION SELECT path, 'hub' || (k // 10) FROM files WHERE ext = 'ts'
     UNION SELECT path, unnest(['core', 'A']) FROM files WHERE ext = 'rs'
     UNION SELECT path, unnest(['p' || (k + 1), 'p' || (k + 2)]) FROM hubs""")
_add("extract_reexports", lambda s, d: R.extract_reexports(source_files(s, d)).select("path", "module"),
     "WITH " + PARTS + " SELECT path, unnest(['p' || (k + 1), 'p' || (k + 2)]) AS module FROM hubs")
_add("module_ids", lambda s, d: R.module_ids(source_files(s, d)).select("path", "module"),
     "WITH " + PARTS + " SELECT path, 'p' || k AS module FROM files UNION ALL SELECT path, 'hub' || h FROM hubs")


def _all_origins(s: SparkSession, d: str) -> DataFrame:
    files = source_files(s, d, chained=True)
    return R.expand_barrels(R.module_ids(files).select("root", "module", F.col("path").alias("origin")), R.extract_reexports(files))


_add("expand_barrels", lambda s, d: _all_origins(s, d).select("module", "origin"),
     "WITH RECURSIVE " + PARTS + """, edge AS (SELECT 'hub' || h AS own, unnest(['p' || (k + 1), 'p' || (k + 2)]) AS module FROM hubs
       UNION ALL SELECT 'hub' || h, 'hub' || (h + 1) FROM hubs WHERE h % 10 <> 9),
     grown AS (SELECT 'p' || k AS module, path AS origin FROM files UNION SELECT 'hub' || h, path FROM hubs
       UNION SELECT e.own, g.origin FROM grown g JOIN edge e ON e.module = g.module)
     SELECT module, origin FROM grown""")
REACH = """origin AS (SELECT 'p' || k AS module, path AS origin FROM touched
    UNION SELECT 'hub' || h.h, t.path FROM hubs h JOIN touched t ON t.k IN (h.k + 1, h.k + 2)),
  imported AS (SELECT path, 'p' || (k + 3) AS module FROM files UNION SELECT path, 'hub' || (k // 10) FROM files WHERE ext = 'ts'),
  via AS (SELECT i.path, string_agg(DISTINCT o.origin, ',' ORDER BY o.origin) AS via_files FROM imported i JOIN origin o ON o.module = i.module
    WHERE i.path NOT IN (SELECT path FROM touched) GROUP BY i.path),
  reach AS (SELECT path, 'direct' AS kind, '' AS via_files FROM touched UNION ALL SELECT path, 'indirect', via_files FROM via),
  sources AS (SELECT DISTINCT 'svc-' || (user_id % 4) AS source FROM events WHERE user_id % 4 <> 3),
  patterns AS (SELECT source, c.path AS rel_path, c.line, c.raw_call, c.regex, kind, via_files, c.k FROM calls c JOIN reach r ON r.path = c.path CROSS JOIN sources)"""
EVENTS = """code_log AS (SELECT event_id + 1 AS id, 'svc-' || (user_id % 4) AS source, event_type || ' by user ' || user_id AS plain, (event_id + 1 - (event_id + 1) // 4) % (SELECT count(*) FROM part) AS part FROM events),
  printed AS (SELECT *, CASE part % 3 WHEN 0 THEN 'crate P' || part || ' stored ' || id || ' items' WHEN 1 THEN 'java job p' || part || ' took ' || id || ' seconds'
    ELSE 'loading widget ' || id || ' from shelf p' || part || ' ready' END AS text FROM code_log),
  told AS (SELECT * FROM printed WHERE id % 4 <> 0)"""
HITS = """hits AS (SELECT t.id, t.source, p.rel_path, p.line, p.raw_call, p.kind FROM told t JOIN patterns p ON p.source = t.source AND p.k = t.part
    WHERE p.regex NOT LIKE 'part%')"""
ALL = "WITH " + ", ".join((PARTS, CALLS, REACH, EVENTS, HITS))
_add("relevance_patterns", lambda s, d: patterns(s, d).drop("pieces"),
     "WITH " + ", ".join((PARTS, CALLS, REACH)) + " SELECT source, rel_path, line, raw_call, regex, kind, via_files FROM patterns")


def _matches(s: SparkSession, d: str) -> DataFrame:
    return R.match_relevance(code_events(s, d), patterns(s, d))


def _sites(s: SparkSession, d: str) -> DataFrame:
    return R.relevance_sites(_matches(s, d), source_files(s, d), roots(s, d)).select(
        "source", "rel_path", "line", "raw_call", "kind", "emitted_count", F.size(F.split("snippet", "\n")).cast("bigint").alias("snippet_lines"),
        F.contains("snippet", "raw_call").alias("has_call"))


_add("match_relevance", _matches, ALL + " SELECT * FROM hits")
_add("relevance_ids", lambda s, d: R.relevance_ids(_matches(s, d)), ALL + " SELECT id FROM hits ORDER BY id")
_add("relevance_sites", _sites,
     ALL + " SELECT source, rel_path, line, raw_call, kind, count(*) AS emitted_count, 3 AS snippet_lines, true AS has_call FROM hits GROUP BY ALL")
_add("message_needle", lambda s, d: code_events(s, d).select("id", S.message_needle(F.col("msg")).alias("needle")),
     "WITH " + EVENTS + """ SELECT id, CASE WHEN id % 4 = 0 OR id % 8 = 1 THEN CASE WHEN length(regexp_extract(plain, '^(.*) \\d', 1)) >= 8 THEN regexp_extract(plain, '^(.*) \\d', 1) END
       WHEN part % 3 = 0 THEN NULL WHEN part % 3 = 1 THEN 'java job' ELSE 'loading widget' END AS needle FROM printed""")
_add("emission_sites", lambda s, d: S.emission_sites(code_events(s, d), source_files(s, d), roots(s, d)),
     "WITH " + ", ".join((PARTS, EVENTS)) + """, first AS (SELECT ext, min(path) AS rel_path FROM files GROUP BY ext)
     SELECT id, rel_path, CASE ext WHEN 'ts' THEN 4 ELSE 5 END AS line FROM printed JOIN first ON ext = CASE part % 3 WHEN 1 THEN 'java' WHEN 2 THEN 'ts' END
     WHERE NOT (id % 4 = 0 OR id % 8 = 1) AND source <> 'svc-3'""")
_add("code_slice", lambda s, d: S.code_slice(source_files(s, d), "src/p7.java", 4, 2).select("path", "line", "text"),
     """SELECT 'src/p7.java' AS path, unnest([2, 3, 4, 5, 6]) AS line,
     unnest(['import static com.acme.util.*;', 'class P {', '  void run(int n) {', '    logger.info("java job p7 took " + n + " seconds");', '    log.debug(n);']) AS text FROM part WHERE p_partkey = 7""")

"""Log calls, imports, diffs, relevance and emission sites on a small corpus."""

from pyspark.sql import functions as F

from emberlog.functions.logcalls import log_calls, static_pieces
from emberlog.operators import codesites as S
from emberlog.operators import relevance as R

FILES = {
    "src/auth.ts": 'import x from "./db";\nexport function f(u) {\n  console.log(`user ${u.map((a) => { return a; })} signed in`);\n  log.info("a.b (c)? done");\n}\n',
    "src/page.tsx": "import { f } from './lib';\nconst y = require('./other/index');\nlogger.warn('page render failed after %d tries', n);\n",
    "src/lib/index.ts": 'export * from "../auth";\nexport type { T } from "./kinds";\n',
    "src/far.ts": 'import { z } from "./outer";\nconsole.error("far away message");\n',
    "src/outer.ts": "export { f as g } from './lib';\n",
    "core/net.rs": "use crate::{auth::Login, self};\nuse std::io::{self, Read as R, sub::*};\npub(crate) use crate::model::Row;\nmod helper;\nfn f() { tracing::info!(\"net ready on {}\", p); }\n",
    "app/Main.java": "import com.x.Auth;\nimport static com.x.Util.*;\nclass M { void m() { System.out.println(\"main up: \" + n); } }\n",
    "node_modules/z.ts": 'console.log("user never signed in here");\n',
}
DIFF = """diff --git a/src/auth.ts b/src/auth.ts
--- a/src/auth.ts
+++ b/src/auth.ts
@@ -1,2 +1,3 @@
 import x
+added one
-gone
+added two
@@ -40,2 +41 @@ tail
-only
-deletions
--- a/old.ts
+++ /dev/null
@@ -1 +0,0 @@
-bye""".split("\n")


def tables(spark):
    files = spark.createDataFrame([("/r", p, c) for p, c in FILES.items()], "root string, path string, content string")
    diffs = spark.createDataFrame([("/r", i, x) for i, x in enumerate(DIFF)], "root string, seq bigint, line string")
    roots = spark.createDataFrame([("api", "/r")], "source string, root string")
    return files, diffs, roots


def test_log_calls():
    assert static_pieces('"load {} of %d items\\n", `x ${ {a: "b"} } ok`, \'a\', "é1"') == ["load", "of", "items", "ok", "é1"]
    assert log_calls('x\nconsole.log(fmt("a (b) cd"), (1))') == [(2, 'console.log(fmt("a (b) cd"), (1))', ["a (b) cd"])]
    assert log_calls("logger.info(x)") == [] and log_calls('log.info("open') == []


def test_modules(spark):
    files, _, _ = tables(spark)
    found = {}
    for r in R.extract_imports(files).collect():
        found.setdefault(r["path"], set()).add(r["module"])
    assert found["src/page.tsx"] == {"lib", "other"} and found["app/Main.java"] == {"Auth"}
    assert found["core/net.rs"] == {"Login", "io", "Read", "Row", "helper"}
    assert "node_modules/z.ts" not in found
    again = {(r["path"], r["module"]) for r in R.extract_reexports(files).collect()}
    assert again == {("src/lib/index.ts", "auth"), ("src/lib/index.ts", "kinds"), ("src/outer.ts", "lib"), ("core/net.rs", "Row")}


def test_diff(spark):
    _, diffs, _ = tables(spark)
    assert [r["path"] for r in R.touched_files(diffs).collect()] == ["src/auth.ts"]
    got = sorted((r["line_no"], r["text"]) for r in R.diff_added_lines(diffs).collect())
    assert got == [(2, "added one"), (3, "added two")]


def test_relevance(spark):
    files, diffs, roots = tables(spark)
    patterns = R.relevance_patterns(files, diffs, roots)
    kinds = {(r["rel_path"], r["line"]): (r["kind"], r["via_files"]) for r in patterns.collect()}
    assert kinds == {
        ("src/auth.ts", 3): ("direct", ""), ("src/auth.ts", 4): ("direct", ""),
        ("src/page.tsx", 3): ("indirect", "src/auth.ts"), ("src/far.ts", 2): ("indirect", "src/auth.ts"),
    }
    msgs = ["x USER bob signed in; page render failed after 2 tries", "a.b (c)? done", "aXb (c)? done", "nothing", "far away message"]
    events = spark.createDataFrame(
        [(i, "api", m, m) for i, m in enumerate(msgs)] + [(90, "other", msgs[0], msgs[0]), (91, "api", "nothing", "raw far away message")],
        "id bigint, source string, msg string, raw string",
    )
    matched = R.match_relevance(events, patterns)
    assert {r["id"]: (r["rel_path"], r["line"]) for r in matched.collect()} == {
        0: ("src/auth.ts", 3), 1: ("src/auth.ts", 4), 4: ("src/far.ts", 2), 91: ("src/far.ts", 2)
    }
    sites = {(r["rel_path"], r["line"]): (r["emitted_count"], r["snippet"]) for r in R.relevance_sites(matched, files, roots).collect()}
    assert sites["src/far.ts", 2] == (2, 'import { z } from "./outer";\nconsole.error("far away message");\n')


def test_emission_sites(spark):
    files, _, roots = tables(spark)
    events = spark.createDataFrame(
        [(1, "api", "far away message 12"), (2, "api", "42 signed in /x deadbeef01"), (3, "api", "short 1"), (4, "api", "Page render failed")],
        "id bigint, source string, msg string",
    )
    needles = {r["id"]: r["n"] for r in events.select("id", S.message_needle(F.col("msg")).alias("n")).collect()}
    assert needles == {1: "far away message", 2: "signed in", 3: None, 4: "Page render failed"}
    got = {r["id"]: (r["rel_path"], r["line"]) for r in S.emission_sites(events, files, roots).collect()}
    assert got == {1: ("src/far.ts", 2), 2: ("src/auth.ts", 3)}
    assert S.code_slice(files, "src/far.ts", 1, 99).count() == 3

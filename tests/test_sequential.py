"""Parallel grouping against one-line-at-a-time models, on random input, with chunk borders everywhere."""

import random
import time

from pyspark.sql import functions as F

from emberlog.operators import percentiles
from emberlog.operators.alerts import alert_fires, fire_state
from emberlog.operators.coalesce import coalesce_events
from emberlog.operators.multiline import join_multiline_json, with_summaries
from emberlog.operators.ordering import assign_event_ids


MARK = {"{": 1, "[": 1, "}": -1, "]": -1}


def scan_brackets(line, depth, in_string, escape):
    """Model: bracket depth after a line, and whether a string, or an escape in it, runs on."""
    it = iter(line[1:] if escape else line)
    for ch in it:
        if in_string and ch == "\\":
            escape = next(it, None) is None
            if escape:
                return depth, True, True
        elif ch == '"':
            in_string = not in_string
        elif not in_string:
            depth += MARK.get(ch, 0)
    return depth, in_string, False


def model_join(lines, max_lines, max_bytes, idle):
    out, buf, state, before = [], [], (0, False, False), None

    def flush():
        if buf:
            out.append("\n".join(buf))
            buf.clear()

    for at, line in lines:
        if before is not None and at - before > idle:
            flush()
        before = at
        if not line.strip():
            continue
        if not buf:
            state = scan_brackets(line, 0, False, False)
            if line.lstrip()[:1] not in ("{", "[") or (state[0] <= 0 and not state[1]):
                out.append(line)
                continue
            buf.append(line)
            continue
        buf.append(line)
        state = scan_brackets(line, *state)
        if state[0] <= 0 and not state[1]:
            flush()
        elif len(buf) >= max_lines or len("\n".join(buf).encode()) >= max_bytes:
            out.extend(buf)
            buf.clear()
    flush()
    return out


def test_join_multiline_json(spark):
    rng = random.Random(7)
    pieces = ["{", "}", "[", "]", '"a', 'b"', '{"k": 1}', "plain", "  ", '{"s": "x\\', '"} {', 'é{"']
    data, want = [], {}
    for s in ("hot", "b", "c"):
        at, rows = 0, []
        for i in range(400 if s == "hot" else 60):
            at += rng.choice([0, 1, 200])
            # blank lines do not reach the joiner, so they cannot hold a pause open either
            rows.append((at, " ".join(rng.choices(pieces, k=rng.randint(1, 3)))))
        kept = [(t, x) for t, x in rows if x.strip()]
        want[s] = model_join(kept, 5, 60, 150)
        data += [(s, i, t, x) for i, (t, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "source string, seq bigint, arrival_ms bigint, line string")
    got = join_multiline_json(df, 150, max_lines=5, max_bytes=60, chunk_lines=7)
    for s in want:
        rows = [r["line"] for r in got.filter(F.col("source") == s).orderBy("seq").collect()]
        assert rows == want[s], s


def test_caps_of_the_joiner(spark):
    lines = [("s", i, "{" if i == 0 else f"line {i}") for i in range(501)]
    df = spark.createDataFrame(lines, "source string, seq bigint, line string")
    assert join_multiline_json(df).count() == 501
    big = [("s", 0, "{"), ("s", 1, "x" * 300_000), ("s", 2, "}")]
    assert join_multiline_json(spark.createDataFrame(big, "source string, seq bigint, line string")).count() == 3
    exact = [("s", i, "{" if i == 0 else "}" if i == 499 else "x") for i in range(500)]
    assert join_multiline_json(spark.createDataFrame(exact, "source string, seq bigint, line string")).count() == 1


def test_summaries_of_lines(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices('{}[]"\\aé😀', k=rng.randint(1, 12))) for _ in range(2000)] + ['"' + '\\"' * 100_000, "[" * 200_000]
    rows = with_summaries(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    for r in rows:
        for place in range(3):
            depth, inside, escape = scan_brackets(r["line"], 0, place > 0, place == 2)
            assert r[f"does_{place}"] == 4 * depth + inside + escape, (r["line"][:40], place)


def test_thousands_of_open_brackets(spark):
    df = spark.createDataFrame([("s", i, "{") for i in range(4000)], "source string, seq bigint, line string")
    join_multiline_json(df.limit(10)).count()  # warm
    begun = time.time()
    assert join_multiline_json(df).count() == 4000
    assert time.time() - begun < 20


RANK = {"error": 4, "warn": 3, "info": 2, "debug": 1, "trace": 0}


def model_coalesce(lines, max_lines, max_bytes, idle):
    groups, pending, before = [], None, None
    for seq, at, level, msg in lines:
        gap = before is not None and at - before > idle
        before = at
        cont = msg.startswith(" ")
        follows = pending is not None and not gap and (cont or (level == "error" and pending["level"] == "error"))
        if follows and len(pending["raw"].encode()) + 1 + len(msg.encode()) <= max_bytes and pending["n"] + 1 <= max_lines:
            pending["raw"] += "\n" + msg
            pending["n"] += 1
            pending["level"] = max(pending["level"], level, key=RANK.get)
            continue
        pending = {"seq": seq, "level": level, "raw": msg, "n": 1}
        groups.append(pending)
    return [(g["seq"], g["level"], g["raw"], g["n"]) for g in groups]


def test_coalesce_events(spark):
    rng = random.Random(11)
    data, want = [], {}
    for s in ("hot", "errors", "c", "d"):
        at, rows = 0, []
        for i in range(500 if s == "hot" else 120):
            at += rng.choice([0, 0, 1, 1, 200])
            level = "error" if s == "errors" else rng.choice(["error", "error", "info", "warn", "trace"])
            rows.append((i * 3, at, level, rng.choice(["", " "]) + "m" * rng.randint(1, 9) + rng.choice(["", "é"])))
        want[s] = model_coalesce(rows, 6, 40, 150)
        data += [(s, *r) for r in rows]
    df = spark.createDataFrame(data, "source string, seq bigint, arrival_ms bigint, level string, msg string").withColumn("raw", F.col("msg"))
    df = df.withColumn("fields", F.lit(None).cast("variant"))
    got = coalesce_events(df, 150, max_lines=6, max_bytes=40, chunk_lines=8)
    for s in want:
        rows = got.filter(F.col("source") == s).orderBy("seq").select("seq", "level", "raw", "lines").collect()
        assert [tuple(r) for r in rows] == want[s], s


def model_fires(matches, rules, state=None):
    last = {r["id"]: (state or {}).get(r["id"], (-(10**15), 0))[0] for r in rules}
    waiting = {r["id"]: (state or {}).get(r["id"], (0, 0))[1] for r in rules}
    anything, out = max(last.values()), []
    for id_, ts, ids in matches:
        for a in ids:
            gap = max(next(r["debounce_ms"] for r in rules if r["id"] == a), 5000)
            if ts - last[a] < gap or ts - anything < 5000:
                waiting[a] += 1
                continue
            out.append((id_, a, ts, waiting[a]))
            last[a] = anything = ts
            waiting[a] = 0
    return out


def test_alert_fires(spark):
    rng = random.Random(3)
    rules = [{"id": "a", "notify": True, "debounce_ms": 0}, {"id": "b", "notify": True, "debounce_ms": 20_000}, {"id": "c", "notify": True, "debounce_ms": 60_000}]
    ts, matches = 0, []
    for i in range(1, 400):
        ts += rng.choice([-3000, 0, 0, 500, 4000, 9000])
        matches.append((i, ts, sorted(rng.sample(["a", "b", "c"], rng.randint(1, 3)))))
    df = spark.createDataFrame([(i, t, "m", "r", ids) for i, t, ids in matches], "id bigint, ts bigint, msg string, raw string, alert_ids array<string>")
    got = alert_fires(df, rules, chunk_ids=17).orderBy("id", "alert_id").select("id", "alert_id", "ts", "suppressed")
    assert [tuple(r) for r in got.collect()] == sorted(model_fires(matches, rules))
    # the same in two runs with the state carried over
    first = df.filter("id <= 150")
    fired = alert_fires(first, rules, chunk_ids=40)
    state = fire_state(first, fired, rules)
    rest = alert_fires(df.filter("id > 150"), rules, chunk_ids=40, state=state)
    both = [tuple(r) for r in fired.union(rest).select("id", "alert_id", "ts", "suppressed").collect()]
    assert sorted(both) == sorted(model_fires(matches, rules))


def test_alert_fires_needs_few_jobs(spark):
    """One pass over a thousand chunks: quiet gaps settle what a chunk ends with."""
    rng = random.Random(11)
    rules = [{"id": "a", "notify": True, "debounce_ms": 0}, {"id": "b", "notify": True, "debounce_ms": 20_000}]
    ts, matches = 0, []
    for i in range(4000):
        ts += rng.choice([-2000, 100, 4000, 9000, 16_000, 40_000])
        matches.append((i, ts, sorted(rng.sample(["a", "b"], rng.randint(1, 2)))))
    schema = "id bigint, ts bigint, msg string, raw string, alert_ids array<string>"
    df = spark.createDataFrame([(i, t, "m", "r", ids) for i, t, ids in matches], schema)
    jobs = {}
    for chunk in (400, 4):
        spark.sparkContext.setJobGroup(f"fires-{chunk}", "")
        got = alert_fires(df, rules, chunk_ids=chunk).select("id", "alert_id", "ts", "suppressed").collect()
        jobs[chunk] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fires-{chunk}"))
        assert sorted(tuple(r) for r in got) == sorted(model_fires(matches, rules))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[4] <= jobs[400] + 20


def test_exact_percentiles(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "SMALL_BRACKET", 3)
    monkeypatch.setattr(percentiles, "LINEAR_BINS", 8)
    rng = random.Random(5)
    groups = {
        "skewed": [rng.lognormvariate(0, 9) for _ in range(300)] + [1e-300, -5.0], "same": [7.0] * 50,
        "mixed": [rng.uniform(-1, 1) for _ in range(99)] + [0.0] * 40, "one": [3.5], "far": [-1e300, 1e300, float("inf"), 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    percents = [0, 12.5, 50, 90, 99, 100]
    got = {(r["k"], r["p"]): (r["n"], r["value"]) for r in percentiles.exact_percentiles(df, ["k"], percents).collect()}
    for k, vs in groups.items():
        s = sorted(vs)
        for p in percents:
            assert got[k, float(p)] == (len(s), s[min(len(s) - 1, max(0, int(p / 100 * len(s))))]), (k, p)
    alone = percentiles.exact_percentiles(df.filter("k = 'mixed'").select("v"), [], [50]).collect()
    assert alone[0]["value"] == sorted(groups["mixed"])[int(len(groups["mixed"]) * 0.5)]


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("arrival_ms"), F.lit("s").alias("source"), F.col("id").alias("seq"))
    rows = assign_event_ids(df).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 1001))
    assert [(r["arrival_ms"], r["seq"]) for r in rows] == sorted((r["arrival_ms"], r["seq"]) for r in rows)

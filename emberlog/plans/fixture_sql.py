"""The derived views of :mod:`emberlog.sources.fixtures`, as SQL over the same tables."""

LOG_EVENTS = r"""
log_parts AS (
  SELECT *, event_id + 1 AS id, epoch_us(ts) // 1000 AS ms,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
),
log_texts AS (
  SELECT *,
    CASE WHEN event_id % 17 = 0 THEN 'null' WHEN event_id % 13 = 0 THEN '"' || (k * 10) || '"' ELSE '' || (k * 10) END AS dur,
    CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 304 WHEN 3 THEN 404 ELSE 500 END AS status_code,
    CASE WHEN event_id % 7 <> 0 THEN 'req_' || (event_id // 3) END AS request_id,
    CASE WHEN event_type = 'error' THEN '["at run (src/app' || (user_id % 5) || '.ts:' || (k + 1) || ':7)","at src/main.ts:3"]' END AS stack
  FROM log_parts
),
log_events AS (
  SELECT id, ms AS ts, 'svc-' || (user_id % 4) AS source,
    CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'main' ELSE 'feature/x' END AS branch,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'trace' END AS level,
    event_type || ' by user ' || user_id AS msg,
    CASE WHEN event_id % 11 <> 0 THEN
      '{"event_type":"' || event_type || '","user":{"id":' || user_id || '},"k":' || k || ',"value":' || CAST(value AS VARCHAR)
      || ',"status_code":' || status_code || ',"path":"/api/p' || (user_id % 7) || '"'
      || CASE WHEN request_id IS NOT NULL THEN ',"request_id":"' || request_id || '"' ELSE '' END
      || ',"dur_ms":' || dur || ',"tags":["t' || (k % 3) || '","z"],"created_at":' || ms
      || CASE WHEN stack IS NOT NULL THEN ',"stack":' || stack ELSE '' END || '}'
    END AS fields,
    CASE WHEN event_id % 11 <> 0 THEN CASE WHEN dur = 'null' THEN 0.0 ELSE CAST(trim(dur, '"') AS DOUBLE) END END AS dur_number,
    CASE WHEN event_id % 11 <> 0 AND dur <> 'null' THEN CAST(trim(dur, '"') AS DOUBLE) END AS dur_strict,
    event_id, event_type, user_id, k, value, status_code, dur, stack,
    CASE WHEN event_id % 11 <> 0 THEN request_id END AS request_id,
    CASE WHEN event_id % 11 <> 0 THEN '/api/p' || (user_id % 7) END AS path
  FROM log_texts
),
log_raw AS (SELECT *, coalesce(fields, msg) AS raw FROM log_events)
"""

# payload parts in key order, the way a stored VARIANT prints
SORTED_PARTS = r"""
sorted_parts AS (
  SELECT *,
    '"created_at":' || ts || ',"dur_ms":' || dur || ',"event_type":"' || event_type || '","k":' || k AS p1,
    '"path":"' || path || '"' || CASE WHEN request_id IS NOT NULL THEN ',"request_id":"' || request_id || '"' ELSE '' END AS p2,
    CASE WHEN stack IS NOT NULL THEN '"stack":' || stack || ',' ELSE '' END || '"status_code":' || status_code
      || ',"tags":["t' || (k % 3) || '","z"]' AS p3,
    '"user":{"id":' || user_id || '},"value":' || regexp_replace(CAST(value AS VARCHAR), '\.0$', '') AS p4
  FROM log_raw
)
"""

RAW_LINES = r"""
line_parts AS (
  SELECT event_id AS e, user_id AS u, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) // 1000 AS ms, event_type || ' by user ' || user_id AS msg,
         strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S') AS clock
  FROM events
),
line_lists AS (
  SELECT *, CASE e % 20
    WHEN 0 THEN ['{"level":"warn","msg":"' || msg || '","k":' || k || '}']
    WHEN 1 THEN ['[be] {"level":"error","msg":"' || msg || '","k":' || k || '}']
    WHEN 2 THEN ['{"level":"info","msg":"{\"level\":\"debug\",\"msg\":\"inner ' || kind || '\",\"pid\":' || u || '}","host":"h1"}']
    WHEN 3 THEN ['{"host":"h2","body":"{\"msg\":\"body ' || kind || ' failed\",\"reqId\":' || k || '}"}']
    WHEN 4 THEN ['{"level":' || ((k % 6 + 1) * 10) || ',"time":' || ms || ',"msg":"' || msg || '"}']
    WHEN 5 THEN ['{"msg":"' || msg || ' crashed","k":' || k || '}']
    WHEN 6 THEN ['{', '  "level": "' || kind || '",', '  "msg": "pretty ' || kind || ' {", ', '  "k": ' || k, '}']
    WHEN 7 THEN ['W0102 03:04:05.678 ' || u || ' main.go:' || k || '] klog ' || kind]
    WHEN 8 THEN [clock || ',123 ERROR [worker-' || (k % 4) || '] com.acme.Svc' || (k % 5) || ' - java ' || kind]
    WHEN 9 THEN [clock || ',123 - app.mod' || (k % 3) || ' - WARNING - py ' || kind]
    WHEN 10 THEN ['[2024-01-01T00:00:00Z DEBUG crate::m' || (k % 3) || '] env ' || kind]
    WHEN 11 THEN ['<34>Jan 12 06:30:00 host' || (u % 4) || ' cron[' || k || ']: sys ' || kind]
    WHEN 12 THEN ['2024-01-01T00:00:00.1Z stderr F cri ' || kind]
    WHEN 13 THEN ['@acme/web:dev: turbo ' || kind || ' ' || k]
    WHEN 14 THEN [chr(27) || '[33m' || kind || chr(27) || '[0m coloured ' || k]
    WHEN 15 THEN ['ERROR: prefixed ' || kind || ' ' || k]
    WHEN 16 THEN ['TypeError: bad ' || kind, '    at run (app.js:10:5)', '    at main (app.js:20:1)', '  at tail']
    WHEN 17 THEN ['error: first ' || kind, 'error: second ' || k]
    WHEN 18 THEN ['done ' || kind || ' {"k":' || k || ',"user":{"id":' || u || '}}']
    ELSE ['plain prose about ' || kind, '   ']
  END AS parts
  FROM line_parts
),
raw_lines AS (
  SELECT 'svc-' || (u % 4) AS source, CASE u % 3 WHEN 0 THEN '' WHEN 1 THEN 'main' ELSE 'feature/x' END AS branch,
         e * 10 + pos - 1 AS seq, ms AS arrival_ms, line, e
  FROM (SELECT e, u, ms, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM line_lists)
)
"""

# one row per record: pretty-printed objects joined, blank lines gone
JOINED_LINES = r"""
joined_lines AS (
  SELECT source, branch, min(seq) AS seq, arrival_ms, string_agg(line, chr(10) ORDER BY seq) AS line
  FROM (SELECT *, CASE WHEN e % 20 = 6 THEN -e ELSE seq END AS grp FROM raw_lines WHERE regexp_matches(line, '\S'))
  GROUP BY source, branch, arrival_ms, grp
)
"""


def level_words(text: str) -> str:
    """Keyword level of an SQL text expression, or NULL."""
    from emberlog.functions.levels import LEVEL_KEYWORDS

    edge = r"[^A-Za-z0-9_./\\-]"
    whens = " ".join(
        f"WHEN regexp_matches({text}, '(?i)(?:^|{edge})(?:{words})(?:{edge}|$)') THEN '{level}'"
        for level, words in LEVEL_KEYWORDS.items()
    )
    return f"CASE {whens} END"


def level_name(text: str) -> str:
    from emberlog.functions.levels import LINE_LEVEL_NAMES

    whens = " ".join(
        f"WHEN lower({text}) IN ({', '.join(repr(n) for n in names)}) THEN '{level}'"
        for level, names in LINE_LEVEL_NAMES.items()
    )
    return f"CASE {whens} WHEN regexp_matches({text}, '^[+-]?\\d+$') THEN {level_number(f'CAST({text} AS BIGINT)')} ELSE 'info' END"


def level_number(number: str) -> str:
    return (
        f"CASE WHEN {number} <= 15 THEN 'trace' WHEN {number} <= 25 THEN 'debug' WHEN {number} <= 35 THEN 'info' "
        f"WHEN {number} <= 45 THEN 'warn' ELSE 'error' END"
    )


PLAIN_TEXT = r"regexp_replace(line, '\x1B(\[[^\x40-\x7E]*([\x40-\x7E]|$)|[^\[]|$)', '', 'g')"


def parsed(lines: str) -> str:
    """CTEs that parse the lines of a table (source, branch, seq, arrival_ms, line) into ``parsed``."""
    keys = ["level", "lvl", "severity", "severity_text", "levelname", "loglevel", "log_level"]
    whole = "CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'OBJECT' THEN line END END"
    rest = r"regexp_extract(line, '(?s)^\s*\[([^\]]*)\]\s*(\{.*)$', 2)"
    tag = r"trim(regexp_extract(line, '(?s)^\s*\[([^\]]*)\]\s*(\{.*)$', 1))"
    inner = " ".join(
        f"WHEN json_type(obj0, '$.{k}') = 'VARCHAR' AND json_valid(json_extract_string(obj0, '$.{k}')) "
        f"AND left(json_extract_string(obj0, '$.{k}'), 1) = '{{' THEN json_extract_string(obj0, '$.{k}')"
        for k in ("msg", "message", "body")
    )
    level = "coalesce(" + ", ".join(f"json_extract(obj, '$.{k}')" for k in keys) + ")"
    explicit = (
        f"CASE WHEN json_type(lv) = 'VARCHAR' THEN {level_name(chr(40) + 'lv ->> ' + chr(39) + '$' + chr(39) + chr(41))} "
        f"WHEN json_type(lv) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {level_number('CAST(lv AS DOUBLE)')} END"
    )
    return rf"""
p0 AS (SELECT *, {whole} AS w, CASE WHEN {tag} <> '' AND json_valid({rest}) THEN {rest} END AS b, {tag} AS btag FROM {lines}),
p1 AS (SELECT *, coalesce(w, b) AS obj0, CASE WHEN w IS NULL AND b IS NOT NULL THEN btag END AS tag FROM p0),
p2 AS (SELECT *, CASE {inner} END AS inner_obj FROM p1),
p3 AS (SELECT *, CASE WHEN inner_obj IS NULL THEN CAST(obj0 AS JSON) ELSE json_merge_patch(obj0, inner_obj) END AS obj4 FROM p2),
p4 AS (SELECT *, CASE WHEN tag IS NULL THEN obj4 ELSE json_merge_patch(json_object('tag', tag), obj4) END AS obj FROM p3),
p5 AS (SELECT *, {level} AS lv, {PLAIN_TEXT} AS plain,
       CASE WHEN obj IS NOT NULL THEN CASE WHEN json_type(coalesce(obj -> '$.msg', obj -> '$.message')) = 'VARCHAR'
            THEN coalesce(obj -> '$.msg', obj -> '$.message') ->> '$' ELSE '' END END AS jmsg FROM p4),
p6 AS (SELECT *, {explicit} AS named, {level_words("CASE WHEN obj IS NOT NULL THEN jmsg ELSE plain END")} AS words FROM p5),
parsed AS (
  SELECT source, branch, seq, arrival_ms, line AS raw, obj AS fields,
    CASE WHEN obj IS NOT NULL THEN jmsg ELSE regexp_replace(split_part(plain, chr(10), 1), '\r+$', '') END AS msg,
    CASE WHEN obj IS NOT NULL THEN CASE WHEN named <> 'info' THEN named ELSE coalesce(words, 'info') END
         ELSE coalesce(words, CASE WHEN regexp_matches(line, '\x1B\[(\d+;)*(31|91)(;\d+)*m') THEN 'error'
              WHEN regexp_matches(line, '\x1B\[(\d+;)*(33|93)(;\d+)*m') THEN 'warn' END, 'info') END AS level
  FROM p6)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


def _plain(pattern: str) -> str:
    from emberlog.functions.dialect import plain_groups

    return plain_groups(pattern).replace("'", "''")


def body_sql(text: str) -> str:
    """First captured rule body of a text."""
    from emberlog.functions.dialect import group_numbers
    from emberlog.functions.rule_table import BUILTIN_RULES

    whens = []
    for rule in sorted(BUILTIN_RULES, key=lambda r: r["order"]):
        n = group_numbers(rule["pattern"])["body"]
        p = _plain(rule["pattern"])
        whens.append(f"WHEN regexp_matches({text}, '{p}') THEN regexp_extract({text}, '{p}', {n})")
    return f"CASE {' '.join(whens)} ELSE {text} END"


def frame_sql(text: str) -> str:
    from emberlog.functions.rule_table import FRAME_SHAPES

    return "(" + " OR ".join(f"regexp_matches({text}, '{_plain(p)}')" for p in FRAME_SHAPES) + ")"


def rules_ctes(start: str) -> str:
    """CTEs that apply every built-in rule in order to ``start``; the last one is ``ruled``."""
    import re

    from emberlog.functions.dialect import group_numbers
    from emberlog.functions.levels import RULE_LEVEL_NAMES
    from emberlog.functions.rule_table import BUILTIN_RULES

    out, before = [], start
    rules = sorted(BUILTIN_RULES, key=lambda r: r["order"])
    out.append(f"r0 AS (SELECT *, false AS hit_any FROM {start})")
    before = "r0"
    for i, rule in enumerate(rules, 1):
        groups, p = group_numbers(rule["pattern"]), _plain(rule["pattern"])

        def fill(template: str, groups=groups, p=p) -> str:
            m = re.fullmatch(r"\$\{(\w+)\}", template)
            return f"regexp_extract(msg, '{p}', {groups[m.group(1)]})" if m else f"'{template}'"

        o = rule["output"]
        sets = {"hit_any": "hit_any OR hit"}
        for c in ("source", "msg"):
            if c in o:
                sets[c] = f"CASE WHEN hit AND {fill(o[c])} <> '' THEN {fill(o[c])} ELSE {c} END"
        if "level" in o:
            names = " ".join(
                f"WHEN lower({fill(o['level'])}) IN ({', '.join(repr(n) for n in ns)}) THEN '{lv}'"
                for lv, ns in RULE_LEVEL_NAMES.items()
            )
            sets["level"] = f"CASE WHEN hit THEN coalesce(CASE {names} END, level) ELSE level END"
        if "fields" in o:
            pairs = ", ".join(f"'{k}', {fill(t)}" for k, t in o["fields"].items())
            sets["fields"] = f"CASE WHEN hit THEN json_merge_patch(coalesce(fields, '{{}}'), json_object({pairs})) ELSE fields END"
        if "merge_fields" in o:
            j = fill(o["merge_fields"])
            sets["fields"] = (
                f"CASE WHEN hit AND json_valid({j}) THEN json_merge_patch(coalesce(fields, '{{}}'), {j}) "
                f"WHEN hit THEN coalesce(fields, '{{}}') ELSE fields END"
            )
        replaced = ", ".join(f"{v} AS {k}" for k, v in sets.items())
        out.append(f"m{i} AS (SELECT *, regexp_matches(msg, '{p}') AS hit FROM {before})")
        out.append(f"r{i} AS (SELECT * EXCLUDE (hit) REPLACE ({replaced}) FROM m{i})")
        before = f"r{i}"
    out.append(f"ruled AS (SELECT * FROM {before})")
    return ",\n".join(out)

"""The manifest as SQL: one CTE per level of the trees, and the crc32 of a decimal id by its polynomial."""

from __future__ import annotations

#: Levels written out: sources of up to 16**6 rows, up to 16**4 sources.
SOURCE_LEVELS, ROOT_LEVELS = 6, 4

CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split({id}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
        lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields
    ) + ")"


def _levels(name: str, levels: int) -> list[str]:
    """CTEs of runs (``{name}_run_k``) and nodes (``{name}_k``) above the leaves ``{name}_0`` (tree, i, d, n)."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_run_{k} AS (
    SELECT tree, i // 16 AS r, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {name}_{k} WHERE n > 1 GROUP BY ALL)""")
        out.append(f"""{name}_{k + 1} AS (
    SELECT tree, r AS i, sha256(array_to_string(ds, '')) AS d, (n + 15) // 16 AS n FROM {name}_run_{k})""")
    return out


def _climb(name: str, tree: str, source: str, index: str, levels: int) -> list[str]:
    """CTEs that fold ``folded`` and gather ``proof`` of ``source`` from its place ``index`` level by level."""
    out, last = [], source
    for k in range(levels):
        own = f"(({index} >> {4 * k}) % 16)"
        before, after = (f"coalesce(array_to_string(list_slice(ds, {a}), ''), '')" for a in (f"1, {own}", f"{own} + 2, 16"))
        out.append(f"""{name}_up_{k + 1} AS (
    SELECT x.* REPLACE (
        CASE WHEN ds IS NULL THEN folded ELSE sha256({before} || folded || {after}) END AS folded,
        CASE WHEN ds IS NULL THEN proof ELSE proof || {before} || {after} END AS proof)
    FROM {last} x LEFT JOIN {name}_run_{k} y ON y.tree = x.{tree} AND y.r = ({index} >> {4 * (k + 1)}))""")
        last = f"{name}_up_{k + 1}"
    return out


def manifest_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tops = " UNION ALL ".join(f"SELECT tree, d FROM t_{k} WHERE n = 1" for k in range(SOURCE_LEVELS + 1))
    roots = " UNION ALL ".join(f"SELECT d FROM s_{k} WHERE n = 1" for k in range(ROOT_LEVELS + 1))
    parts = [
        f"""docs AS (
    SELECT *, coalesce('s' || source, '') AS tree, {_leaf('text')} AS leaf,
        CASE WHEN {CRC32.format(id='doc_id')} % 5 = 0 THEN {_leaf(f"translate(text, '{upper}', '{lower}')")} END AS tampered
    FROM documents)""",
        """rows AS (
    SELECT doc_id, tree, leaf, coalesce(tampered, leaf) AS folded, '' AS proof,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
    FROM docs)""",
        "t_0 AS (SELECT tree, i, leaf AS d, n FROM rows)",
        *_levels("t", SOURCE_LEVELS),
        f"subroots AS ({tops})",
        """s_0 AS (
    SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, d, count(*) OVER () AS n, tree AS source FROM subroots)""",
        *_levels("s", ROOT_LEVELS),
        f"root AS ({roots})",
        *_climb("t", "tree", "rows", "i", SOURCE_LEVELS),
        f"""sourced AS (
    SELECT x.doc_id, x.leaf, x.folded, x.proof, s.d AS subroot, s.i AS si, '' AS head
    FROM t_up_{SOURCE_LEVELS} x JOIN s_0 s ON s.source = x.tree)""",
        *_climb("s", "head", "sourced", "si", ROOT_LEVELS),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified
FROM s_up_{ROOT_LEVELS}, root"""

"""DuckDB SQL of the spelling and manifest queries, put together from parts.

CRC-32 is computed in SQL from a table made by rule.
"""

from __future__ import annotations

CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an SQL string; needs ``crc`` in FROM."""
    codes = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)"


def spelling(least: int = 7, least_n: int = 2, times: int = 10, spoil: int = 31) -> str:
    return rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM d WHERE length(run) >= {least} GROUP BY ALL),
c AS (SELECT r.*, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crc),
w AS (SELECT CASE WHEN h % {spoil} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM c GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= {least} AND n >= {least_n}),
hole AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pat FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
gap AS (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 1) AS pat FROM (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM hole a JOIN hole b USING (pat) WHERE a.word <> b.word
         UNION SELECT hole.word, gap.word FROM hole JOIN gap USING (pat)
         UNION SELECT gap.word, hole.word FROM hole JOIN gap USING (pat)),
b AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM near JOIN v ON v.word = other GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {times} * n THEN best END AS form, CASE WHEN best_n >= {times} * n THEN best_n END::BIGINT AS form_n FROM v LEFT JOIN b USING (word)),
up AS (SELECT word, word AS ends FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.ends WHERE f.form IS NOT NULL)
SELECT f.word, form, ends AS root, n, n_near, form_n FROM f JOIN up USING (word) WHERE ends NOT IN (SELECT word FROM f WHERE form IS NOT NULL)"""


def manifest(lower: int = 6, upper: int = 2) -> str:
    """Trees of up to 8 ** ``lower`` leaves a language and 8 ** ``upper`` languages."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    fields = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    tampered = f"CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    parts = [
        f"z AS (SELECT documents.*, {tampered} AS bad FROM documents, crc)",
        f"y AS (SELECT row_number() OVER () AS r, doc_id, lang AS g, {fields('text')} AS leaf, {fields('bad')} AS forged FROM z)",
        "n0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM y)",
    ]

    def level(name: str, above: str) -> list[str]:
        run = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        return [
            f"s{name} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{name})",
            f"n{above} AS (SELECT g, i // 8 AS i, CASE WHEN bool_or(more) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM s{name} GROUP BY g, i // 8)",
        ]

    for k in range(lower):
        parts += level(str(k), str(k + 1))
    parts.append(f"nt0 AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n{lower})")
    for k in range(upper):
        parts += level(f"t{k}", f"t{k + 1}")
    steps = [(f"s{k}", f"s{k}.g IS NOT DISTINCT FROM n0.g AND s{k}.i = n0.i // {8**k}") for k in range(lower)]
    steps += [(f"st{k}", f"st{k}.i = nt0.i // {8**k}") for k in range(upper)]
    joins = "JOIN nt0 ON nt0.lang IS NOT DISTINCT FROM n0.g " + " ".join(f"JOIN {s} ON {on}" for s, on in steps)
    proof = " || ".join(f"{s}.l || {s}.r" for s, _ in steps)
    parts.append(f"p0 AS (SELECT doc_id, leaf, nt0.h AS subroot, sha256({proof}) AS proof_sha256, forged AS f, {', '.join(f'{s}.l AS {s}l, {s}.r AS {s}r, {s}.more AS {s}m' for s, _ in steps)} FROM n0 {joins})")
    for k, (s, _) in enumerate(steps):
        parts.append(f"p{k + 1} AS (SELECT * REPLACE (CASE WHEN {s}m THEN sha256({s}l || f || {s}r) ELSE f END AS f) FROM p{k})")
    root = f"(SELECT h FROM nt{upper})"
    return f"WITH {CRC_TABLE}, {', '.join(parts)} SELECT doc_id, leaf, subroot, {root} AS root, proof_sha256, f AS folded_root, f = {root} AS verified FROM p{len(steps)}"

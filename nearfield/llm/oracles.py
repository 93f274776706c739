"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '{_WORDS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""

#: Rules of the secret scan: kind, pattern, and the least length of a group.
_RULES = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "AKIA[A-Z0-9]{12,}"),
    ("hex", "[0-9a-f]{32,}"),
    ("pem", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    ("hub_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("web_token", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)


def _found(order: int, kind: str, pattern: str) -> str:
    keep = f" WHERE length(regexp_extract(m[i], '{pattern}', 2)) >= 8" if kind == "assign" else ""
    before = "list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"
    return (
        f"SELECT doc_id, {order} AS o, '{kind}' AS kind, {before} AS a, {before} + length(m[i]) AS b FROM (SELECT doc_id, g, m, unnest(generate_series(1, len(m))) AS i "
        f"FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM t WHERE regexp_matches(text, '{pattern}'))){keep}"
    )


OP6 = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS MATERIALIZED ("
    + " UNION ALL ".join(_found(k, *rule) for k, rule in enumerate(_RULES))
    + "), x AS (SELECT *, kind || ':' || a::BIGINT || ':' || b::BIGINT AS s FROM f) "
    + "SELECT t.doc_id, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    + ", sha256(coalesce(string_agg(s, ',' ORDER BY a, o, b) FILTER (WHERE o < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, o, b), '') AS spans FROM t LEFT JOIN x USING (doc_id) GROUP BY t.doc_id"
)

_PARAGRAPH = r"[^.!?,;:\n]{1,64}[.!?,;:\n]*|[.!?,;:\n]+"


def _full(text: str) -> str:
    """Sections with whole hashes of their leaves."""
    leaf = "sha256(p) || '.' || length(p) || CASE WHEN starts_with(sha256(p), '0') THEN '|' ELSE ',' END"
    return f"list_filter(string_split(array_to_string(list_transform(regexp_extract_all({text}, '{_PARAGRAPH}'), lambda p: {leaf}), ''), '|'), lambda s: s <> '')"


def _tree(full: str) -> str:
    sections = f"list_transform({full}, lambda s: left(sha256(s), 16) || '=' || regexp_replace(s, '([0-9a-f]{{12}})[0-9a-f]{{52}}', '\\1', 'g'))"
    return f"sha256(array_to_string(list_transform({full}, lambda s: sha256(s)), '')) || ':' || array_to_string({sections}, '|')"


def _leaves(sections: str) -> str:
    return f"list_filter(flatten(list_transform({sections}, lambda s: string_split(substr(s, 18), ','))), lambda x: x <> '')"


def _weight(leaves: str) -> str:
    return f"coalesce(list_sum(list_transform({leaves}, lambda x: split_part(x, '.', 2)::BIGINT)), 0)"


def _near(name: str, other: str) -> str:
    """A query of ``doc_id, near`` from the trees in columns ``t`` and ``other`` of ``g``."""
    return (
        f"{name} AS (SELECT doc_id, CASE WHEN left(t, 64) = left(o, 64) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({_weight(_leaves('c'))} + {_weight('list_intersect(ra, rb)')})::DOUBLE / (2 * {_weight(_leaves('c'))} + {_weight('ra')} + {_weight('rb')})::DOUBLE END AS near FROM ("
        f"SELECT *, list_distinct({_leaves('list_distinct(list_filter(a, lambda s: NOT list_contains(c, s)))')}) AS ra, list_distinct({_leaves('list_distinct(list_filter(b, lambda s: NOT list_contains(c, s)))')}) AS rb FROM ("
        f"SELECT *, list_intersect(a, b) AS c FROM (SELECT doc_id, t, {other} AS o, list_filter(string_split(substr(t, 66), '|'), lambda s: s <> '') AS a, list_filter(string_split(substr({other}, 66), '|'), lambda s: s <> '') AS b FROM g))))"
    )


OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id DESC)),
f AS (SELECT *, left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM e),
p AS (SELECT doc_id, text, edited, {_full("text")} AS pt, {_full("edited")} AS pe, {_full("next")} AS pn FROM f),
g AS MATERIALIZED (SELECT doc_id, text, edited, {_tree("pt")} AS t, {_tree("pe")} AS te, {_tree("pn")} AS tn FROM p),
{_near("ne", "te")}, {_near("nn", "tn")}
SELECT g.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, t AS fingerprint, te AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next FROM g JOIN ne USING (doc_id) JOIN nn USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
line AS MATERIALIZED (SELECT doc_id, host, text, raw, place, array_to_string(regexp_extract_all(translate(raw, {_ASCII}), '{_WORDS}'), ' ') AS line, len(regexp_extract_all(raw, '{_WORDS}')) AS size
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d) WHERE regexp_matches(raw, '{_WORDS}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM line GROUP BY doc_id),
gram AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d))),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM gram, generate_series(0, 2) s(k) WHERE n > 1 GROUP BY doc_id),
often AS (SELECT host, line FROM line GROUP BY host, line HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, sum(size) AS n FROM line JOIN often USING (host, line) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS gone FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, gone AS removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.5 * n_words AS kept FROM s
"""

"""DuckDB SQL for the queries that SQL can express: the secret scan, chat formatting and substring dedup.

The others need a tokenizer's merges, a seeded hash, an edit distance over words or iterated
estimates; ``tests/llm`` holds them against libraries and plain Python.
"""

from __future__ import annotations

# A position is what stands before a match: the parts between matches and the matches before it.
_KINDS = (
    # kind, its pattern, the group that holds the value, the least length of the value
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\t\n\x0B\f\r ]{16,}", 0, 1),
    ("url_login", r"\b[a-z][a-z0-9+]{1,9}://[^\t\n\x0B\f\r /:@]{1,64}:([^\t\n\x0B\f\r /:@]{4,128})@", 1, 1),
    ("bearer", r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 1),
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
)


def _spans() -> str:
    one = []
    for k, (_, pattern, group, least) in enumerate(_KINDS):
        quoted = pattern.replace("'", "''")
        one.append(
            f"""SELECT rid, {k} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(a := list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT, n := length(m[i]), v := g[i]))) AS f, {least} AS least
FROM (SELECT rid, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g, string_split_regex(t, '{quoted}') AS p FROM d) WHERE len(m) > 0"""
        )
    return "\nUNION ALL ".join(one)


_NAMES = "[" + ", ".join(f"'{k}'" for k, *_ in _KINDS) + "]"

SECRETS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
f0 AS ({_spans()}),
f AS MATERIALIZED (SELECT rid, k, f.a AS a, f.a + f.n AS b, f.v AS v, {_NAMES}[k + 1] || ':' || f.a || ':' || (f.a + f.n) AS span FROM f0 WHERE length(f.v) >= least),
s AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM f GROUP BY 1),
v AS (SELECT DISTINCT rid, v FROM f),
o AS (SELECT v, count(*) AS n_owners FROM (SELECT DISTINCT v, source FROM v JOIN d USING (rid)) GROUP BY 1),
e AS (SELECT v, -sum(n / m * log2(n / m)) AS bits FROM (SELECT v, c, count(*)::DOUBLE AS n, length(v)::DOUBLE AS m FROM (SELECT v, unnest(string_split(v, '')) AS c FROM o) GROUP BY v, c) GROUP BY 1),
q AS (SELECT rid, count(*) AS n_values, count(*) FILTER (n_owners >= 3) AS n_copied, count(*) FILTER (n_owners < 3) AS n_owner_specific, count(*) FILTER (n_owners < 3 AND bits >= 3.0) AS n_live, max(n_owners) AS max_owners FROM v JOIN o USING (v) JOIN e USING (v) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_values, 0) AS n_values, coalesce(n_copied, 0) AS n_copied, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners
FROM d LEFT JOIN s USING (rid) LEFT JOIN q USING (rid)"""

_CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>")


def _escaped(column: str) -> str:
    """The length of the escaped text: one more for each backslash and for each control string."""
    more = [rf"length({column}) - length(replace({column}, '\', ''))", *(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)]
    return f"length({column}) + " + " + ".join(more)


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS i, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t), '') AS state FROM c),
x AS (SELECT *, CASE WHEN state = '' AND i = 1 THEN role IN ('system', 'user') WHEN state = 'system' THEN role = 'user' WHEN state = 'user' THEN role = 'assistant' WHEN state = 'assistant' THEN role = 'user' WHEN state = '' THEN role IN ('system', 'user') ELSE false END AS valid,
  {_escaped("t")} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + {_escaped("role")} END AS n FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (NOT valid) = 0 AND arg_max(role, i) = 'assistant' AS complete FROM x GROUP BY 1"""

SUBSTRINGS = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS o, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT rid, o, n, lo, substr(h, 2 * lo + 1, 2098) AS p FROM (SELECT rid, o, n, h, unnest(range(0, n - 49, 1000)) AS lo FROM d WHERE n >= 50)),
w AS (SELECT rid, o, lo + i AS pos, substr(p, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, n - 49 - lo))) AS i FROM c)),
f AS (SELECT s, min(o) AS least FROM w GROUP BY 1 HAVING min(o) < max(o)),
g AS (SELECT rid, pos FROM w JOIN f USING (s) WHERE o > least),
r AS (SELECT rid, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT rid, pos, sum(new) OVER (PARTITION BY rid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT rid, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY rid ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM g)) GROUP BY rid, run),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM r),
j AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN j USING (rid)"""

ORACLES: dict[str, str] = {"op2_secret_scan": SECRETS, "op3_chat_format": CHAT, "op10_substring_dedup": SUBSTRINGS}

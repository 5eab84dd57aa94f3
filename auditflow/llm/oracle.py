"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

ORACLE["op5_warc_archive"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""

_NUMBER = "((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

ORACLE["op9_poisson_mixing"] = f"""
WITH RECURSIVE weights(source, w) AS (
  VALUES ('src0', 0.2), ('src1', 0.1), ('src2', 0.1), ('src3', 0.05), ('__other__', 0.55)
), d AS (
  SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '__other__' END AS g,
         {_NUMBER.format(text="'42|' || doc_id::VARCHAR")} AS u
  FROM documents
), sizes AS (
  SELECT g, sum(length(coalesce(text, '')))::DOUBLE AS n FROM d GROUP BY g
), rates AS (
  SELECT g, (SELECT sum(n) FROM sizes) * w / (SELECT sum(w) FROM weights) / n AS rate
  FROM sizes JOIN weights ON g = source WHERE n > 0
), terms(g, rate, i, term, total) AS (
  SELECT g, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT g, rate, i + 1, term * rate / (i + 1)::DOUBLE, total + term * rate / (i + 1)::DOUBLE FROM terms WHERE i < 80
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM terms t WHERE t.g = d.g AND d.u > t.total) AS n
  FROM d
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy FROM drawn WHERE n > 0
)
SELECT *, md5('order42|' || doc_id::VARCHAR || '|' || copy::VARCHAR) AS shuffle_key FROM copies
"""


def _private() -> str:
    """The patterns plainly; places from the stretches between matches; validators as lists of digits."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT "
        f"ELSE substr(reverse({digits}), i, 1)::INT * 2 % 10 + substr(reverse({digits}), i, 1)::INT // 5 END)) % 10 = 0"
    )
    solid = "replace(m, ' ', '')"
    codes = f"list_transform(string_split(substr({solid}, 5) || substr({solid}, 1, 4), ''), lambda c: CASE WHEN c < ':' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_prepend(0, {codes}), lambda a, c: (CASE WHEN c < 10 THEN a * 10 + c ELSE a * 100 + c END) % 97) = 1"
    cards, groups = "card|visa|master|credit|payment", "[0-9]{4}[ -]?"
    kinds = [
        # name, pattern, valid, score, context words, what they add, characters that must not touch the match
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 90, "mail|contact", 10, None),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255", 60,
         "address|host|server", 30, None),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", 80, cards, 20, None),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15", 70, "phone|tel|call|mobile|fax", 30, None),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"length({solid}) BETWEEN 15 AND 34 AND {mod97}", 90,
         "iban|account|bank", 10, "[A-Za-z0-9]"),
        ("card_group", groups * 3 + "[0-9]{4}", f"regexp_matches(m, '^(?:4|5[1-5]|2[2-7]|6)') AND {luhn}", 70, cards, 20, "[0-9]"),
        ("card_short", "[0-9]{13}", f"m LIKE '4%' AND {luhn}", 30, cards, 30, "[0-9]"),
        ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')", 40, "ssn|social|security|tax", 50, "[0-9-]"),
    ]
    found = []
    for rank, (name, pattern, valid, score, context, boost, bounds) in enumerate(kinds):
        free = "true"
        if bounds:
            free = (
                f"(i = 1 OR before <> '') AND NOT regexp_matches(before, '{bounds}$') AND (i = n OR behind <> '') AND NOT regexp_matches(behind, '^{bounds}')"
            )
        near = f"regexp_matches(right(before, 40) || ' ' || left(behind, 40), '(?i){context}')"
        found.append(f"""
  SELECT r, {rank} AS rank, '{name}' AS kind, place - length(m) AS s, place AS e, {score} + CASE WHEN {near} THEN {boost} ELSE 0 END AS score
  FROM (
    SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY i) AS place
    FROM (
      SELECT r, i, len(ms) AS n, ms[i] AS m, gaps[i] AS before, gaps[i + 1] AS behind
      FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i
            FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))
    )
  ) WHERE {valid} AND {free}""")
    text = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"coalesce(count(kind) FILTER (WHERE kind = '{k[0]}'), 0) AS n_{k[0]}" for k in kinds[:4])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(found)}
), wanted AS (
  SELECT * FROM found f
  WHERE rank < 4 OR score >= 50 AND NOT (kind LIKE 'card\\_%' ESCAPE '\\' AND EXISTS (
    SELECT 1 FROM found c WHERE c.r = f.r AND c.kind = 'card' AND c.s <= f.s AND f.e <= c.e))
)
SELECT any_value(doc_id) AS doc_id, {counts},
       sha256(coalesce(string_agg({text}, ',' ORDER BY s, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY s, rank), '') AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, rank), '') AS scores
FROM d LEFT JOIN wanted USING (r) GROUP BY r
"""


ORACLE["op13_private_data"] = _private()

# CRC-32 bit by bit: DuckDB has no function for it.
_CRC32 = """xor(list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: i::UBIGINT)),
    lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT)"""

ORACLE["op11_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, n, {_CRC32} % 4 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), rebuilt AS (
  SELECT v.c, t.pos AS d, role, text FROM convs v JOIN t ON t.c = v.c - v.c % 20 AND t.pos <= v.h
  UNION ALL
  SELECT v.c, least(v.h::BIGINT, coalesce(b.n, 0)) + t.pos - v.h::BIGINT, role, text
  FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h LEFT JOIN convs b ON b.c = v.c - v.c % 20
), named AS (
  SELECT c, d, dense_rank() OVER (ORDER BY role, text) AS id,
         len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words
  FROM rebuilt
), prefixes AS (
  SELECT c, d, words, array_agg(id) OVER (PARTITION BY c ORDER BY d) AS p, count(*) OVER (PARTITION BY c) AS turns FROM named
  UNION ALL
  SELECT c, 0, 0, []::BIGINT[], (SELECT count(*) FROM rebuilt r WHERE r.c = convs.c) FROM convs
), nodes AS (
  SELECT d, p, min(c) AS node, count(*) AS n_convs, any_value(words) AS words, max(turns) = d AS childless,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE turns = d), '')) AS ends
  FROM prefixes GROUP BY d, p
)
SELECT v.node AS conv_id, v.d AS depth, any_value(u.node) FILTER (WHERE u.d = v.d - 1) AS parent_conv_id, v.n_convs,
       count(*) FILTER (WHERE u.d = v.d + 1) AS n_children, count(*) FILTER (WHERE u.d >= v.d AND u.childless) AS n_leaves,
       coalesce(sum((u.n_convs - 1) * u.words) FILTER (WHERE u.d >= v.d), 0)::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN nodes u ON (u.d >= v.d AND u.p[1:v.d] = v.p) OR (u.d = v.d - 1 AND v.p[1:u.d] = u.p)
GROUP BY v.node, v.d, v.p, v.n_convs, v.ends
"""

ORACLE["op12_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d
), w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), f1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(ws) AS w1 FROM w) GROUP BY ALL
), f2 AS (
  SELECT lang, x.a AS w1, x.b AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) AS x FROM w) GROUP BY ALL
), f3 AS (
  SELECT lang, x.a AS w1, x.b AS w2, x.c AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]})) AS x FROM w) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), three AS (
  SELECT t.lang, t.w1, t.w2, t.w3, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
         (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w1 = t.w3
  JOIN f2 xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN f2 yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3
  WHERE t.f >= 10
), candidates AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, ((1000000::HUGEINT * p.f * p.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE p.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM three t WHERE t.lang = p.lang AND ((t.w1 = p.w1 AND t.w2 = p.w2) OR (t.w2 = p.w1 AND t.w3 = p.w2)) AND 100 * t.a >= 50 * p.f)
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)::BIGINT
  FROM three
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM candidates
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

"""DuckDB SQL for the registered queries that SQL can express."""

from .quality_rules import LEAST_SPREAD, MEDIAN, METRICS, MOST, REACH, SHRINK, levels
from .secrets import BASE_KINDS, RULES


def _op1() -> str:
    """Per rule: matches and the text between them give starts and ends (code points)."""
    parts = []
    for i, rule in enumerate(RULES):
        pattern = (rule.pattern.replace("{3,}", "+") if rule.kind == "hex" else rule.pattern).replace("'", "''")
        value = f"regexp_replace(m, '^[^:=]*[:=]\\x20*[\"'']?', '')" if rule.value_only else "m"
        parts.append(f"""
  SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, unnest(found) AS m,
         unnest(list_transform(range(1, len(found) + 1), lambda j:
           list_sum(list_transform(gaps[1:j], lambda x: length(x))) +
           coalesce(list_sum(list_transform(found[1:j - 1], lambda x: length(x))), 0))) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps
        FROM docs) WHERE len(found) > 0""")
        parts[-1] = (f"SELECT doc_id, k, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM ({parts[-1]}) "
                     f"WHERE length({value}) >= {rule.least}")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    join = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(f.k) FILTER (f.kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({join} FILTER (f.kind IN ({base})), '')) AS base_sha256,
       coalesce({join} FILTER (f.kind IS NOT NULL), '') AS spans
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM windows WHERE k > 1),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM words) ANTI JOIN gone USING (doc_id, j)
  GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def _op4() -> str:
    bins = {m: f"CASE WHEN {total} > 0 THEN least(({scale} * {count}) // {total}, {MOST}) ELSE 0 END"
            for m, (count, total, scale, _, _) in METRICS.items()}
    sketch = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {b} AS bin FROM counts WHERE NOT base_failed"
                                for m, b in bins.items())

    def quantiles(group: str) -> str:
        cols = ", ".join(f"min(bin) FILTER (metric = '{m}' AND 1000 * below >= {q} * docs) AS {m}_q{q}" for m in METRICS for q in levels(m))
        return f"""SELECT {group}, max(docs) AS docs, {cols} FROM (
          SELECT {group}, metric, bin, sum(n) OVER (PARTITION BY {group}, metric) AS docs,
                 sum(n) OVER (PARTITION BY {group}, metric ORDER BY bin ROWS UNBOUNDED PRECEDING) AS below
          FROM (SELECT {group}, metric, bin, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY {group}"""

    tests = []
    for m, (_, _, _, upper, lower) in METRICS.items():
        middle, high = (f"((s.docs * s.{m}_q{q} + {SHRINK} * l.{m}_q{q}) // (s.docs + {SHRINK}))" for q in (MEDIAN, upper))
        tests.append(f"{bins[m]} <= {high} + {REACH} * greatest({high} - {middle}, {LEAST_SPREAD})")
        if lower is not None:
            low = f"((s.docs * s.{m}_q{lower} + {SHRINK} * l.{m}_q{lower}) // (s.docs + {SHRINK}))"
            tests.append(f"{bins[m]} >= {low} - {REACH} * greatest({middle} - {low}, {LEAST_SPREAD})")
    return rf"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM grams WHERE c > 1) GROUP BY doc_id
), counts AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT w.doc_id, w.lang, w.source, CAST(len(w.w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM words w LEFT JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN repeats r ON w.doc_id = r.doc_id)
), sketch AS ({sketch}), by_source AS ({quantiles("lang, source")}), by_lang AS ({quantiles("lang")})
SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed,
       NOT c.base_failed AND coalesce({" AND ".join(tests)}, true) AS kept
FROM counts c LEFT JOIN by_source s ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
LEFT JOIN by_lang l ON c.lang IS NOT DISTINCT FROM l.lang
"""


OP6 = r"""
WITH conv AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id
), copies AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM conv GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM conv))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(turns, lambda x:
         '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10) || '<|end|>' || chr(10)), '') AS text
FROM copies WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = copies.turns)
"""

OP8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS pat
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
), hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x USING (size, pat)),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words h ON w.doc_id = h.doc_id LEFT JOIN hit_items t ON w.doc_id = t.doc_id
"""


# Pairs by shared shingles, components by following the smallest reachable id.
OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 9 * c >= 4 * (s.n + t.n)
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""


# crc32 of a decimal number: bit by bit over its characters.
CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295)"""

OP11 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS own FROM turns GROUP BY conv_id
), plan AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS head FROM conv),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.own[1:p.head], []), p.own[p.head + 1:]) AS seq
  FROM plan p LEFT JOIN conv b ON b.conv_id = p.base
), members AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(seq)) = max(depth) AS leaf,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth) AS ends
  FROM members GROUP BY ALL
), below AS (
  SELECT node[1:up] AS node, up AS depth, CAST(sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].t) ELSE 0 END) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) GROUP BY ALL
), children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
"""


OP12 = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) AS sizes(m) WHERE len(w) >= m)
), freq AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, c.k, l.a AS l, r.a AS r,
         CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), scored AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM cuts),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates)) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases x ON x.lang = s.lang AND x.phrase = s.phrase
  WHERE s.cut = 1 AND NOT coalesce(100 * x.a >= 100 * s.a, false)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _op1(), "op2_substring_dedup": OP2, "op4_quality_rules": _op4(), "op6_chat": OP6, "op8_decontam": OP8, "op10_jaccard_join": OP10,
            "op11_conversation_trie": OP11, "op12_collocations": OP12}

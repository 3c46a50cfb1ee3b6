"""Independent SQL for every registered query, run by DuckDB on the same parquet tables.

Written the relational way (dimension ``VALUES`` lists, ``GROUP BY``, ``LEFT JOIN``, window
functions) rather than mirroring the Spark operators, so agreement is evidence. DuckDB has no
NFKC; the generated documents are NFKC-stable, so its cleaning is the whitespace rule alone, also
for the query that writes their letters in full-width form first.
"""

from __future__ import annotations

from ..functions.numeric import DECIMAL_NUMBER
from ..functions.text import NON_WS, WS_RUN
from ..schema import (CATEGORY_COLOURS, CLASS_COLOURS, CLASS_LABELS, CLASSES, FIGURE_LANGUAGES,
                      FIXED_SENTENCES_PER_LANGUAGE, LANGUAGES, two_line_label)
from ..sources.testdata import DOC_LANGUAGE_COLUMNS, EVENT_CATEGORIES, UNPARSEABLE_EVERY


def _zfill(e: str) -> str:
    return (f"(CASE WHEN length({e}) >= 4 THEN {e} "
            f"WHEN substr({e}, 1, 1) IN ('-', '+') THEN substr({e}, 1, 1) || lpad(substr({e}, 2), 3, '0') "
            f"ELSE lpad({e}, 4, '0') END)")


def _pct(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * CAST(100 AS DOUBLE))"


def _values(rows: list[tuple], cols: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({cols}))"


_PIVOT = ",\n    ".join(f"max(CASE WHEN lang = '{k}' THEN text END) AS \"{v}\""
                       for k, v in DOC_LANGUAGE_COLUMNS.items())
_CODES = ", ".join(f"'{k}'" for k in DOC_LANGUAGE_COLUMNS)
_WIDE_LANGS = list(DOC_LANGUAGE_COLUMNS.values())

WIDE = f"""wide AS (
  SELECT rn AS sentence_id,
    {_PIVOT}
  FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
        FROM documents WHERE lang IN ({_CODES})) numbered
  GROUP BY rn)"""


def _melt(missing: str = "drop") -> str:
    cell = (lambda c: f"coalesce(\"{c}\", 'nan')") if missing == "as_text" else (lambda c: f"\"{c}\"")
    arms = "\n    UNION ALL ".join(
        f"SELECT sid AS sentence_id, '{l}' AS \"Language\", {cell(l)} AS \"Text\", {cell('English')} AS English_source FROM ids"
        for l in _WIDE_LANGS)
    return f"""ids AS (SELECT {_zfill('CAST(sentence_id AS VARCHAR)')} AS sid, * FROM wide),
long AS ({arms}),
melted AS (SELECT * FROM long WHERE "Text" IS NOT NULL AND regexp_matches("Text", '{NON_WS}'))"""


def _logit(ch: str) -> str:
    return (f"CAST(30 AS DOUBLE) * (CAST(length(clean_text) - length(replace(clean_text, '{ch}', '')) AS DOUBLE)"
            f" / CAST(length(clean_text) AS DOUBLE))")


SCORE = f"""cleaned AS (SELECT *, trim(regexp_replace("Text", '{WS_RUN}', ' ', 'g'), ' ') AS clean_text FROM melted),
logit AS (SELECT *, {_logit('a')} AS x0, {_logit('n')} AS x1, {_logit('i')} AS x2 FROM cleaned),
expd AS (SELECT *, exp(x0 - greatest(x0, x1, x2)) AS e0, exp(x1 - greatest(x0, x1, x2)) AS e1,
                   exp(x2 - greatest(x0, x1, x2)) AS e2 FROM logit),
prob AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM expd),
scored AS (
  SELECT sentence_id, "Language", "Text", English_source,
    CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END AS "Sentiment",
    round_even(greatest(p0, p1, p2), 10) AS "Confidence",
    greatest(p0, p1, p2) < 0.5 AS low_confidence_flag,
    p0, p1, p2
  FROM prob)"""

SCORED = f"WITH {WIDE},\n{_melt()},\n{SCORE}\n"

_RESULT_COLS = 'sentence_id, "Language", "Text", English_source, "Sentiment", "Confidence", low_confidence_flag'

_CLS = _values([(i, c, l, col) for i, (c, l, col) in enumerate(zip(CLASSES, CLASS_LABELS, CLASS_COLOURS))],
               'class_ord, "Sentiment", class_label, colour')


def _langs(langs):
    return _values(list(enumerate(langs)), 'ord, "Language"')


def _lang_rows(langs) -> str:
    counts = ", ".join(f"CAST(count_if(\"Sentiment\" = '{c}') AS BIGINT) AS {c}" for c in CLASSES)
    return f"""agg AS (SELECT "Language", {counts},
                   CAST(count_if(low_confidence_flag) AS BIGINT) AS low_conf_n, count(*) AS n
            FROM scored GROUP BY "Language"),
rows AS (SELECT d.ord, d."Language", {", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in CLASSES)},
                coalesce(a.low_conf_n, 0) AS low_conf_n, coalesce(a.n, 0) AS n,
                {_pct('a.low_conf_n', 'a.n')} AS low_conf_pct
         FROM {_langs(langs)} d LEFT JOIN agg a ON a."Language" = d."Language")"""


def _lang_classes(langs):
    return _values([(j, l, i, c) for j, l in enumerate(langs) for i, c in enumerate(CLASSES)],
                   'ord, "Language", class_ord, "Sentiment"')


def _share(langs, denominator) -> str:
    if denominator == "actual":
        denom = "coalesce(tot.n, 0)"
    elif denominator == "floor_mean":
        denom = f"((SELECT count(*) FROM scored) // {len(langs)})"
    else:
        denom = f"CAST({int(denominator)} AS BIGINT)"
    return f"""cnt AS (SELECT "Language", "Sentiment", count(*) AS n FROM scored GROUP BY ALL),
tot AS (SELECT "Language", count(*) AS n FROM scored GROUP BY ALL),
share AS (
  SELECT d.ord, d."Language", d.class_ord, d."Sentiment", coalesce(cnt.n, 0) AS n, {denom} AS denom,
         {_pct('coalesce(cnt.n, 0)', denom)} AS pct
  FROM {_lang_classes(langs)} d
  LEFT JOIN cnt ON cnt."Language" = d."Language" AND cnt."Sentiment" = d."Sentiment"
  LEFT JOIN tot ON tot."Language" = d."Language")"""


_PLACED = """offs AS (SELECT *, coalesce(sum(pct) OVER (PARTITION BY "Language" ORDER BY class_ord
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "left" FROM share),
placed AS (SELECT *, NOT ("Sentiment" = 'neutral' AND NOT coalesce(pct >= 8, false)) AS inside FROM offs),
labelled AS (
  SELECT *, CASE WHEN inside THEN "left" + pct / 2 ELSE "left" + pct + CAST(1.2 AS DOUBLE) END AS x,
         CASE WHEN pct IS NULL THEN NULL
              WHEN inside THEN printf('%d', n) || chr(10) || printf('(%.0f%%)', pct)
              ELSE printf('%d (%.0f%%)', n, pct) END AS label
  FROM placed)"""


def _cats(cats):
    rows = []
    for i, c in enumerate(cats):
        rows.append((i, c, two_line_label(c), CATEGORY_COLOURS[i % len(CATEGORY_COLOURS)]))
    return _values(rows, "ord, final_category, label, colour")


def _taxonomy(cats, null_mean: bool = False) -> str:
    return f"""annotated AS (
  SELECT event_type AS final_category,
         CASE WHEN event_id % {UNPARSEABLE_EVERY} = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS "Confidence"
  FROM events),
trimmed AS (SELECT final_category, regexp_replace("Confidence", '^{WS_RUN}|{WS_RUN}$', '', 'g') AS tc FROM annotated),
parsed AS (SELECT final_category,
                  CASE WHEN regexp_matches(tc, '{DECIMAL_NUMBER}') THEN TRY_CAST(tc AS DOUBLE) END AS conf
           FROM trimmed),
agg AS (SELECT final_category, count(*) AS n, count(conf) AS n_parsed, avg(conf) AS mean_conf
        FROM parsed GROUP BY final_category),
tax AS (
  SELECT c.ord, c.final_category, c.label, c.colour, coalesce(a.n, 0) AS n,
         {_pct('coalesce(a.n, 0)', '(SELECT count(*) FROM annotated)')} AS pct,
         coalesce(a.n_parsed, 0) AS n_parsed,
         {'a.mean_conf' if null_mean else 'coalesce(a.mean_conf, CAST(0 AS DOUBLE))'} AS mean_conf
  FROM {_cats(cats)} c LEFT JOIN agg a ON a.final_category = c.final_category)"""


TAX = f"WITH {_taxonomy(EVENT_CATEGORIES)}\n"
TAX_NULL = f"WITH {_taxonomy(EVENT_CATEGORIES, null_mean=True)}\n"

_CHART_TAX = """, w AS (
  SELECT *, sum(mean_conf * n) FILTER (WHERE mean_conf IS NOT NULL) OVER ()
            / CAST(sum(n) FILTER (WHERE mean_conf IS NOT NULL) OVER () AS DOUBLE) AS wm,
         min(mean_conf) OVER () - CAST(0.006 AS DOUBLE) AS lo, max(mean_conf) OVER () + CAST(0.012 AS DOUBLE) AS hi
  FROM tax)
SELECT ord, final_category, label, colour, n, pct, n_parsed, round_even(mean_conf, 6) AS mean_conf,
       printf('%.1f%%  (n=%d)', pct, n) AS bar_label,
       printf('%.3f', mean_conf) AS conf_label,
       round_even(wm, 6) AS weighted_mean, printf('Mean: %.3f', wm) AS mean_label,
       round_even(lo, 6) AS x_min, round_even(hi, 6) AS x_max
FROM w"""


def oracle_sql() -> dict[str, str]:
    fl, pl = FIGURE_LANGUAGES, LANGUAGES
    wide_cols = ", ".join(f'"{l}"' for l in _WIDE_LANGS)
    total_counts = ", ".join(f"CAST(count_if(\"Sentiment\" = '{c}') AS BIGINT) AS {c}" for c in CLASSES)
    lang_rows = f"WITH {WIDE},\n{_melt()},\n{SCORE},\n{_lang_rows(pl)}\n"
    share = lambda d, langs=fl: f"WITH {WIDE},\n{_melt()},\n{SCORE},\n{_share(langs, d)}\n"
    stack = lambda d, langs=fl: share(d, langs) + "," + _PLACED + f"""
SELECT l.ord, l."Language", l.class_ord, l."Sentiment", l.n, l.pct, l."left", l.x, l.inside, l.label, c.colour
FROM labelled l JOIN {_CLS} c ON c."Sentiment" = l."Sentiment\""""
    return {
        "wide_scan": f"WITH {WIDE}\nSELECT CAST(sentence_id AS VARCHAR) AS sentence_id, {wide_cols} FROM wide",
        "wide_scan_reordered": f"WITH {WIDE}\nSELECT CAST(sentence_id AS VARCHAR) AS sentence_id, {wide_cols} FROM wide",
        "wide_scan_na": f"WITH {WIDE}\nSELECT CAST(sentence_id AS VARCHAR) AS sentence_id, "
                        + ", ".join(f'CASE WHEN sentence_id % 3 <> 0 THEN "{l}" END AS "{l}"' if l == "English" else f'"{l}"'
                                    for l in _WIDE_LANGS) + " FROM wide",
        # Of the derived blanks only the zero-width space (the fifth) is no white space.
        "blank_filter_derived": f"SELECT doc_id, lang FROM documents WHERE CASE WHEN doc_id % 5 = 0 "
                                f"THEN doc_id % 7 = 4 ELSE regexp_matches(text, '{NON_WS}') END",
        "preprocess_nfkc": f"SELECT doc_id, trim(regexp_replace(text, '{WS_RUN}', ' ', 'g'), ' ') AS clean_text FROM documents",
        "results_as_text": f"WITH {WIDE},\n{_melt('as_text')},\n{SCORE}\nSELECT {_RESULT_COLS} FROM scored",
        "id_pad": f"SELECT o_orderkey, {_zfill('CAST(o_orderkey AS VARCHAR)')} AS sentence_id FROM orders",
        "melt": f"WITH {WIDE},\n{_melt()}\nSELECT sentence_id, \"Language\", \"Text\", English_source FROM melted",
        "melt_missing_as_text": f"WITH {WIDE},\n{_melt('as_text')}\n"
                                f"SELECT sentence_id, \"Language\", \"Text\", English_source FROM melted",
        "blank_filter": f"SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '{NON_WS}')",
        "preprocess": SCORED + 'SELECT sentence_id, "Language", clean_text FROM cleaned',
        "logits_udf": SCORED + 'SELECT sentence_id, "Language", x0 AS logit_negative, x1 AS logit_neutral, '
                               'x2 AS logit_positive FROM logit',
        "scores": SCORED + " UNION ALL ".join(
            f"SELECT sentence_id, \"Language\", '{c}' AS label, round_even(p{i}, 10) AS score FROM scored"
            for i, c in enumerate(CLASSES)),
        "predict": SCORED + 'SELECT sentence_id, "Language", "Sentiment", "Confidence", low_confidence_flag FROM scored',
        "results": SCORED + f"SELECT {_RESULT_COLS} FROM scored",
        "results_udf": SCORED + f"SELECT {_RESULT_COLS} FROM scored",
        "lowconf_cases": SCORED + f"SELECT {_RESULT_COLS} FROM scored WHERE low_confidence_flag",
        "results_roundtrip": SCORED + f"SELECT {_RESULT_COLS} FROM scored",
        "annotated_scan": TAX + 'SELECT final_category, "Confidence" FROM annotated',
        "load_counts": f"WITH {WIDE},\n{_melt()}\n"
                       f"SELECT count(*) AS n_sentences, {1 + len(_WIDE_LANGS)} AS n_columns, "
                       f"{len(pl)} AS n_languages, count(*) * {len(pl)} AS n_announced, "
                       f"(SELECT count(*) FROM melted) AS n_records FROM wide",
        "preview": f"WITH {WIDE}\nSELECT sentence_id, {wide_cols} FROM wide ORDER BY sentence_id LIMIT 3",
        "class_dist": SCORED + f""", cnt AS (SELECT "Sentiment", count(*) AS n FROM scored GROUP BY "Sentiment"),
j AS (SELECT c.class_ord, c."Sentiment", coalesce(cnt.n, 0) AS n FROM {_CLS} c LEFT JOIN cnt ON cnt."Sentiment" = c."Sentiment")
SELECT class_ord, "Sentiment", n, {_pct('n', 'sum(n) OVER ()')} AS pct FROM j""",
        "lang_class_counts": share("actual") + 'SELECT ord, "Language", class_ord, "Sentiment", n FROM share',
        "lang_summary": lang_rows + "SELECT * FROM rows",
        "grand_summary": SCORED + f"SELECT CAST(count_if(low_confidence_flag) AS BIGINT) AS low_conf_n, count(*) AS n, "
                                  f"{_pct('count_if(low_confidence_flag)', 'count(*)')} AS low_conf_pct FROM scored",
        "summary_report": lang_rows + f"""SELECT *, false AS is_total FROM rows
UNION ALL
SELECT {len(pl)} AS ord, 'Total' AS "Language", {total_counts},
       CAST(count_if(low_confidence_flag) AS BIGINT) AS low_conf_n, count(*) AS n,
       {_pct('count_if(low_confidence_flag)', 'count(*)')} AS low_conf_pct, true AS is_total
FROM scored""",
        "summary_lines": lang_rows + f"""SELECT ord, printf('  %-10s neg=%3d  neu=%3d  pos=%3d  | low-conf=%d (',
       "Language", negative, neutral, positive, low_conf_n)
       || coalesce(printf('%.1f', low_conf_pct), 'nan') || '%)' AS line
FROM rows
UNION ALL
SELECT {len(pl)} AS ord, printf('  Total low-confidence (< 0.5): %d / %d (', count_if(low_confidence_flag), count(*))
       || coalesce(printf('%.1f', {_pct('count_if(low_confidence_flag)', 'count(*)')}), 'nan')
       || '%)' AS line
FROM scored""",
        "summary_lines_notebook": lang_rows + f"""SELECT ord, printf('  %-10s neg=%3d  neu=%3d  pos=%3d  | low-conf=%d (',
       "Language", negative, neutral, positive, low_conf_n)
       || coalesce(printf('%.1f', low_conf_pct), 'nan') || '%)' AS line
FROM rows
UNION ALL
SELECT {len(pl)} AS ord, printf('  Total low-confidence: %d/%d (', count_if(low_confidence_flag), count(*))
       || coalesce(printf('%.1f', {_pct('count_if(low_confidence_flag)', 'count(*)')}), 'nan')
       || '%)' AS line
FROM scored""",
        "lang_share": share("actual") + "SELECT * FROM share",
        "lang_share_floor": share("floor_mean") + "SELECT * FROM share",
        "lang_share_fixed": share(FIXED_SENTENCES_PER_LANGUAGE) + "SELECT * FROM share",
        "stack_offsets": share("actual") + "," + _PLACED +
                         '\nSELECT ord, "Language", class_ord, "Sentiment", pct, "left" FROM labelled',
        "label_placement": share("actual") + "," + _PLACED +
                           '\nSELECT ord, "Language", class_ord, "Sentiment", n, pct, "left", x, inside, label FROM labelled',
        "legend_labels": SCORED + f""", cnt AS (SELECT "Sentiment", count(*) AS n FROM scored GROUP BY "Sentiment"),
j AS (SELECT c.class_ord, c."Sentiment", c.class_label, coalesce(cnt.n, 0) AS n
      FROM {_CLS} c LEFT JOIN cnt ON cnt."Sentiment" = c."Sentiment")
SELECT class_ord, "Sentiment",
       printf('%s  %s  (%.1f%%)', class_label, format('{{:,}}', n), {_pct('n', 'sum(n) OVER ()')}) AS legend
FROM j""",
        "chart_donut": SCORED + f""", cnt AS (SELECT "Sentiment", count(*) AS n FROM scored GROUP BY "Sentiment"),
j AS (SELECT c.class_ord, c."Sentiment", c.class_label, c.colour, coalesce(cnt.n, 0) AS n,
             sum(coalesce(cnt.n, 0)) OVER () AS grand
      FROM {_CLS} c LEFT JOIN cnt ON cnt."Sentiment" = c."Sentiment")
SELECT class_ord, "Sentiment", class_label, colour, n, {_pct('n', 'grand')} AS pct,
       printf('%s  %s  (%.1f%%)', class_label, format('{{:,}}', n), {_pct('n', 'grand')}) AS legend,
       'n = ' || format('{{:,}}', grand) AS centre
FROM j""",
        "chart_stack": stack("actual"),
        "chart_stack_fixed": stack(FIXED_SENTENCES_PER_LANGUAGE),
        "chart_stack_floor": stack("floor_mean", pl),
        "taxonomy_dist": TAX + "SELECT ord, final_category, n, pct FROM tax",
        "taxonomy_conf": TAX + "SELECT ord, final_category, n_parsed, round_even(mean_conf, 6) AS mean_conf FROM tax",
        "taxonomy_conf_null_mean": TAX + """SELECT c.ord, c.final_category, coalesce(a.n_parsed, 0) AS n_parsed,
       round_even(a.mean_conf, 6) AS mean_conf
FROM {cats} c LEFT JOIN agg a ON a.final_category = c.final_category""".format(cats=_cats(EVENT_CATEGORIES)),
        "weighted_mean_null_mean": TAX + """, m AS (
  SELECT c.final_category, coalesce(a.n, 0) AS n, coalesce(a.n_parsed, 0) AS n_parsed, a.mean_conf
  FROM {cats} c LEFT JOIN agg a ON a.final_category = c.final_category)
SELECT round_even(sum(mean_conf * n) FILTER (WHERE mean_conf IS NOT NULL)
                  / CAST(sum(n) FILTER (WHERE mean_conf IS NOT NULL) AS DOUBLE), 6) AS weighted_mean,
       round_even(sum(mean_conf * n_parsed) FILTER (WHERE mean_conf IS NOT NULL)
                  / CAST(sum(n_parsed) FILTER (WHERE mean_conf IS NOT NULL) AS DOUBLE), 6) AS plain_mean,
       CAST(sum(n) AS BIGINT) AS n
FROM m""".format(cats=_cats(EVENT_CATEGORIES)),
        "weighted_mean": TAX + """SELECT round_even(sum(mean_conf * n) / CAST(sum(n) AS DOUBLE), 6) AS weighted_mean,
       round_even(sum(mean_conf * n_parsed) / CAST(sum(n_parsed) AS DOUBLE), 6) AS plain_mean,
       CAST(sum(n) AS BIGINT) AS n FROM tax""",
        "axis_bounds": TAX + """SELECT round_even(min(mean_conf) - CAST(0.006 AS DOUBLE), 6) AS x_min,
       round_even(max(mean_conf) + CAST(0.012 AS DOUBLE), 6) AS x_max FROM tax""",
        "taxonomy_sorted": TAX + """SELECT ord, final_category, n, pct,
       CAST(row_number() OVER (ORDER BY n, ord) AS INTEGER) AS rank FROM tax""",
        "chart_taxonomy": TAX + _CHART_TAX,
        "chart_taxonomy_null_mean": TAX_NULL + _CHART_TAX,
    }

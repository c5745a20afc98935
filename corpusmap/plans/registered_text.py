"""Registered queries of the full analysis: Unicode words, possessives, stop words, Porter stems.

The SQL goes its own ways.  Words: every character is replaced by the letter of its word-break
class, the boundary rules cut that string, and the cuts are carried back to the text by position.
Stems: measures are counted (vowel-consonant runs of the stem), not matched.
"""

from __future__ import annotations

from ..functions.stem import STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES
from ..functions.text import word_pattern
from ..operators import terms as T
from .registered import SQL_TERMS, _STOP, _with, documents, register
from .termvect import TermVectConfig, postings


# ----------------------------------------------------------------- words in SQL
# class letters of the SQL form; quotes stand for themselves, as the rules name them
_LETTERS = {"extend": "x", "ideograph": "i", "katakana": "k", "complex": "c", "hebrew": "h", "numeric": "n", "joiner": "j",
            "mid_letter": "[mb']", "mid_number": "[pb']", "letter": "l"}
_RULES = word_pattern(_LETTERS).replace("++", "+").replace("*+", "*").replace("?+", "?").replace("'", "''")

SQL_WORDS = rf"""
  chars AS (
    SELECT c, CASE
      WHEN regexp_matches(c, '[\p{{M}}\p{{Cf}}\x{{FF9E}}\x{{FF9F}}]') AND c <> chr(8203) THEN 'x'
      WHEN regexp_matches(c, '[\p{{Han}}\p{{Hiragana}}]') THEN 'i'
      WHEN regexp_matches(c, '[\p{{Katakana}}\x{{3031}}-\x{{3035}}\x{{309B}}\x{{309C}}\x{{30A0}}\x{{30FC}}\x{{FF70}}]') THEN 'k'
      WHEN regexp_matches(c, '\p{{L}}') AND regexp_matches(c, '[\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]') THEN 'c'
      WHEN regexp_matches(c, '\p{{L}}') AND regexp_matches(c, '\p{{Hebrew}}') THEN 'h'
      WHEN regexp_matches(c, '[\p{{Nd}}\x{{066B}}]') THEN 'n'
      WHEN regexp_matches(c, '\p{{Pc}}') OR c = chr(8239) THEN 'j'
      WHEN c IN ('''', '"') THEN c
      WHEN regexp_matches(c, '[.\x{{2018}}\x{{2019}}\x{{2024}}\x{{FE52}}\x{{FF07}}\x{{FF0E}}]') THEN 'b'
      WHEN regexp_matches(c, '[:\x{{00B7}}\x{{0387}}\x{{055F}}\x{{05F4}}\x{{2027}}\x{{FE13}}\x{{FE55}}\x{{FF1A}}]') THEN 'm'
      WHEN regexp_matches(c, '[,;\x{{037E}}\x{{0589}}\x{{060C}}\x{{060D}}\x{{066C}}\x{{07F8}}\x{{2044}}\x{{FE10}}\x{{FE14}}\x{{FE50}}\x{{FE54}}\x{{FF0C}}\x{{FF1B}}]') THEN 'p'
      WHEN regexp_matches(c, '[\p{{L}}\p{{Nl}}\x{{24B6}}-\x{{24E9}}]') THEN 'l'
      ELSE 'o' END AS k
    FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''),
  class_map AS (SELECT string_agg(c, '' ORDER BY c) AS c, string_agg(k, '' ORDER BY c) AS k FROM chars),
  pieces AS (
    SELECT doc_id, text, regexp_extract_all(translate(text, class_map.c, class_map.k), '{_RULES}|o+|.') AS p
    FROM documents, class_map),
  placed AS (
    SELECT doc_id, p, i, 1 + coalesce(sum(length(p)) OVER (
      PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM pieces)),
  word_tok AS (
    SELECT doc_id, lower(regexp_replace(substring(text, start, length(placed.p)), '[''’＇][sS]$', '')) AS term
    FROM placed JOIN documents USING (doc_id) WHERE regexp_matches(placed.p, '[lhnkci]')),
  words AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf FROM word_tok
    WHERE term NOT IN ({_STOP}) AND length(term) > 0 GROUP BY doc_id, term)"""


# ----------------------------------------------------------------- stems in SQL
def _measure(stem: str) -> str:
    return f"len(regexp_extract_all({stem}, '[aeiouy]+[^aeiouy]+'))"


def _cvc(stem: str) -> str:
    return f"regexp_matches({stem}, '[^aeiouy][aeiouy][^aeiouywxY]$')"


def _endings(rules, least: int) -> str:
    """A CASE over ``(suffix, replacement)``: the first suffix that fits decides."""
    lines = []
    for suf, rep in rules:
        stem = f"left(w, -{len(suf)})"
        more = f" AND regexp_matches({stem}, '[st]$')" if suf == "ion" else ""
        lines.append(f"WHEN w LIKE '%{suf}' THEN CASE WHEN {_measure(stem)} > {least}{more} THEN {stem} || '{rep}' ELSE w END")
    return "CASE " + "\n      ".join(lines) + " ELSE w END"


def sql_stems(source: str) -> str:
    """CTEs ending in ``stems(word, term)`` for the distinct terms of ``source``."""
    return rf"""
  s0 AS (
    SELECT term AS word, regexp_replace(regexp_replace(term, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g') AS w
    FROM (SELECT DISTINCT term FROM {source})),
  s1a AS (
    SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss'
      THEN left(w, -1) ELSE w END AS w FROM s0),
  s1b AS (
    SELECT word, w, CASE WHEN w LIKE '%eed' THEN NULL
      WHEN w LIKE '%ed' AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -2)
      WHEN w LIKE '%ing' AND regexp_matches(left(w, -3), '[aeiouy]') THEN left(w, -3) END AS x FROM s1a),
  s1b_mended AS (
    SELECT word, CASE WHEN w LIKE '%eed' AND {_measure("left(w, -3)")} > 0 THEN left(w, -1)
      WHEN x IS NULL THEN w
      WHEN x LIKE '%at' OR x LIKE '%bl' OR x LIKE '%iz' THEN x || 'e'
      WHEN length(x) >= 2 AND lower(right(x, 1)) = lower(left(right(x, 2), 1)) AND right(x, 1) NOT IN
        ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN left(x, -1)
      WHEN {_measure("x")} = 1 AND {_cvc("x")} THEN x || 'e' ELSE x END AS w FROM s1b),
  s1c AS (
    SELECT word, CASE WHEN lower(right(w, 1)) = 'y' AND regexp_matches(left(w, -1), '[aeiouy]')
      THEN left(w, -1) || 'i' ELSE w END AS w FROM s1b_mended),
  s2 AS (SELECT word, {_endings(STEP2_RULES, 0)} AS w FROM s1c),
  s3 AS (SELECT word, {_endings(STEP3_RULES, 0)} AS w FROM s2),
  s4 AS (SELECT word, {_endings([(s, "") for s in STEP4_SUFFIXES], 1)} AS w FROM s3),
  s5a AS (
    SELECT word, CASE WHEN w LIKE '%e' AND ({_measure("left(w, -1)")} > 1 OR
      {_measure("left(w, -1)")} = 1 AND NOT {_cvc("left(w, -1)")}) THEN left(w, -1) ELSE w END AS w FROM s4),
  s5b AS (
    SELECT word, CASE WHEN w LIKE '%ll' AND {_measure("w")} > 1 THEN left(w, -1) ELSE w END AS w FROM s5a),
  stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE replace(w, 'Y', 'y') END AS term FROM s5b)"""


def _stemmed(source: str) -> str:
    return f"""
  stemmed AS (
    SELECT doc_id, stems.term, sum(tf)::BIGINT AS tf FROM {source} JOIN stems ON stems.word = {source}.term GROUP BY ALL)"""


_STEMMED_ROWS = """
SELECT doc_id, term, tf, max(tf) OVER (PARTITION BY doc_id) AS max_tf FROM stemmed"""


# ----------------------------------------------------------------- the queries
@register("a1_a2_words_tokenizer", _with(SQL_WORDS) + """
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM words GROUP BY term""")
def q_words(spark, sf_dir):
    """A1 ``words`` mode + A2 possessive: Unicode's word boundaries."""
    return T.corpus_stats(T.term_freqs(documents(spark, sf_dir), mode="words"))


@register("a5_a6_stemmed_term_freqs", _with(SQL_TERMS, sql_stems("postings"), _stemmed("postings")) + _STEMMED_ROWS)
def q_stemmed(spark, sf_dir):
    """A5: Porter stems of plain tokens (distinct words stemmed once, joined back, re-counted)."""
    return T.term_freqs(documents(spark, sf_dir), stem=True)


@register("a6_default_analysis", _with(SQL_WORDS, sql_stems("words"), _stemmed("words")) + _STEMMED_ROWS)
def q_default_analysis(spark, sf_dir):
    """The reference's analysis (``TermVectConfig()``) of all documents, as an index stores it."""
    return postings(documents(spark, sf_dir), TermVectConfig())


@register("w9_tfidf_default_analysis", _with(SQL_WORDS, sql_stems("words"), _stemmed("words")) + """,
  stats AS (SELECT term, count(*) AS df FROM stemmed GROUP BY term),
  vocab AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM stats WHERE df >= 2)
SELECT doc_id, term_id, term, round(sqrt(tf) * (1.0 + ln(n_docs / (df + 1.0))), 6) + 0.0 AS w
FROM stemmed JOIN vocab USING (term) CROSS JOIN (SELECT count(*)::DOUBLE AS n_docs FROM documents)""")
def q_default_tfidf(spark, sf_dir):
    """A1-A6, T, F, W9: tf-idf of all documents with the reference's defaults throughout."""
    from .registered import r6
    from .termvect import term_vectors
    w = term_vectors(documents(spark, sf_dir), TermVectConfig()).weights
    return w.withColumn("w", r6("w"))

"""Text analysis as Catalyst expressions.

Everything here returns a ``Column`` so tokenising, lower-casing and
stop-word removal run JVM-side inside the scan's codegen stage; no Python
touches the text.  Stemming (A5) has its own rules, in
:mod:`corpusmap.functions.stem`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the default English stop-word set (33 words) -----------------
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# --- fixed values: longest token the reference's analyzer keeps (``max_length``; off by default)
MAX_TOKEN_LENGTH = 255

# --- fixed values: word-break classes of Unicode's text segmentation (UAX #29) by category, script and
# the characters that join words; text outside every class separates
WORD_CLASSES = {
    "extend": r"[\p{M}\p{Cf}\x{FF9E}\x{FF9F}&&[^\x{200B}]]",  # Extend, Format, ZWJ
    "ideograph": r"[\p{IsHan}\p{IsHiragana}&&[^\p{M}]]",
    "katakana": r"[\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}]",
    "complex": r"[\p{L}&&[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]",  # line-break class SA
    "hebrew": r"[\p{L}&&[\p{IsHebrew}]]",
    "numeric": r"[\p{Nd}\x{066B}]",
    "joiner": r"[\p{Pc}\x{202F}]",  # ExtendNumLet
    "mid_letter": r"[:\x{00B7}\x{0387}\x{055F}\x{05F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}'.\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}]",
    "mid_number": r"[,;\x{037E}\x{0589}\x{060C}\x{060D}\x{066C}\x{07F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}'.\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}]",
}
WORD_CLASSES["letter"] = (r"[\p{L}\p{Nl}\x{24B6}-\x{24E9}&&[^\x{FF9E}\x{FF9F}"
                          + "".join(WORD_CLASSES[c] for c in ("ideograph", "katakana", "complex", "hebrew")) + "]]")


def word_pattern(c: dict) -> str:
    """The boundary rules as one regular expression over the classes ``c`` (name -> character class).

    Letters and digits stick together, also across one joining mark between two letters or two
    digits and across connectors (``_``); a Hebrew letter keeps a quote; Katakana runs, runs of
    scripts without spaces and single ideographs are words.  Marks belong to what they follow.  No rule looks
    around, and what a loop takes is never given back, so long words need no stack.
    """
    x = c["extend"] + "*+"

    def run(name: str) -> str:
        return f"{c[name]}[{c[name]}{c['extend']}]*+"

    hebrew = f"{c['hebrew']}{x}(?:\"{x}{c['hebrew']}{x})*+(?:'{x})?+"
    letters = f"(?:{run('letter')}|{hebrew})++"
    letters += f"(?:{c['mid_letter']}{x}{letters})*+"
    digits = f"{run('numeric')}(?:{c['mid_number']}{x}{run('numeric')})*+"
    core = f"(?:(?:{letters}|{digits})++|{run('katakana')})"
    join = run("joiner")
    return (f"(?:{join})?+{core}(?:{join}{core})*+(?:{join})?+|{run('complex')}|{c['ideograph']}{x}")


# Tokenizer patterns.  ``simple`` is portable (Java regex and RE2 agree on it);
# ``words`` cuts at Unicode's word boundaries; runs of ASCII letters before a space, and spaces, which
# are most of many texts, are settled first (the same words by the rules, without their long classes).
TOKEN_PATTERNS = {"simple": r"[\p{L}\p{N}_]+",
                  "words": rf"[A-Za-z]++(?=[ \n])|(?![ \n])(?:{word_pattern(WORD_CLASSES)})"}
POSSESSIVE_PATTERN = r"['’＇][sS]$"


def tokenize(text: Column | str, mode: str = "simple", max_length: int | None = None) -> Column:
    """A1: array of tokens in text order; with ``max_length``, longer tokens are dropped."""
    if mode not in TOKEN_PATTERNS:
        raise ValueError(f"unknown tokenizer mode {mode!r}; expected one of {sorted(TOKEN_PATTERNS)}")
    col = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN_PATTERNS[mode]), 0)
    return toks if max_length is None else F.filter(toks, lambda t: F.length(t) <= int(max_length))


def strip_possessive(tok: Column) -> Column:
    """A2: drop a trailing 's / ’s (either case of s)."""
    return F.when(tok.endswith("s") | tok.endswith("S"), F.regexp_replace(tok, POSSESSIVE_PATTERN, "")).otherwise(tok)


def analyze_tokens(text: Column | str, mode: str = "simple", possessive: bool = True,
                   lowercase: bool = True, stop_words=ENGLISH_STOP_WORDS, max_length: int | None = None) -> Column:
    """A1∘A2∘A3∘A4 as one array expression: tokens -> possessive -> lower -> stop filter.

    Order matters (possessive before lower-case, stop words after lower-case).
    Stemming, when wanted, is applied to the distinct surviving words by
    :func:`corpusmap.operators.terms.term_freqs`.
    """
    toks = tokenize(text, mode, max_length)
    if possessive and mode != "simple":
        # ``simple`` tokens never contain an apostrophe, so the rule is a no-op there.
        toks = F.transform(toks, strip_possessive)
    if lowercase:
        toks = F.transform(toks, F.lower)
    stops = list(stop_words or ())
    if stops:
        toks = F.filter(toks, lambda t: ~t.isin(stops))
    return F.filter(toks, lambda t: F.length(t) > 0)


def run_ends(sorted_tokens: Column) -> Column:
    """1-based positions where a run of equal neighbours ends in a sorted array."""
    s = sorted_tokens
    n = F.size(s)
    return F.filter(
        F.transform(s, lambda x, i: F.when((i + 1 == n) | (x != F.get(s, i + 1)), i + 1).otherwise(0)),
        lambda e: e > 0,
    )


def run_counts(sorted_tokens: Column, ends: Column) -> Column:
    """array<struct<term, tf>> from a sorted array and its run ends.

    T1 computed inside one row (a document is one row), so term frequencies
    need no shuffle.  ``ends`` must be a materialised column (not an inline
    expression) so it is evaluated once per row, not once per element.
    """
    return F.transform(
        ends,
        lambda e, i: F.struct(
            F.get(sorted_tokens, e - 1).alias("term"),
            (e - F.coalesce(F.get(ends, i - 1), F.lit(0))).cast("long").alias("tf"),
        ),
    )

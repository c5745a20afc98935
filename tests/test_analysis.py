"""Unicode words and Porter stems: fixed cases, brute force, and the SQL form on texts that the test tables lack."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmap.functions.stem import STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES, porter_stem
from corpusmap.functions.text import tokenize
from corpusmap.plans.registered import QUERIES, SQL
from tests.porter import porter_stem as brute

WORDS = {  # text -> words by Unicode's boundary rules
    "can't O’Neil's U.S.A. foo:bar x·y": ["can't", "O’Neil's", "U.S.A", "foo:bar", "x·y"],
    "3,500.25 1;2 x.1 1.x a1.b2 1a.b2 1,a": ["3,500.25", "1;2", "x", "1", "1", "x", "a1", "b2", "1a.b2", "1", "a"],
    "a_b _x_ __ 1_000 a b": ["a_b", "_x_", "1_000", "a b"],
    "東京 ひら カタカナー語 カ_a aカ": ["東", "京", "ひ", "ら", "カタカナー", "語", "カ_a", "a", "カ"],
    "אב\"ג ד' א\"": ["אב\"ג", "ד'", "א"],
    "สวัสดี ครับ": ["สวัสดี", "ครับ"],
    "été co­op a‍b a​b ́x": ["été", "co­op", "a‍b", "a", "b", "x"],
    "٣٤٫٥ Ⅻ ⓐⓑ ½ €5": ["٣٤٫٥", "Ⅻ", "ⓐⓑ", "5"],
    "a..b 'a' a'': b": ["a", "b", "a", "a", "b"],
    "ab cd\nef\tgh ij.": ["ab", "cd", "ef", "gh", "ij"],
    "": [],
}


def test_words(spark):
    df = spark.createDataFrame([(t,) for t in WORDS], "text string")
    got = {r.text: r.w for r in df.select("text", tokenize("text", "words").alias("w")).collect()}
    assert got == WORDS


@pytest.mark.parametrize("text,n", [("x" * 300_000 + " y", 2), ("a.b" * 100_000, 1), ("1_a" * 100_000, 1),
                                    ("א\"" * 100_000 + "א", 1), ("a'" * 100_000, 1)])
def test_very_long_words(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(F.size(tokenize("text", "words"))).first()[0] == n


def test_stems_against_brute_force(spark):
    r = random.Random(5)
    endings = ["s", "es", "ies", "sses", "eed", "ed", "ing", "y", "yy", "e", "ll", *STEP4_SUFFIXES,
               *(s for s, _ in STEP2_RULES + STEP3_RULES)]
    words = {"".join(r.choices("aeiouybcdlstzwxé東", k=r.randint(0, 5))) + "".join(r.choices(endings, k=r.randint(0, 3)))
             for _ in range(20_000)}
    words |= {"".join(p) for n in range(5) for p in itertools.product("aeyblsz", repeat=n)}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "w string").repartition(8)
    got = {r.w: r.s for r in df.select("w", porter_stem("w").alias("s")).collect()}
    assert got.pop(None) is None
    assert got == {w: brute(w) for w in words}


@pytest.mark.parametrize("name", ["a1_a2_words_tokenizer", "a6_default_analysis"])
def test_sql_on_other_scripts(spark, tmp_dir, name):
    texts = [*WORDS, None, "The hoppings of generalizations' AGREED", "the and of"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    got = QUERIES[name](spark, tmp_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) > 20

"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmap.llm import ranked

from .test_operators import REPEATED, odd, table, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, _), b in zip(docs, bags):
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
                        for t in terms(text) if b[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return Counter(out)


def items_table(spark, rows):
    full = [(i, t, "x", None) for i, t in rows]
    return spark.createDataFrame(full, "item_id long, text string, q string, rank string")


ITEMS = [(1, "abe Cde ab"), (2, None), (3, ""), (3, "no such words at all, une"), (None, "one, ONE two"), (7, "same row again é"), (8, "...")]


@pytest.mark.parametrize("tree,bucket,columns", [(4096, 24, 2048), (512, 1, 3), (512, 4, 40)])
def test_search(spark, monkeypatch, tree, bucket, columns):
    monkeypatch.setattr(ranked, "TREE_DOCS", tree)
    monkeypatch.setattr(ranked, "BUCKET", bucket)
    monkeypatch.setattr(ranked, "COLUMNS", columns)
    docs = odd(n=300, vocabulary=60) + REPEATED + [(500, "ONE " * 40_000 + "two"), (501, "One\0two\x1fone é É")]
    items = ITEMS + [(20 + i, t) for i, t in enumerate(texts(0, 12, 60, 10))]
    for k in (1, 5, 20):
        got = ranked.search(table(spark, docs), items_table(spark, items), k=k, block_chars=100)
        assert got.columns == ["item_id", "rank", "id", "score"]
        assert Counter(map(tuple, got.collect())) == brute(docs, items, k)


def test_empty_tables(spark):
    assert ranked.search(table(spark, []), items_table(spark, ITEMS)).count() == 0
    assert ranked.search(table(spark, odd()), items_table(spark, [])).count() == 0
    assert ranked.search(table(spark, [(1, None), (2, "")]), items_table(spark, ITEMS)).count() == 0


def test_bounds_hold_and_prune():
    """Every node's bound is at least its documents' scores, and a walk leaves nodes out without losing a result."""
    rnd = np.random.default_rng(3)
    n, width = 3000, 60
    tf = (rnd.random((n, width)) < 1 / (1 + np.arange(width))) * rnd.integers(1, 9, (n, width))
    size = (tf > 0).sum(axis=1)
    m = rnd.integers(75, 400, n)
    tree = ranked.Tree(np.arange(n), np.ones(n, bool), m, np.nonzero(tf)[1], tf[tf > 0], size)
    tree.columns(np.arange(width))
    columns, weight = np.array([3, 20, 41, 50]), np.array([100, 2000, 5000, 7000])
    for i, (a, z) in enumerate(tree.range):
        bound = ranked.part_scores(tree.most[i:i + 1, columns].astype(np.int64), tree.least[i:i + 1], weight)[0]
        assert bound >= ranked.part_scores(tree.tf[a:z][:, columns].astype(np.int64), tree.m[a:z], weight).max()
    held = ranked.Held(20)
    tree.search(columns, weight, held)
    score = ranked.part_scores(tf[:, columns].astype(np.int64), m, weight)
    best = sorted(range(n), key=lambda i: (-score[i], i))[:20]
    assert held.id.tolist() == best and held.score.tolist() == score[best].tolist()
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(n))
    assert 0 < held.nodes < len(tree.range)  # nodes that were opened

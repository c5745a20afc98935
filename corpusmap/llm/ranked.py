"""Ranked lexical search by branch and bound over trees of documents.

A first pass turns each document into its *restricted vector*: the terms that any search
item has, with their counts, and the document's length.  Corpus statistics come from these.
Then every task grows trees of its documents: a vector's terms, most frequent in the corpus
first, are a path from the root, so documents that begin with the same terms share it.  A
node knows the largest count of each term and the smallest length factor ``m`` below it,
which bound the score of every document there.  Each item walks a tree depth first, best
bound first, and leaves out the nodes whose bound is below its worst held result.  The
results of all trees of all tasks meet in one window, at most ``k`` for each item and task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.util import cut_lineage
from .common import picked, table
from .pieces import batches_of, distinct

#: Bytes of terms: digits, letters in lower case, and all of other alphabets; the others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TREE_DOCS = 4096      # documents in a tree
TREE_ENTRIES = 2_000_000  # and their terms, at most (but for one document)
BUCKET = 24           # a node of at most so many documents is scored at once
COLUMNS = 2048        # terms that a tree has counts for at once
SCALE, K1, FLAT, SLOPE = 1_000_000_000, 1000, 100, 25  # fixed values of the score


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(all terms and empty strings, how many of them each text has)``."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = memoryview(raw)[offsets[0]:offsets[-1]].tobytes().translate(TERM_BYTES) if raw is not None else b""
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data))
    parts = pc.split_pattern(spaced, " ")
    return parts.flatten(), np.diff(np.asarray(parts.offsets)).astype(np.int64)


def terms_of(text: str) -> list[str]:
    return [w for w in words(pa.array([text]))[0].to_pylist() if w]


def restricted(df: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text",
               batch_chars: int = 4_000_000) -> DataFrame:
    """``(id, n, terms array<int>, tfs array<int>)`` of every row: its number of terms, and those of ``vocabulary`` with their counts."""
    known = pa.array(vocabulary, pa.string())

    def job(batches):
        for b in batches:
            for part in batches_of(b, "text", batch_chars):
                found, count = words(part.column("text"))
                edges = np.concatenate([[0], np.cumsum(count)])
                n = np.diff(np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(found)) > 0)])[edges])
                code = np.asarray(pc.fill_null(pc.index_in(found, known), -1)).astype(np.int64)
                held = np.flatnonzero(code >= 0)
                doc = np.searchsorted(edges, held, "right") - 1
                keys, times, of = distinct(doc, code[held], len(part))
                lists = [pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), *lists], names=["id", "n", "terms", "tfs"])

    return picked(df, id_col, text_col).mapInArrow(job, "id long, n long, terms array<int>, tfs array<int>")


def part_scores(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of rows of counts ``tf`` (documents x terms) with length factors ``m``."""
    return ((SCALE * tf) // (K1 * tf + 12 * m[:, None]) * weight).sum(axis=1)


class Tree:
    """A tree of documents: ``terms`` are their terms by rank (most frequent first), one after the other."""

    def __init__(self, ids, has_id, m, terms, tfs, size):
        first = np.cumsum(size) - size
        paths = [terms[a:a + n] for a, n in zip(first.tolist(), size.tolist())]
        order = sorted(range(len(paths)), key=[p.astype(">u4").tobytes() for p in paths].__getitem__)
        paths = [paths[i] for i in order]
        self.ids, self.has_id, self.m = ids[order], has_id[order], m[order]
        self.rows = [(terms[first[i]:first[i] + size[i]], tfs[first[i]:first[i] + size[i]]) for i in order]
        shared = np.zeros(len(paths), np.int64)  # terms that a path shares with the one before
        for i in range(1, len(paths)):
            n = min(len(paths[i - 1]), len(paths[i]))
            differ = np.flatnonzero(paths[i - 1][:n] != paths[i][:n])
            shared[i] = differ[0] if len(differ) else n
        # nodes in the order they are met: (first document, last), children, documents of small children
        self.range, self.children, self.leaves = [(0, len(paths))], [], []
        i = 0
        while i < len(self.range):
            lo, hi = self.range[i]
            within = shared[lo + 1:hi]
            if hi - lo <= BUCKET or not len(within):
                self.children.append(range(0))
                self.leaves.append(np.arange(lo, hi))
            else:
                edges = [lo, *(lo + 1 + np.flatnonzero(within == within.min())).tolist(), hi]
                big, small = [], []
                for a, z in zip(edges[:-1], edges[1:]):
                    (big if z - a > BUCKET else small).append((a, z))
                self.children.append(range(len(self.range), len(self.range) + len(big)))
                self.range += big
                self.leaves.append(np.concatenate([np.arange(a, z) for a, z in small]) if small else np.zeros(0, np.int64))
            i += 1
        self.least = np.array([self.m[a:z].min() for a, z in self.range], np.int64)

    def columns(self, ranks: np.ndarray):
        """Counts of the terms ``ranks`` (ascending), and for each node the largest below it."""
        self.tf = np.zeros((len(self.ids), len(ranks)), np.int32)
        for i, (terms, tfs) in enumerate(self.rows):
            at = np.searchsorted(ranks, terms)
            good = at < len(ranks)
            good[good] = ranks[at[good]] == terms[good]
            self.tf[i, at[good]] = tfs[good]
        self.most = np.zeros((len(self.range), len(ranks)), np.int32)
        for i in range(len(self.range) - 1, -1, -1):
            if len(self.leaves[i]):
                self.most[i] = self.tf[self.leaves[i]].max(axis=0)
            if c := self.children[i]:
                self.most[i] = np.maximum(self.most[i], self.most[c.start:c.stop].max(axis=0))

    def search(self, columns: np.ndarray, weight: np.ndarray, held: "Held"):
        """Offer ``held`` every document that may be among its best; ``columns`` of the item's different terms."""
        todo = [(int(part_scores(self.most[:1, columns].astype(np.int64), self.least[:1], weight)[0]), 0)]
        while todo:
            bound, node = todo.pop()
            if bound < held.worst or bound <= 0:
                continue
            held.nodes += 1
            docs = self.leaves[node]
            if len(docs):
                held.offer(part_scores(self.tf[docs[:, None], columns].astype(np.int64), self.m[docs], weight), self.ids[docs], self.has_id[docs])
            c = self.children[node]
            if c:
                bounds = part_scores(self.most[c.start:c.stop, columns].astype(np.int64), self.least[c.start:c.stop], weight)
                by = np.argsort(bounds, kind="stable")  # the best comes out first
                todo += [(int(bounds[i]), c.start + int(i)) for i in by if bounds[i] >= held.worst]


class Held:
    """The ``k`` best documents of an item so far: highest score first, then smallest id, rows without one last."""

    def __init__(self, k: int):
        self.k, self.worst, self.nodes = k, 1, 0
        self.score, self.id, self.has = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score, ids, has):
        good = score >= self.worst
        if not good.any():
            return
        score, ids, has = (np.concatenate(x) for x in ((self.score, score[good]), (self.id, ids[good]), (self.has, has[good])))
        by = np.lexsort((ids, ~has, -score))[:self.k]
        self.score, self.id, self.has = score[by], ids[by], has[by]
        if len(by) == self.k:
            self.worst = int(self.score[-1])


def _groups(items, limit: int):
    """Items in groups of at most about ``limit`` different terms: ``(ranks, [(item, columns, weights)])``."""
    held, group = set(), []
    for q, ranks, weight in sorted(items, key=lambda x: x[1].tolist()):
        if group and len(held | set(ranks.tolist())) > limit:
            yield held, group
            held, group = set(), []
        held |= set(ranks.tolist())
        group.append((q, ranks, weight))
    if group:
        yield held, group


def best_in_tasks(vectors: DataFrame, items: list, rank_of: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(q, id, score)``: the ``k`` best documents of each task for each ``items`` entry ``(q, ranks, weights)``."""
    groups = []
    for held, group in _groups(items, COLUMNS):
        ranks = np.array(sorted(held), np.int64)
        groups.append((ranks, [(q, np.searchsorted(ranks, r), w) for q, r, w in group]))

    def job(batches):
        best = {q: Held(k) for q, _, _ in items}

        def use(parts):
            ids, has, n, terms, tfs, size = (np.concatenate(x) for x in zip(*parts))
            m = FLAT - SLOPE + (SLOPE * n * n_docs) // n_terms
            ranks = rank_of[terms]
            owner = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((ranks, owner))
            tree = Tree(ids, has, m, ranks[by], tfs[by], size)
            for ranks, group in groups:
                tree.columns(ranks)
                for q, columns, weight in group:
                    tree.search(columns, weight, best[q])

        parts, docs, entries = [], 0, 0
        for b in batches:
            for i in range(0, len(b), 512):
                p = b.slice(i, 512)
                terms, tfs = (np.asarray(p.column(c).flatten()).astype(np.int64) for c in ("terms", "tfs"))
                size = np.asarray(p.column("terms").value_lengths()).astype(np.int64)
                parts.append((np.asarray(pc.fill_null(p.column("id"), 0)), np.asarray(p.column("id").is_valid()),
                              np.asarray(p.column("n")), terms, tfs, size))
                docs, entries = docs + len(p), entries + len(terms)
                if docs + 512 > TREE_DOCS or entries > TREE_ENTRIES:
                    use(parts)
                    parts, docs, entries = [], 0, 0
        if parts:
            use(parts)
        for q, h in best.items():
            if len(h.score):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(h.score), pa.int64()), pa.array(h.id, pa.int64(), mask=~h.has),
                                                  pa.array(h.score, pa.int64())], names=["q", "id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(job, "q long, id long, score long")


def search(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """``(item_id, rank, id, score)``: the ``k`` best rows of ``df`` for each row of ``items``, with scores above 0.

    Null texts have no terms.  Equal scores come in ascending id, rows without an id last;
    repeated rows each have a place.  Items without an id or with a repeated one are searched
    for like any other; an empty table on either side gives an empty result.  Items are
    taken in blocks of about ``block_chars`` characters, each of which reads the documents.
    """
    spark = df.sparkSession
    asked = cut_lineage(picked(items, item_id_col, item_text_col).withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    out = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).select("q", "id", "text")
        found = [(r.q, terms_of(r.text)) for r in block.collect()]  # bounded by block_chars
        vocabulary = sorted({t for _, ts in found for t in ts})
        if not vocabulary:
            continue
        vectors = cut_lineage(restricted(df, vocabulary, id_col, text_col))
        n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_docs:
            continue
        df_of = np.zeros(len(vocabulary), np.int64)  # at most one row for each term of the block
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df_of[r["t"]] = r["count"]
        by = np.argsort(-df_of, kind="stable")
        rank_of = np.empty(len(by), np.int64)
        rank_of[by] = np.arange(len(by))
        place = {t: j for j, t in enumerate(vocabulary)}
        wanted = []
        for q, ts in found:
            codes, times = np.unique(np.array([place[t] for t in ts], np.int64), return_counts=True)
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df_of[c]) + 1))) for c in codes], np.int64) * times
            there = df_of[codes] > 0
            ranks, weight = rank_of[codes[there]], weight[there]
            at = np.argsort(ranks)
            if len(at):
                wanted.append((q, ranks[at], weight[at]))
        best = best_in_tasks(vectors, wanted, rank_of, n_docs, n_terms, k)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = block.select("q", F.col("id").alias("item_id"))  # as many rows as the block has items
        out = out.unionByName(top.join(F.broadcast(names), "q").select("item_id", "rank", "id", "score"))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for each item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_ranked_search": op11_ranked_search}
SQL = {
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
        asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(ts) AS t FROM i) GROUP BY item_id, t),
        corpus AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
        w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t, n_docs),
        m AS (SELECT doc_id, 100 - 25 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, corpus),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
        r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
              FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}

"""The pipeline's stages, each against brute force on its own input."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import decontam, toxicity
from corpusmap.plans.util import cut_lineage

from .test_operators import WORD, brute_components, edit_distance_in, water_fill

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    import public_tokenizers
    import xxhash
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "src1", None), (90002, "", "en", None, 0)], docs.schema)
    seen = [cut_lineage(docs.unionByName(extra).withColumn("row", F.lit("x")))]
    for _, stage in P.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], SF)))
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    assert all(s.columns == seen[0].columns for s in seen[:-1])
    rows = [s.collect() for s in seen]

    scores = toxicity.score_documents(seen[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in rows[1]) == Counter(r.id for r in scores if r.score < 0.5)

    fps = []
    for r in rows[1]:
        w = (r.text or "").encode().lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
        fps.append(sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h)))
    assert {r.doc_id for r in rows[2]} == set(brute_components([r.doc_id for r in rows[1]], fps, 3))

    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in rows[2]:  # pieces of an item are the quick test; the slow one only where they are found
        text = decontam.normalise(r.text or "")
        leak = any(edit_distance_in(x, text) <= int(len(x) * decontam.ERROR_RATE) for x in items
                   if len(x) >= decontam.MIN_CHARS and any(p in text for _, p in decontam.pieces(x, int(len(x) * decontam.ERROR_RATE))))
        assert (r in rows[3]) == (not leak)

    sizes, size = Counter(), {}
    for r in rows[3]:
        size[r.doc_id] = len(WORD.findall(r.text or ""))
        sizes[r.source] += size[r.doc_id]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    times, taken = Counter(r.doc_id for r in rows[4]), Counter()
    assert max(times.values()) <= 3 and set(times) <= set(size)
    for r in rows[3]:
        taken[r.source] += times[r.doc_id] * size[r.doc_id]
    for s, t in target.items():
        largest = max((size[r.doc_id] for r in rows[3] if r.source == s), default=0)
        assert abs(taken[s] - t) <= max(1, largest)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows[4]:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows[5]) == want

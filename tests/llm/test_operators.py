"""The training-data operators against brute force, on small tables with every odd case.

``odd`` rows: null and repeated ids, null, empty and long texts, repeated rows, and extra
columns named like the operators' own.
"""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import (components, decontam, exact, induced, mixing, secret_scan, simhash, sketch, substring, suffix, tokens,
                           toxicity, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("id", "row", "tag", "fp", "rid", "h", "block", "key", "u", "size", "uri", "k1", "starts", "runs", "score", "target")


def table(spark, rows, name="text"):
    """``rows``: (doc_id, text[, source]); extra columns with clashing names and nulls."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", None, *(("x", None)[i % 2] for i in range(len(CLASH)))) for r in rows]
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(full, f"doc_id long, {name} string, source string, n_chars long, {extra}").repartition(3)


def texts(seed, n, vocabulary, words):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, words))) for _ in range(n)]


def odd(seed=0, n=40, vocabulary=12, words=30):
    t = texts(seed, n, vocabulary, words)
    rows = [(i, x) for i, x in enumerate(t)]
    rows += [(100 + i, t[i % 7]) for i in range(20)]                      # copies
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, " ".join(t))]   # null, empty, blank, long
    return rows + [(204, t[0] + " " + t[0]), (205, "one")]


REPEATED = [(3, "same row again"), (3, "same row again"), (3, "other text, same id"), (None, "no id"), (None, "no id"), (None, None)]


# ----------------------------------------------------------------- exact dedup
def test_exact_dedup(spark):
    rows = odd() + REPEATED
    got = exact.exact_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for sha, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.id) for r in mine) == sorted(map(str, ids))
        assert all(r.keep_id == best and r.group_size == len(ids) for r in mine)
        assert [r.id for r in mine if r.kept] == [best]
    # a filter far too small changes nothing but the work
    tiny = exact.exact_dedup(table(spark, odd()), bits_per_row=1, max_filter_mb=1).drop("kept")
    assert sorted(map(tuple, tiny.collect())) == sorted(map(tuple, exact.exact_dedup(table(spark, odd())).drop("kept").collect()))
    whole = exact.exact_dedup(table(spark, odd()), carry=True).filter("kept").select("row.*")
    assert whole.columns == table(spark, []).columns and whole.count() == len({t or "" for _, t in odd()})


# ----------------------------------------------------------------- token files
@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokens.unpack(data, bits, 1001) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    strange = ["a  b", "a\n b", " x", "it's 'll", "a <|endoftext|> b", "3.14,5", "x\n", "a b c", "é,è.ü — b", "a\x00b", "a...b, .c", "a\x1c b"]
    rows = odd() + REPEATED + [(300 + i, t) for i, t in enumerate(strange)]
    out = tokens.token_files(table(spark, rows), path).collect()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.id for r in sorted(out, key=lambda r: r.start) if r.id is not None]
    assert known == sorted(known)
    reader = tokens.Reader(out[0].uri)  # any range, without the rest
    whole = reader.ids(0, reader.tokens)
    assert reader.bits == 16 and (reader.ids(3, 5) == whole[3:8]).all() and len(reader.ids(2, 0)) == 0


# ----------------------------------------------------------------- SimHash
def brute_components(ids, fps, bits):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for a in range(len(fps)):
        if ids[a] is not None:
            least[root(a)] = min(least.get(root(a), ids[a]), ids[a])
    return [least.get(root(a)) for a in range(len(fps))]


def test_simhash(spark):
    import xxhash

    rows = odd(vocabulary=200) + REPEATED + [(400 + i, odd(vocabulary=200)[i][1] + " X") for i in range(20)]
    got = simhash.simhash(table(spark, rows)).collect()
    fps = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    want = brute_components([i for i, _ in rows], fps, 3)
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((r[0], f, c) for r, f, c in zip(rows, fps, want))
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(want))


@pytest.mark.parametrize("part", [4, 4096])
def test_links_of_many_near_fingerprints(spark, part):
    rnd = random.Random(part)
    fps = []
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.links(df, 3, part)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 3 for r in links.collect())
    found = {r.node % (1 << 64): r.root for r in components.connected_components(links).collect()}
    want = brute_components(list(range(len(fps))), fps, 3)
    mine = {}
    for f, c in zip(fps, want):
        mine.setdefault(c, set()).add(found.get(f, f))
    assert all(len(x) == 1 for x in mine.values()) and len({next(iter(x)) for x in mine.values()}) == len(mine)


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components.connected_components(links).collect()} == {(i, 0) for i in range(301)}


# ----------------------------------------------------------------- suffix dedup
def test_induced_sorting(tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(induced, "BLOCK", 16)
    for trial in range(60):
        s = rng.integers(1, [2, 3, 5, 50][trial % 4] + 1, rng.integers(1, 160))
        s = np.tile(s[:9], 12) if trial % 5 == 0 else s
        t = np.append(s, 0).astype(np.uint16)
        order = induced.suffix_order(t, induced.Scratch(str(tmp_path), 256 if trial % 2 else 1 << 26))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert not list(tmp_path.iterdir()) or all(p.is_file() for p in tmp_path.iterdir())


@pytest.mark.parametrize("memory", [256, 1 << 26])
def test_induced_sorting_of_repeats(tmp_path, monkeypatch, memory):
    """Long equal stretches and runs; seeds that fit into memory cost two inductions, not four a level."""
    calls, induce = [], induced._induce
    monkeypatch.setattr(induced, "_induce", lambda *a: calls.append(1) or induce(*a))
    rng = np.random.default_rng(7)
    part = rng.integers(1, 4, 300)
    s = np.concatenate([part, np.repeat(2, 90), part, np.repeat(2, 97), part[:50], np.repeat(3, 40), part[:20]])
    t = np.append(s, 0).astype(np.uint16)
    order = induced.suffix_order(t, induced.Scratch(str(tmp_path), memory))
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert len(calls) == 2 or memory == 256
    for length in (1, 3, 4, 7, 8, 90, 301):
        ends = np.array([i for i in order if i + length <= len(t)])
        want = [t[i:i + length].tolist() == t[j:j + length].tolist() for i, j in zip(ends[:-1], ends[1:])]
        assert induced.same_prefix(t, ends[:-1], ends[1:], length).tolist() == want


@pytest.mark.parametrize("symbols", [4, 50_000])
def test_induced_sorting_in_little_memory(tmp_path, symbols):
    """A large text, past the scratch's memory share: nothing near a number for each seed, or each suffix of a symbol, stays in memory."""
    import tracemalloc

    rng = np.random.default_rng(symbols)
    n = 400_000
    t = np.append(rng.integers(1, symbols + 1, n), 0).astype(np.uint16)
    path = tmp_path / "text"
    t.tofile(path)
    text = np.memmap(path, np.uint16, "r")
    chunk, induced.CHUNK = induced.CHUNK, 1 << 14
    tracemalloc.start()
    try:
        order = induced.suffix_order(text, induced.Scratch(str(tmp_path), 1 << 19))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        induced.CHUNK = chunk
    assert isinstance(order, np.memmap) and (np.bincount(order, minlength=n + 1) == 1).all()
    assert sorted(map(str, tmp_path.iterdir())) == sorted([str(path), str(order.filename)])  # all else is freed
    rank = np.empty(n + 2, np.int64)  # a suffix is ordered by its first symbol, then by the suffix after it
    rank[order] = np.arange(n + 1)
    rank[n + 1] = -1
    a, b = order[:-1], order[1:]
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[a + 1] < rank[b + 1]))).all()
    assert most < 8_000_000, most


@pytest.mark.parametrize("memory", [512, 64 << 20])
def test_suffix_dedup(spark, memory):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abé" if i % 2 else "ab") for _ in range(rnd.randint(0, 40)))) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "abcdefgh" * 9), (53, "a" * 50), (54, rows[3][1]), (55, rows[3][1] + "zz"), (56, "qwertyuiop"),
             (57, "qwertyuiop"), (57, "qwertyuiop"), (57, "12345678"), (None, "xxyyzzxxyyzz11"), (None, "xxyyzzxxyyzz11")]
    got = suffix.suffix_dedup(table(spark, rows), length=8, memory=memory).collect()
    seen = Counter(t.encode()[a:a + 8] for _, t in rows if t for a in range(len(t.encode()) - 7))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - 7):
            if seen[b[a:a + 8]] > 1:
                gone[a:a + 8] = [True] * 8
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)] += 1
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == want


# ----------------------------------------------------------------- secrets
def test_secret_scan(spark):
    rnd = random.Random(5)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(i, f'é text token = "{"%040x" % rnd.getrandbits(160)}" and more ordinary words of text') for i in range(30)]
    rows += [(100 + i, "ſecret: abcdefgh API_KEY=short apikey:'longenough1' " + t) for i, t in enumerate(texts(1, 20, 50, 40))]
    rows += [(200, "AKIA" + "A1" * 8), (201, "AKIA1"), (202, "f" * 23), (203, "0" * 24), (204, f"see {key} there"), (205, None), (206, "")]
    rows += [(207, "internationalization_of_identifiers"), (None, "token=abcdef"), (None, "token=abcdef")]
    df = table(spark, rows)
    known = secret_scan.labelled_samples(table(spark, rows[:50]), "doc_id", "text", 1000)
    got = secret_scan.scan(df, secret_scan.train(known)).collect()
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for i, t in rows:
        t = t or ""
        f = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        f += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        f += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(f))
        want[(i, *(sum(k == x for _, k, _ in f) for x in range(3)), hashlib.sha256(said.encode()).hexdigest())] += 1
    assert Counter((r.id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    spans = {r.id: r.spans for r in got}
    assert spans[204] == "markov:4:44" and spans[207] == "" and spans[205] == ""


# ----------------------------------------------------------------- decontamination
def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(2)
    for _ in range(60):
        p, t = ("".join(rnd.choice("abc") for _ in range(n)) for n in (rnd.randint(1, 80), rnd.randint(0, 120)))
        assert decontam.myers(p, t)[0] == edit_distance_in(p, t)


def test_decontamination(spark):
    rnd = random.Random(7)
    items = [(i, " ".join(x.split()[:40])) for i, x in enumerate(texts(9, 12, 400, 60)) if len(x) > 80]
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (900, None), (901, ""), (902, "short"), (None, "no id here at all, of some length, for sure"), items[0]]],
                                  "item_id long, text string, id string")
    noise = texts(11, 60, 400, 60)
    rows = [(i, t) for i, t in enumerate(noise)]
    for n, (i, t) in enumerate(items):
        edited = list(t)
        for _ in range(len(t) // 20):
            edited[rnd.randrange(len(edited))] = rnd.choice("xyz")
        rows += [(1000 + n, noise[n] + " " + t.upper().replace(" ", ",  ") + " " + noise[n + 1]), (2000 + n, noise[n] + " " + "".join(edited))]
    rows += [(3000, None), (3001, ""), (None, items[1][1]), (3002, items[2][1]), (3002, items[2][1])]
    got = Counter((r.id, r.item_id, r.distance) for r in decontam.contaminated(table(spark, rows), bench).collect())
    want = Counter()
    for i, t in rows:
        for n, x in items:
            x = decontam.normalise(x)
            d = edit_distance_in(x, decontam.normalise(t or ""))
            if d <= int(len(x) * decontam.ERROR_RATE):
                want[(i, n, d)] += 1
    assert got == want and len(want) >= 2 * len(items)
    blocks = decontam.contaminated(table(spark, rows), bench, block_chars=300)  # several passes give the same
    assert Counter((r.id, r.item_id, r.distance) for r in blocks.collect()) == want


def test_decontamination_of_short_and_nameless_items(spark):
    """Items below MIN_CHARS as whole words, items without an id; empty ones are all that is left out."""
    nameless = "no id here at all, of some length, for sure"
    bench = spark.createDataFrame([(1, "What is 12*7?"), (1, "what is 12 7"), (2, "Oslo"), (None, nameless), (None, "x + y"), (4, "?!"), (5, None)],
                                  "item_id long, text string")
    rows = [(10, "What is 12*7?"), (11, "he asks: what is 12 * 7, and more"), (12, "what is 12 70"), (13, "somewhat is 12 7"), (14, "OSLO"),
            (15, "oslo, oslo"), (16, "oslos"), (17, "in " + nameless.replace("sure", "sura")), (18, "x+y"), (19, "?!"), (20, None), (21, "")]
    want = Counter([(10, 1, 0, 0, 12), (11, 1, 0, 8, 20), (14, 2, 0, 0, 4), (15, 2, 0, 0, 4), (17, None, 1), (18, None, 0, 0, 3)])
    for block_chars in (16_000_000, 20):
        got = decontam.contaminated(table(spark, rows), bench, block_chars=block_chars).collect()
        assert Counter(tuple(r) if r.id != 17 else tuple(r)[:3] for r in got) == want


# ----------------------------------------------------------------- mixing
def water_fill(sizes, weights, total, epochs):
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else share[s] for s in sizes}
        capped |= over


def test_mixing(spark):
    rnd = random.Random(4)
    rows = []
    for s, n in (("a", 300), ("b", 20), ("é", 150), ("z", 40), (None, 60), ("Z", 3)):
        rows += [(len(rows) + i, " ".join(["w"] * rnd.randint(0, 60)), s) for i in range(n)]
    rows += [(9000, None, "a"), (9001, "", "z"), (None, "x y", "b"), (None, "x y", "b"), (9002, None, "only empty")]
    df = table(spark, rows)
    got = mixing.mix(df, mixing.repeating(5, 2, 1)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken == r.repeats * r.size <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(30, 0.02 * t), s
    again = mixing.mix(df.repartition(7), mixing.repeating(5, 2, 1)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    whole = mixing.mix(df, mixing.repeating(5, 2, 1), carry=True).select("row.*")
    assert whole.columns == df.columns and whole.count() == len(rows)


# ----------------------------------------------------------------- WARC
def test_warc(spark):
    rows = [(i, f"<p>{i % 5}é</p>") for i in range(30)] + [(40, None), (41, ""), (42, "x" * 100_000), (7, "<p>again</p>"), (7, "<p>again</p>"),
                                                           (None, "<p>1é</p>"), (None, "lone"), (None, "lone")]
    df = table(spark, rows, "html").withColumnRenamed("doc_id", "page_id").withColumn("url", F.concat(F.lit("http://x/a b\r\n"), F.col("page_id").cast("string")))
    got = warc.deduplicate_pages(df, payloads=True).collect()
    assert len(got) == len(rows)
    best = {}
    for i, t in rows:
        best.setdefault(t or "", []).append(i)
    for text, ids in best.items():
        top = max((i for i in ids if i is not None), default=None)
        mine = [r for r in got if r.payload_digest == warc.payload_digest(text.encode()) and r.payload_bytes == len(text.encode())]
        assert Counter(r.page_id for r in mine) == Counter(ids)
        first = [r for r in mine if r.record_type == "response"]
        assert len(first) == 1 and first[0].page_id == top and first[0].payload == text and first[0].refers_to is None
        assert all(r.refers_to == top and r.payload is None for r in mine if r.record_type == "revisit")
    small = warc.deduplicate_pages(df, min_bytes=10_000).collect()
    assert all(r.record_type == "response" for r in small)


# ----------------------------------------------------------------- substring dedup
def test_substring_dedup(spark):
    rows = odd(vocabulary=6, words=25) + [(300, "p q r s t p q r s t p q r s t"), (301, "p q r s t"), (None, "p q r s t"), (None, "u v w x y z")]
    rows += [(302, "l m n o"), (302, "l m n o"), (302, "k k k k k k")]
    got = substring.substring_dedup(table(spark, rows), window=4).collect()

    def order(r):  # null ids first; rows that share an id are ordered, repeated rows are one document
        return (r[0] is not None, r[0] or 0, tag[r])
    tags = spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()
    tag = {r: next(x.h for x in tags if x.t == (r[1] or "")) for r in rows}
    first = {}
    for r in sorted(set(rows), key=order):
        w = WORD.findall(r[1] or "")
        for a in range(len(w) - 3):
            first.setdefault(tuple(w[a:a + 4]), (r, a))
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for a in range(len(w) - 3):
            if first[tuple(w[a:a + 4])] != (r, a):
                gone[a:a + 4] = [True] * 4
        left = " ".join(x for x, g in zip(w, gone) if not g)
        want[(r[0], len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest(), left)] += 1
    assert Counter(map(tuple, got)) == want


def test_sketch_loses_no_repeat():
    rng = np.random.default_rng(0)
    keys = sketch.mix(rng.integers(0, 4000, 6000).astype(np.uint64) + np.uint64(1))
    c = sketch.Counter(1 << 13)
    for a in range(0, 6000, 700):
        c.add(keys[a:a + 700])
    r = sketch.Repeated(1 << 13, [(i, two) for i, _, two in c.chunks()])
    u, n = np.unique(keys, return_counts=True)
    assert r(u[n > 1]).all() and r(u[n == 1]).mean() < 0.5


# ----------------------------------------------------------------- toxicity
def test_toxicity(spark):
    rnd = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["Idiot,", "scum", "moron!"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad), "x"))
    rows += [(5000, None), (5001, ""), (None, "scum"), (7, rows[7][1])]
    lab = spark.createDataFrame(labels + [(None, 1, "x"), (2, None, "x"), (0, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(table(spark, rows), lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.id is not None and r.id < 1500 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got if r.id is not None)
    assert np.mean([r.predicted == (r.id % 8 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.id in (5000, 5001))
    none = toxicity.score_documents(table(spark, rows[:5]), lab.filter("toxic = 0")).collect()  # nothing to learn from
    assert all(r.score == 0 for r in none)


# ----------------------------------------------------------------- empty tables
def test_empty_tables(spark):
    empty = table(spark, [])
    import public_tokenizers
    assert exact.exact_dedup(empty).count() == 0
    assert tokens.token_files(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert simhash.simhash(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert suffix.suffix_dedup(empty).count() == 0 and substring.substring_dedup(empty).count() == 0
    assert secret_scan.scan(empty, secret_scan.train(secret_scan.labelled_samples(empty, "doc_id", "text", 10))).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(empty, none).count() == 0
    assert decontam.contaminated(table(spark, odd()), none).count() == 0
    assert mixing.mix(empty, mixing.repeating(5, 2, 1)).count() == 0
    assert warc.deduplicate_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert toxicity.score_documents(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_errors_rise(spark, monkeypatch):
    """Only missing labels give a score of 0; errors of the training don't."""
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(20)], "doc_id long, text string")
    none, some = (spark.createDataFrame([(i, int(i < n)) for i in range(20)], "doc_id long, toxic int") for n in (0, 10))

    def broken(*a, **k):
        raise ValueError("broken")
    monkeypatch.setattr(toxicity, "train", broken)
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    with pytest.raises(ValueError, match="broken"):
        toxicity.score_documents(docs, some)


def test_secrets_beside_base_spans(spark):
    """A run is cut at the base spans; what is left of it is scored."""
    rnd = random.Random(5)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    access = "AKIA" + "Q7" * 8
    plain = [(i, f'text token = "{"%040x" % rnd.getrandbits(160)}" and more ordinary words of text') for i in range(30)]
    known = secret_scan.labelled_samples(table(spark, plain), "doc_id", "text", 1000)
    rows = [(1, f"{access}/{key}"), (2, f"{key}/{access}"), (3, f"{access}/{key[:9]}"), (4, f"{key}/{access}/{key}")]
    got = {r.id: r.spans for r in secret_scan.scan(table(spark, rows), secret_scan.train(known)).collect()}
    assert got == {1: "access:0:20,markov:20:61", 2: "markov:0:41,access:41:61", 3: "access:0:20",
                   4: "markov:0:41,access:41:61,markov:61:102"}


def test_warc_headers_are_fresh(spark, tmp_path):
    import gzip

    rows = [(i, f"<p>{i % 3}</p>") for i in range(12)] + [(40, None), (None, "lone")]
    df = table(spark, rows, "html").withColumnRenamed("doc_id", "page_id").withColumn("url", F.concat(F.lit("http://x/"), F.col("page_id").cast("string")))
    warc.deduplicate_pages(df, folder=str(tmp_path)).count()
    found = {}
    for kind in ("raw", "pages"):
        found[kind] = []
        for path in sorted(tmp_path.glob(f"{kind}-*.gz")):
            with gzip.open(path) as stream:
                while r := warc._parse(stream):
                    found[kind].append(r)
    old, new = ([r["WARC-Record-ID"] for r in found[k]] for k in ("raw", "pages"))
    assert len(set(old + new)) == 2 * len(rows)
    assert {r["WARC-Date"] for r in found["pages"]}.isdisjoint(r["WARC-Date"] for r in found["raw"])
    by_id = {r["WARC-Record-ID"]: r for r in found["pages"]}
    for a, b in zip(found["raw"], found["pages"]):
        assert a.get("X-Page-Id") == b.get("X-Page-Id") and a.get("WARC-Target-URI") == b.get("WARC-Target-URI")
        if b["WARC-Type"] == "response":
            assert a["block"] == b["block"] and "WARC-Refers-To" not in b
        else:
            first = by_id[b["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == b["WARC-Payload-Digest"]
            assert (b["WARC-Refers-To-Target-URI"], b["WARC-Refers-To-Date"]) == (first["WARC-Target-URI"], first["WARC-Date"])
    assert sum(r["WARC-Type"] == "revisit" for r in found["pages"]) == 9

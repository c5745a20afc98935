"""SentencePiece encoding and token alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmap.llm import alignment, lookup, pieces, sentencepieces

from .test_operators import REPEATED, odd, table

ALPHABET = [" ", "  ", "▁", "\n", "\t", "a", "b", "the", "ing", "tion", "é", "ñ", "中", "文", "한", "🎉", "\0", "　", "\x1c", "'", ".",
            ",", "1", "23", "<s>", "<0x0A>", "<|endoftext|>", "e", "s", " x", "‍", "\x85", "\n\n"]


def noise(seed, n, longest=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(paths):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=paths[1])


def test_pieces_join_to_the_texts():
    texts = noise(1, 2000) + [" ", "", "\0", "a b", " a  b "]
    names, codes, counts = pieces.cut(pa.array(texts))
    at = np.cumsum(counts) - counts
    assert ["".join(names[c] for c in codes[a:a + n]) for a, n in zip(at, counts)] == texts
    assert len(set(names)) == len(names)


def test_encoder_is_the_librarys(paths, library):
    encoder = sentencepieces.TextEncoder(paths[1], limit=500)
    model = encoder.encoder.model
    rnd = random.Random(2)
    words = [p.replace("▁", " ") for p, k in zip(model.pieces, model.kinds) if k == sentencepieces.NORMAL]
    texts = noise(3, 4000) + ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += [" " * n + "x" + "\n" * n for n in range(70)] + ["aaaa" * 5000, "ab" * 3000, " " * 100_001, "the " * 40_000]
    want = library.encode(texts)
    for i in range(0, len(texts), 700):
        ids, count = encoder.encode(pa.array(texts[i:i + 700]))
        got = np.split(ids, np.cumsum(count)[:-1])
        assert [g.tolist() for g in got] == want[i:i + 700]
    assert [sentencepieces.decode_ids(model, x) for x in want] == [library.decode(x) for x in want]
    anything = [[rnd.randint(0, 700) if rnd.random() < 0.8 else rnd.randint(0, 31999) for _ in range(rnd.randint(0, 12))] for _ in range(4000)]
    assert [sentencepieces.decode_ids(model, x) for x in anything] == [library.decode(x) for x in anything]


def test_backtracking_steps_back(paths):
    """Tokens are those of merging pair by pair, on random vocabularies where the longest match is often wrong."""
    for seed in range(30):
        rnd = random.Random(seed)
        model = sentencepieces.Model.__new__(sentencepieces.Model)
        made = ["a", "b", "c", "▁"]
        while len(made) < 40:
            x = rnd.choice(made) + rnd.choice(made)
            if x not in made and len(x) < 9:
                made.append(x)
        model.pieces, model.kinds, model.prefix = made, [sentencepieces.NORMAL] * len(made), True
        model.scores, model.size, model.bytes = [-float(i) for i in range(len(made))], len(made), {}
        encoder = sentencepieces.Encoder(model)
        for _ in range(200):
            s = "".join(rnd.choice("abc▁") for _ in range(rnd.randint(1, 40)))
            assert [made[t] for t in encoder.encode(s)] == encoder.merged(s)


def test_encode_decode_tables(spark, paths, library):
    rows = odd() + REPEATED + [(300 + i, t) for i, t in enumerate(noise(4, 50))] + [(400, "x" * 150_000), (401, "long text " * 20_000)]
    got = sentencepieces.decode(sentencepieces.encode(table(spark, rows), paths[1], batch_chars=500), paths[1], batch_ids=100).collect()
    want = [(i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows]
    assert Counter((r.id, tuple(r.ids), r.decoded) for r in got) == Counter(want)
    assert sentencepieces.decode(sentencepieces.encode(table(spark, []), paths[1]), paths[1]).count() == 0


# ----------------------------------------------------------------- alignment
def brute(texts, paths, library):
    """Per text ``(a, b, groups, links)`` byte by byte; None without tokens."""
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(paths[0])
    a_tok.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    out = []
    for t in texts:
        a = a_tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = library.encode(t or "")
        ab = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(ab) != raw or b"".join(bb) != raw:
            out.append(None)
            continue
        owner = [[i for i, x in enumerate(side) for _ in x] for side in (ab, bb)]
        links = sorted(set(zip(*owner)))
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (ab, bb)]
        groups, i, j = [], 0, 0
        ea, eb = ([int(x) for x in np.cumsum([len(y) for y in side])] for side in (ab, bb))
        for p in sorted(ends[0] & ends[1]):
            x, y = ea.index(p) + 1, eb.index(p) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        out.append((a, b, groups, [(a[x], b[y]) for x, y in links]))
    return out


def expected(rows, paths, library):
    found = brute([t for _, t in rows], paths, library)
    holds = Counter(p for f in found if f for p in set(f[3]))
    top = {}
    for (a, _), n in holds.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links = f
            out.append((i, len(a), len(b), len(g), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links),
                        hashlib.sha256(";".join(g).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk", [7, 60, 32_768])
def test_alignment(spark, paths, library, chunk, monkeypatch):
    rows = odd(n=12) + REPEATED + [(300 + i, t) for i, t in enumerate(noise(5, 80))]
    rows += [(400, "x" * 700), (401, "ab中文" * 60), (402, "long text, " * 80), (403, "a▁" * 30), (404, "中" * 40 + "▁" + "é " * 40)]
    monkeypatch.setattr(lookup, "FILE_ROWS", 500)
    aligned = alignment.align(table(spark, rows), *paths, chunk_chars=chunk, batch_chars=2000)
    got = alignment.scored(aligned, *paths)
    assert got.columns == alignment.SCORED
    assert Counter(map(tuple, got.collect())) == expected(rows, paths, library)


def test_alignment_of_nothing_and_of_very_long_texts(spark, paths, library):
    assert alignment.scored(alignment.align(table(spark, []), *paths), *paths).count() == 0
    rows = [(1, "whole lines of words, and more\n" * 4000), (2, "é" * 5000)]
    got = alignment.scored(alignment.align(table(spark, rows), *paths, chunk_chars=1000), *paths)
    assert Counter(map(tuple, got.collect())) == expected(rows, paths, library)


def test_pieces_are_encoded_by_the_library(paths, monkeypatch):
    """The same ids as the encoder's, whose walk is left to a few odd pieces."""
    t = alignment.Tables(*paths)
    names = pieces.cut(pa.array([" " + x for x in noise(4, 3000)]))[0]
    names += [" ", "  ", "   x", " \0", " a\0b", " <s>", " <0x41>", " \u2581", " \u2581a", "\u2581", " \n", " é\U0001f600", " " + "ab" * 500]
    encode, walked = t.b.encode, []
    want = [encode(x.replace(" ", alignment.SPACE)) for x in names]
    monkeypatch.setattr(t.b, "encode", lambda s: walked.append(s) or encode(s))
    assert t._encode_b(names) == want and t._encode_b([]) == []
    odd = [x for x in names if x[:1] != " " or x == " " or "\0" in x]
    assert len(walked) == len(odd) < len(names) / 2


def test_fragments_are_a_monoid(paths):
    """Any bracketing of any byte ranges gives the groups of the whole."""
    t = alignment.Tables(*paths)
    rnd = random.Random(6)
    for text in [x.replace("▁", "").replace("\0", "") for x in noise(7, 60, 80)]:
        text = " " + text + "x"
        ok, a, b = t.tokens(text)
        assert ok
        n = len(text.encode())
        edges = [0, *sorted(rnd.sample(range(1, n), min(n - 1, 5))), n]
        begin = [np.cumsum(s[ids]) - s[ids] for ids, s in ((a, t.a_len), (b, t.b_len))]
        rows, parts = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            runs = []
            for ids, at in zip((a, b), begin):
                i, j = np.searchsorted(at, [lo, hi])
                runs.append(alignment.Run(ids[i:j], at[i] if j > i else -1))
            ends, closed = alignment.fragment(t, *runs)
            parts.append(ends)
            rows += closed
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            both, closed = alignment.joined(t, parts[i], parts[i + 1])
            parts[i:i + 2] = [both]
            rows += closed
        assert parts[0]["cut"] and not any(parts[0][k] for k in ("pa", "pb", "sa", "sb"))
        whole = alignment.fragment(t, alignment.Run(a, 0), alignment.Run(b, 0))[1]
        assert ";".join(r["groups"] for r in sorted(rows, key=lambda r: r["pos"])) == whole[0]["groups"]
        assert sum(r["n_links"] for r in rows) == whole[0]["n_links"]


def test_lookup_files(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id * 3 AS key", "id AS v")
    uri = lookup.write_sorted(df, "key", "test", file_rows=90)
    files = lookup.SortedFiles(uri, "key", ("v",))
    assert len(files.files) > 5
    keys = np.random.default_rng(0).integers(-10, 3500, 5000)
    there, (v,) = files.find(keys)
    want = (keys % 3 == 0) & (keys >= 0) & (keys < 3000)
    assert (there == want).all() and (v == np.where(want, keys // 3, 0)).all()
    none = lookup.SortedFiles(lookup.write_sorted(df.limit(0), "key", "test"), "key")
    assert not none.find(keys)[0].any()

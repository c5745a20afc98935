"""SentencePiece BPE, exactly, by backtracking over longest matches.

The library merges the best-scoring adjacent pair of a text again and again, leftmost
first.  A list of pieces is that result if and only if each two neighbours are: merging
their joined text again gives back the two.  So the encoder walks from left to right: at
each place it takes the longest piece that an Aho-Corasick automaton found there and that
fits its left neighbour, then shorter ones, and steps back where none fits; a bitfield of
places from which there was no way on keeps it from trying them twice.  Characters without
a piece become the pieces of their bytes.  Decoding joins the pieces' bytes.
"""

from __future__ import annotations

import codecs
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, picked, table
from .pieces import Numbers, batches_of, cut, spans

SPACE = "\u2581"
KEEP_PIECES = 300_000   # pieces of text whose ids a worker keeps
KEEP_PAIRS = 500_000  # pairs of ids whose fit a worker keeps
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6  # fixed values: kinds of pieces in a model file


def _fields(data: bytes):
    """``(number, value)`` of a serialised message: ints, or bytes."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i:i + size]
            i += size


class Model:
    """The pieces of a model file: texts, scores, kinds; BPE with byte pieces and no normalisation table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:  # a piece: text, score, kind
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                self.scores.append(float(np.frombuffer(d.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(d.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.prefix = bool(normalizer.get(3, 1))
        known = set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not known:
            raise ValueError(f"{path}: only BPE models with byte pieces and without normalisation are supported")
        self.bytes = {}
        self.surface = []  # what a piece decodes to
        for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                value = int(p[3:5], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append({CONTROL: b"", UNKNOWN: " \u2047 ".encode()}.get(kind, p.replace(SPACE, " ").encode()))
        self.size = len(self.pieces)


class Encoder:
    """Ids of a text (white space already written as U+2581)."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.score = {model.pieces[i]: model.scores[i] for i in normal}
        self.text = list(model.pieces)  # of a token; characters without a piece get tokens of their own
        self.ids = [(i,) for i in range(model.size)]
        self.alone = {}
        reached = [i for i in normal if self.merged(model.pieces[i]) == [model.pieces[i]]]
        token = {model.pieces[i]: i for i in reached}
        for c in sorted({c for i in normal for c in model.pieces[i]} - set(token)):
            token[c] = self._character(c)
        self.length = [len(t) for t in self.text]
        self.shorter = [-1] * len(self.text)
        for s, t in token.items():
            self.shorter[t] = next((token[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in token), -1)
        self.automaton = ahocorasick.Automaton()
        for s, t in token.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.fit = {}
        #: whether no piece goes on from something else into a space, so that texts may be cut there
        self.cuts = not any(SPACE in p[1:] and p.strip(SPACE) for p in self.score) and not any(
            SPACE in p.lstrip(SPACE) for p in self.score)

    def _character(self, c: str) -> int:
        t = self.alone[c] = len(self.text)
        self.text.append(c)
        self.ids.append(tuple(self.model.bytes[b] for b in c.encode()))
        return t

    def merged(self, s: str) -> list[str]:
        """The pieces of a short text by merging the best pair, leftmost first, until none is left."""
        parts, score, never = list(s), self.score.get, float("-inf")
        scores = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == never:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], never)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, left: int, right: int) -> bool:
        if len(self.fit) > KEEP_PAIRS:
            self.fit.clear()
        a, b = self.text[left], self.text[right]
        found = self.fit[left << 32 | right] = a + b not in self.score and self.merged(a + b) == [a, b]
        return found

    def tokens(self, s: str) -> list[int]:
        """The tokens of ``s``."""
        n = len(s)
        length, shorter, fit, fits = self.length, self.shorter, self.fit, self.fits
        longest = [-1] * n
        for end, t in self.automaton.iter(s):  # ends ascend, so the longest at each place is written last
            longest[end + 1 - length[t]] = t
        if -1 in longest:  # characters that no piece has
            for i, c in enumerate(s):
                if longest[i] < 0:
                    if c not in self.alone:
                        self._character(c)
                        length.append(1)
                        shorter.append(-1)
                    longest[i] = self.alone[c]
        failed = bytearray((n >> 3) + 1)
        out, at, last, t = [], 0, -1, longest[0] if n else -1
        while at < n:
            end = at + length[t]
            if t < 0:  # nothing fits here: step back, and take something shorter before
                if not out:
                    raise ValueError("the vocabulary has no way to write this text")
                failed[at >> 3] |= 1 << (at & 7)
                t = out.pop()
                at -= length[t]
                last = out[-1] if out else -1
                t = shorter[t]
            else:
                good = not failed[end >> 3] >> (end & 7) & 1
                if good and last >= 0:
                    good = fit.get(last << 32 | t)
                    if good is None:
                        good = fits(last, t)
                if good:
                    out.append(t)
                    last, at = t, end
                    t = longest[at] if at < n else -1
                else:
                    t = shorter[t]
        return out

    def encode(self, s: str) -> list[int]:
        known = self.model.size
        found = self.tokens(s)
        if not found or max(found) < known:
            return found
        return [i for t in found for i in self.ids[t]]


class TextEncoder:
    """Encodes batches of texts, each different piece of them once."""

    def __init__(self, path: str, limit: int = KEEP_PIECES):
        self.encoder = Encoder(Model(path))
        self.numbers = Numbers(self._learn, limit)
        self._learn(None)

    def _learn(self, new):
        if new is None:
            self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        ids = [self.encoder.encode(p.replace(" ", SPACE)) for p in new]
        size = np.array([len(x) for x in ids], np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.size = np.concatenate([self.size, size])

    def spaced(self, texts: pa.Array) -> pa.Array:
        """The texts as the model sees them: a space before each that isn't empty."""
        return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, "")) if self.encoder.model.prefix else texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(all ids, ids of each text)``."""
        self.numbers.trim()
        texts = self.spaced(texts)
        if self.encoder.cuts:
            names, codes, counts = cut(texts)
        else:
            whole = texts.dictionary_encode()
            names, codes, counts = whole.dictionary.to_pylist(), np.asarray(whole.indices), np.ones(len(texts), np.int64)
        at = self.numbers(names)[codes]
        size = self.size[at]
        total = np.zeros(len(counts), np.int64)
        some = counts > 0
        if some.any():
            total[some] = np.add.reduceat(size, (np.cumsum(counts) - counts)[some])
        return self.flat[spans(self.first[at], size)], total


def _invalid(error):
    return "\ufffd", error.start + 1


codecs.register_error("corpusmap_each_byte", _invalid)


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of ids: each byte that is no UTF-8 gives U+FFFD; the space put first is taken away again."""
    surface = model.surface
    text = b"".join([surface[i] for i in ids])
    shown = next((i for i in ids if surface[i]), None) if ids else None
    if model.prefix and shown is not None and model.kinds[shown] == NORMAL and text[:1] == b" ":
        text = text[1:]
    try:
        return text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "corpusmap_each_byte")


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4_000_000,
           keep_pieces: int = KEEP_PIECES) -> DataFrame:
    """``(id, ids array<int>)`` for every row: the whole text's ids, without begin or end ids.

    A null or empty text has no ids; null and repeated ids and repeated rows stay as they
    are; an empty table gives an empty result.  No shuffle: rows stay in their tasks.
    ``batch_chars`` and ``keep_pieces`` bound what a Python worker holds.
    """
    def job(batches):
        for b in batches:
            for part in batches_of(b, "text", batch_chars):
                encoder = kept_in_worker(("texts", model_path, keep_pieces), lambda: TextEncoder(model_path, keep_pieces))
                ids, count = encoder.encode(part.column("text"))
                edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "ids"])

    return picked(df, id_col, text_col).mapInArrow(job, "id long, ids array<int>")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded", batch_ids: int = 1_000_000) -> DataFrame:
    """``df(id, ids_col)`` with the text of its ids: ``(id, ids, decoded)``; null ids give an empty text."""
    rows = df.select("id", F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def job(batches):
        for b in batches:
            lists = b.column("ids")
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            step = max(1, int(batch_ids // max(1.0, size.mean() if len(size) else 1.0)))
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                model = kept_in_worker(("model", model_path), lambda: Model(model_path))
                texts = [decode_ids(model, x.tolist()) for x in
                         np.split(np.asarray(part.column("ids").flatten()), np.cumsum(size[i:i + step])[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["id", "ids", out_col])

    return rows.mapInArrow(job, f"id long, ids array<int>, {out_col} string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded again; ids and texts as digests."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
SQL = {}

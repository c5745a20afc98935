"""Alignment of two tokenizers over the same bytes, as a monoid of fragments.

Where a token of A and a token of B end at the same byte, the text is cut; the tokens
between two cuts form a group.  A *fragment* is what is known of a byte range: the tokens
before its first cut (open prefix), the closed groups, and the tokens after its last cut
(open suffix).  Joining two neighbouring fragments closes the groups among the left suffix
and the right prefix, and this operation is associative, so a document may be cut at any
bytes, its ranges aligned by different tasks, and the fragments joined in a tree.

Short documents are one range and stay in their task.  Longer ones are cut into ranges of
``chunk_chars`` characters, dealt out over the cluster; closed groups are written as rows
at once, and only the open ends go up the tree, sixteen fragments to one.

Within two tokens' overlap no token ends, so each stretch between neighbouring ends (of
either side) is exactly one link: an A-B pair of occurrences whose bytes overlap.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.util import cut_lineage
from .common import kept_in_worker, partitions, picked, table
from .lookup import opened, write_sorted
from .pieces import SAFE_CUT, Numbers, batches_of, cut, distinct, spans
from .sentencepieces import BYTE, SPACE, Encoder, Model
from .tokens import bits_for, encode_pieces, line_end_id

KEEP_PIECES = 200_000
FAN = 16                # fragments joined to one in a step
BATCH_KEYS = 2_000_000  # id pairs of documents looked up together


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cuts_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both (ascending) arrays of the ends that they share."""
    if not len(a_ends) or not len(b_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b_ends, a_ends)
    same = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends
    return np.flatnonzero(same), at[same]


class Tables:
    """Both tokenizers: ids and byte lengths, and what is known of pieces of text seen before."""

    def __init__(self, a_path: str, b_path: str, limit: int = KEEP_PIECES):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.line_end = line_end_id(self.a)
        model = Model(b_path)
        self.b, self.library = Encoder(model), SentencePieceProcessor(model_file=b_path)
        if not self.b.cuts or not model.prefix:
            raise ValueError(f"{b_path}: pieces that go on after a space can't be aligned piece by piece")
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            if all(c in alphabet for c in t):
                self.a_bytes[i] = bytes(alphabet[c] for c in t)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
                        for p, k in zip(model.pieces, model.kinds)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_name = [str(i) for i in range(len(self.a_bytes))]
        self.b_name = [str(i) for i in range(len(self.b_bytes))]
        self.shift = bits_for(len(self.b_bytes))
        self.key_type = np.dtype("<u4" if self.shift + bits_for(len(self.a_bytes)) <= 32 else "<u8")
        self.numbers = Numbers(self._learn, limit)
        self._learn(None)

    # ------------------------------------------------------------ pieces of text
    def _learn(self, new):
        if new is None:
            self.ok, self.groups = np.zeros(0, bool), []
            self.flat = {k: np.zeros(0, np.uint32 if k in "ab" else self.key_type) for k in "abk"}  # ids of A, ids of B, keys of links
            self.size = {k: np.zeros(0, np.int32) for k in "abkg"}  # and how many each piece has; g: groups
            self.first = {k: np.zeros(0, np.int64) for k in "abk"}
            return
        a = encode_pieces(self.a, new, self.line_end, [])
        b = self._encode_b(new)
        size = {"a": np.array([len(x) for x in a], np.int64), "b": np.array([len(x) for x in b], np.int64)}
        flat = {"a": np.concatenate(a).astype(np.int64), "b": np.fromiter(chain.from_iterable(b), np.int64, int(size["b"].sum()))}
        ok = self._same_bytes(new, flat, size)
        if not ok.all():
            for k in "ab":
                flat[k] = flat[k][np.repeat(ok, size[k])]
                size[k] = np.where(ok, size[k], 0)
        a_ends, b_ends = np.cumsum(self.a_len[flat["a"]]), np.cumsum(self.b_len[flat["b"]])
        owner_a, owner_b = np.repeat(np.arange(len(new)), size["a"]), np.repeat(np.arange(len(new)), size["b"])
        ca, cb = cuts_of(a_ends, b_ends)
        size["g"] = np.bincount(owner_a[ca], minlength=len(new))
        keys, first_of = self.links(flat["a"], a_ends, flat["b"], b_ends)
        owner = np.concatenate([owner_a, owner_b[first_of]])
        by = np.argsort(owner, kind="stable")
        flat["k"], size["k"] = keys[by], np.bincount(owner, minlength=len(new))
        texts = self.group_texts(flat["a"], flat["b"], ca, cb)
        at = 0
        for n in size["g"].tolist():
            self.groups.append(";".join(texts[at:at + n]))
            at += n
        for k in "abk":
            self.first[k] = np.concatenate([self.first[k], len(self.flat[k]) + np.cumsum(size[k]) - size[k]])
            self.flat[k] = np.concatenate([self.flat[k], flat[k].astype(self.flat[k].dtype)])
        for k in "abkg":
            self.size[k] = np.concatenate([self.size[k], size[k].astype(np.int32)])
        self.ok = np.concatenate([self.ok, ok])

    def _encode_b(self, new: list[str]) -> list[list[int]]:
        """Ids of B of each piece; the library puts the space before a piece itself, so one alone and NULs are left to the encoder."""
        own = [p[:1] != " " or len(p) == 1 or "\0" in p for p in new]
        found = iter(self.library.encode([p[1:] for p, o in zip(new, own) if not o], num_threads=1))
        return [self.b.encode(p.replace(" ", SPACE)) if o else next(found) for p, o in zip(new, own)]

    def _same_bytes(self, new, flat, size) -> np.ndarray:
        """Which pieces are exactly the bytes of their tokens, on both sides."""
        raw = pa.array(new, pa.string())
        length = np.asarray(pc.binary_length(raw))
        ok = np.ones(len(new), bool)
        for k, known, lens in (("a", self.a_bytes, self.a_len), ("b", self.b_bytes, self.b_len)):
            ends = np.concatenate([[0], np.cumsum(size[k])])
            total = np.concatenate([[0], np.cumsum(lens[flat[k]])])[ends]
            ok &= np.diff(total) == length
            if not ok.all() or b"".join([known[i] for i in flat[k].tolist()]) != "".join(new).encode():
                ids = flat[k].tolist()
                ok &= np.array([b"".join([known[i] for i in ids[x:y]]) == p.encode() for p, x, y in zip(new, ends[:-1].tolist(), ends[1:].tolist())], bool)
        return ok

    def links(self, a_ids, a_ends, b_ids, b_ends) -> tuple[np.ndarray, np.ndarray]:
        """Keys (A id, B id) of all links: one for the stretch before each end of A, then for the other ends of B, whose places follow."""
        if not len(a_ids) or not len(b_ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, shared = cuts_of(a_ends, b_ends)
        other = np.delete(np.arange(len(b_ends)), shared)
        one = a_ids << self.shift | b_ids[np.searchsorted(b_ends, a_ends)]
        two = a_ids[np.searchsorted(a_ends, b_ends[other])] << self.shift | b_ids[other]
        return np.concatenate([one, two]), other

    def group_texts(self, a_ids, b_ids, ca, cb) -> list[str]:
        """``a1,a2|b1`` for each group that ends at the cuts ``(ca, cb)``."""
        a, b = [self.a_name[i] for i in a_ids.tolist()], [self.b_name[i] for i in b_ids.tolist()]
        out, i, j = [], 0, 0
        for x, y in zip((ca + 1).tolist(), (cb + 1).tolist()):
            out.append((a[i] if x == i + 1 else ",".join(a[i:x])) + "|" + (b[j] if y == j + 1 else ",".join(b[j:y])))
            i, j = x, y
        return out

    # ------------------------------------------------------------ whole texts
    def align(self, texts: pa.Array) -> dict:
        """Whole texts: counts, ``groups``, and each text's different links (``keys``) with how often they occur (``times``)."""
        self.numbers.trim()
        names, codes, counts = cut(pc.binary_join_element_wise(" ", texts, ""))
        at = self.numbers(names)[codes]
        edges = np.concatenate([[0], np.cumsum(counts)])
        ok = (np.add.reduceat(~self.ok[at], edges[:-1]) == 0) & (np.asarray(pc.binary_length(texts)) > 0)
        total = {k: np.where(ok, np.add.reduceat(self.size[k][at], edges[:-1]), 0) for k in "abkg"}
        use = np.repeat(ok, counts)
        doc = np.repeat(np.arange(len(counts)), counts)[use]
        at = at[use]
        key = self.flat["k"][spans(self.first["k"][at], self.size["k"][at])]
        keys, times, of = distinct(np.repeat(doc, self.size["k"][at]), key, len(counts))
        groups, at = [], at.tolist()
        i = 0
        for n, good in zip(counts.tolist(), ok.tolist()):
            if not good:
                groups.append(None)
                continue
            groups.append(";".join(filter(None, [self.groups[x] for x in at[i:i + n]])))
            i += n
        return {"total": total, "ok": ok, "groups": groups, "keys": keys, "times": times, "of": of}

    def tokens(self, text: str) -> tuple[bool, np.ndarray, np.ndarray]:
        """``(ok, ids of A, ids of B)`` of a stretch of text that begins and ends where texts may be cut."""
        self.numbers.trim()
        names, codes, _ = cut(pa.array([text]))
        at = self.numbers(names)[codes]
        return bool(self.ok[at].all()), *(self.flat[k][spans(self.first[k][at], self.size[k][at])].astype(np.int64) for k in "ab")


def _tables(a_path, b_path) -> Tables:
    """Both tokenizers, once for each Python worker."""
    return kept_in_worker(("tables", a_path, b_path), lambda: Tables(a_path, b_path))


# ---------------------------------------------------------------- fragments
COUNTS = "n_a long, n_b long, n_groups long, n_links long"
OPEN = "cut boolean, ok boolean, pa array<int>, pa_at long, pb array<int>, pb_at long, sa array<int>, sa_at long, sb array<int>, sb_at long"
CLOSED = f"{COUNTS}, groups string, keys binary, times binary"
FRAGMENT = f"rid long, k long, pos long, {OPEN}, {CLOSED}"
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in FRAGMENT.split(","))])
_NAMES = _SCHEMA.names
NOTHING = np.zeros(0, np.int64)


class Run:
    """Neighbouring tokens of one side: ids and the byte where the first begins."""

    def __init__(self, ids, at):
        self.ids, self.at = np.asarray(ids, np.int64), int(at)

    def __add__(self, other):
        if not len(self.ids) or not len(other.ids):
            return self if len(self.ids) else other
        return Run(np.concatenate([self.ids, other.ids]), self.at)


def closed_row(t: Tables, a: Run, b: Run, ca: np.ndarray, cb: np.ndarray) -> dict:
    """Tokens that end at a cut, as a row of closed groups."""
    a_ends, b_ends = a.at + np.cumsum(t.a_len[a.ids]), b.at + np.cumsum(t.b_len[b.ids])
    keys, times, _ = distinct(np.zeros(len(a.ids) + len(b.ids) - len(ca), np.int64), t.links(a.ids, a_ends, b.ids, b_ends)[0], 1)
    return {"pos": a.at, "n_a": len(a.ids), "n_b": len(b.ids), "n_groups": len(ca), "n_links": int(times.sum()),
            "groups": ";".join(t.group_texts(a.ids, b.ids, ca, cb)), "keys": keys.astype(t.key_type).tobytes(),
            "times": times.astype("<u4").tobytes()}


def fragment(t: Tables, a: Run, b: Run) -> tuple[dict, list[dict]]:
    """``(open ends, closed rows)`` of the tokens that begin in a byte range."""
    ca, cb = cuts_of(a.at + np.cumsum(t.a_len[a.ids]), b.at + np.cumsum(t.b_len[b.ids]))
    starts = len(a.ids) > 0 and len(b.ids) > 0 and a.at == b.at
    if not starts and not len(ca):
        return open_ends(False, a, b, Run(NOTHING, -1), Run(NOTHING, -1)), []
    i, j = (0, 0) if starts else (int(ca[0]) + 1, int(cb[0]) + 1)
    x, y = (int(ca[-1]) + 1, int(cb[-1]) + 1) if len(ca) else (0, 0)
    def part(run, size, lo, hi):
        return Run(run.ids[lo:hi], run.at + int(size[run.ids[:lo]].sum()) if hi > lo else -1)
    pre, suf = (part(a, t.a_len, 0, i), part(b, t.b_len, 0, j)), (part(a, t.a_len, x, len(a.ids)), part(b, t.b_len, y, len(b.ids)))
    inner = ca >= i
    rows = [closed_row(t, part(a, t.a_len, i, x), part(b, t.b_len, j, y), ca[inner] - i, cb[inner] - j)] if x > i else []
    return open_ends(True, *pre, *suf), rows


def open_ends(is_cut: bool, pa_: Run, pb: Run, sa: Run, sb: Run, ok: bool = True) -> dict:
    out = {"cut": is_cut, "ok": ok}
    for name, run in (("pa", pa_), ("pb", pb), ("sa", sa), ("sb", sb)):
        out[name], out[name + "_at"] = run.ids.tolist(), run.at
    return out


def joined(t: Tables, left: dict, right: dict) -> tuple[dict, list[dict]]:
    """The monoid's operation: ``(open ends of both, the groups closed between them)``."""
    ok = bool(left["ok"]) and bool(right["ok"])
    l, r = ({n: Run(x[n], x[n + "_at"]) for n in ("pa", "pb", "sa", "sb")} for x in (left, right))
    if not ok:  # a document with other bytes has no alignment
        none = Run(NOTHING, -1)
        return open_ends(False, none, none, none, none, False), []
    tail = ("sa", "sb") if left["cut"] else ("pa", "pb")
    # between the two lie open tokens only; cuts among them join a token of one with a token of the other
    between, rows = fragment(t, l[tail[0]] + r["pa"], l[tail[1]] + r["pb"])
    mid = {n: Run(between[n], between[n + "_at"]) for n in ("pa", "pb", "sa", "sb")}
    pre = (l["pa"], l["pb"]) if left["cut"] else (mid["pa"], mid["pb"])
    if right["cut"]:
        suf = r["sa"], r["sb"]
    elif left["cut"] and not between["cut"]:
        suf = mid["pa"], mid["pb"]
    else:
        suf = mid["sa"], mid["sb"]
    return open_ends(bool(left["cut"] or right["cut"] or between["cut"]), *pre, *suf), rows


def ranges(text: str, chunk: int):
    """``(first, last, lo, hi)`` in characters: ranges ``lo .. hi`` of about ``chunk`` characters that cover ``text``.

    ``first .. last`` is the range out to the next places where texts may be cut.  A range
    goes on until it holds such a place, so that no stretch is read more than twice.
    """
    places = [0] + [m.start() for m in SAFE_CUT.finditer(text)] + [len(text)]
    lo = 0
    while lo < len(text):
        first = places[bisect_right(places, lo) - 1]
        hi = min(len(text), lo + chunk)
        i = bisect_right(places, hi) - 1
        if places[i] <= lo and i + 1 < len(places):
            hi = max(hi, places[i + 1])
        last = places[min(len(places) - 1, bisect_right(places, hi - 1))]
        yield first, last, lo, hi
        lo = hi


def _fragment_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _NAMES} for r in rows], _SCHEMA)


def _long_documents(rows: DataFrame, a_path: str, b_path: str, chunk_chars: int) -> DataFrame:
    """Alignments of long documents: fragments over the cluster, joined in a tree."""
    spark = rows.sparkSession

    def chunks(batches):
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = " " + text.as_py()
                at = before = 0  # characters and bytes counted so far
                for k, (first, last, lo, hi) in enumerate(ranges(text, chunk_chars)):
                    at, before = first, before + (len(text[at:first].encode()) if first >= at else -len(text[first:at].encode()))
                    low = before + len(text[first:lo].encode())
                    yield pa.RecordBatch.from_pydict({
                        "rid": pa.array([rid], pa.int64()), "k": pa.array([k], pa.int64()), "base": pa.array([before], pa.int64()),
                        "lo": pa.array([low], pa.int64()), "hi": pa.array([low + len(text[lo:hi].encode())], pa.int64()),
                        "text": pa.array([text[first:last]], pa.string())})

    def fragments(batches):
        t = _tables(a_path, b_path)
        for b in batches:
            for r in (x for i in range(len(b)) for x in b.slice(i, 1).to_pylist()):
                ok, a, bb = t.tokens(r["text"])
                if not ok:
                    none = Run(NOTHING, -1)
                    yield _fragment_batch([{"rid": r["rid"], "k": r["k"], **open_ends(False, none, none, none, none, False)}])
                    continue
                runs = []
                for ids, size in ((a, t.a_len), (bb, t.b_len)):
                    begin = r["base"] + np.cumsum(size[ids]) - size[ids]
                    i, j = np.searchsorted(begin, [r["lo"], r["hi"]])
                    runs.append(Run(ids[i:j], begin[i] if j > i else -1))
                ends, closed = fragment(t, *runs)
                yield _fragment_batch([{"rid": r["rid"], "k": r["k"], **ends}, *({"rid": r["rid"], "k": r["k"], **c} for c in closed)])

    def join(group: pa.Table) -> pa.Table:
        t = _tables(a_path, b_path)
        records = group.sort_by("k").to_pylist()
        rid, k, out, acc = records[0]["rid"], records[0]["k"] // FAN, [], records[0]
        for right in records[1:]:
            acc, closed = joined(t, acc, right)
            out += closed
        out.append({n: acc[n] for n in ("cut", "ok", "pa", "pa_at", "pb", "pb_at", "sa", "sa_at", "sb", "sb_at")})
        return pa.Table.from_batches([_fragment_batch([{"rid": rid, "k": k} | r for r in out])])

    cuts = rows.select("rid", "text").mapInArrow(chunks, "rid long, k long, base long, lo long, hi long, text string")
    level = cut_lineage(cuts.repartition(partitions(spark), "rid", "k").mapInArrow(fragments, FRAGMENT))
    closed = level.filter("cut is null")
    ends = level.filter("cut is not null")
    top = ends.agg(F.max("k")).first()[0] or 0
    while top > 0:
        group = ends.withColumn("g", F.floor(F.col("k") / FAN)).repartition(partitions(spark), "rid", "g").groupBy("rid", "g")
        level = cut_lineage(group.applyInArrow(join, FRAGMENT))
        closed = closed.unionByName(level.filter("cut is null"))
        ends = level.filter("cut is not null")
        top //= FAN
    wrong = ends.filter(~F.col("ok")).select("rid")
    closed = closed.join(wrong, "rid", "left_anti").select("rid", "pos", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times")

    def finish(batches):
        t, now = _tables(a_path, b_path), None

        def done():
            keys, times = now["keys"], now["times"]
            return pa.RecordBatch.from_pydict({
                "rid": pa.array([now["rid"]], pa.int64()), **{n: pa.array([now[n]], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": [now["sha"].hexdigest()], "keys": pa.array([keys.astype(t.key_type).tobytes()], pa.binary()),
                "times": pa.array([times.astype("<u4").tobytes()], pa.binary())})

        for b in batches:
            for r in (x for i in range(len(b)) for x in b.slice(i, 1).to_pylist()):
                if now is None or now["rid"] != r["rid"]:
                    if now is not None:
                        yield done()
                    now = {"rid": r["rid"], "sha": hashlib.sha256(), "keys": NOTHING, "times": NOTHING, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
                now["sha"].update(((";" if now["n_groups"] else "") + r["groups"]).encode())
                for n in ("n_a", "n_b", "n_groups", "n_links"):
                    now[n] += r[n]
                keys = np.concatenate([now["keys"], np.frombuffer(r["keys"], t.key_type).astype(np.int64)])
                times = np.concatenate([now["times"], np.frombuffer(r["times"], "<u4").astype(np.int64)])
                now["keys"], back = np.unique(keys, return_inverse=True)
                now["times"] = np.bincount(back, times, len(now["keys"])).astype(np.int64)
        if now is not None:
            yield done()

    ordered = closed.repartition(partitions(spark), "rid").sortWithinPartitions("rid", "pos")
    return ordered.mapInArrow(finish, f"rid long, {COUNTS}, groups_sha256 string, keys binary, times binary")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768,
          batch_chars: int = 1_000_000) -> DataFrame:
    """One row per document: ``id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times``, written in the checkpoint folder.

    ``keys`` holds the different links as little-endian numbers ``A id << bits | B id``,
    ascending, and ``times`` how often each occurs (unsigned 32-bit).  Null and empty texts,
    and texts whose tokens have other bytes than a space and the text, have no tokens: zeros
    and an empty ``groups_sha256``.  Null and repeated ids and repeated rows stay as they
    are; an empty table gives an empty result.  ``chunk_chars`` only changes how the work is dealt.
    """
    rows = picked(df, id_col, text_col)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]

    def short(batches):
        t = _tables(a_path, b_path)
        for b in batches:
            for part in batches_of(b, "text", batch_chars):
                r = t.align(part.column("text"))
                keys, times = memoryview(r["keys"].astype(t.key_type).tobytes()), memoryview(r["times"].astype("<u4").tobytes())
                edges, width = r["of"].tolist(), t.key_type.itemsize
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), *(pa.array(r["total"][k].astype(np.int64)) for k in "abgk"),
                    pa.array(["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in r["groups"]], pa.string()),
                    pa.array([keys[width * x:width * y] for x, y in zip(edges[:-1], edges[1:])], pa.binary()),
                    pa.array([times[4 * x:4 * y] for x, y in zip(edges[:-1], edges[1:])], pa.binary())], names=columns)

    schema = f"id long, {COUNTS}, groups_sha256 string, keys binary, times binary"
    one = rows.filter(F.length("text") <= chunk_chars).mapInArrow(short, schema)
    long = cut_lineage(rows.filter(F.length("text") > chunk_chars).withColumn("rid", F.monotonically_increasing_id()))
    many = _long_documents(long, a_path, b_path, chunk_chars)
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in columns[1:5]]
    many = long.select("rid", "id").join(many, "rid", "left").select(
        "id", *zeros, *(F.coalesce(F.col(c), F.lit("").cast(t)).alias(c) for c, t in (("groups_sha256", "string"), ("keys", "binary"), ("times", "binary"))))
    return cut_lineage(one.unionByName(many))


def pair_counts(aligned: DataFrame, a_path: str, b_path: str, keep: int = 2_000_000) -> DataFrame:
    """``(key, n)``: in how many documents of :func:`align` each id pair is linked; counted in each task before the shuffle."""
    def job(batches):
        t = _tables(a_path, b_path)
        keys, times, held, n = NOTHING, NOTHING, [], 0

        def merged():
            every, back = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([times, np.ones(n, np.int64)]), len(every)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["key", "n"])

        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_buffer() or b"", t.key_type).astype(np.int64))
                n += len(held[-1])
                if n > keep:
                    keys, times = merged()
                    held, n = [], 0
                    if len(keys) > keep:
                        yield rows()
                        keys, times = NOTHING, NOTHING
        if n:
            keys, times = merged()
        if len(keys):
            yield rows()

    return aligned.select("keys").mapInArrow(job, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """:func:`align` rows with ``n_best`` and ``count_sum``: links whose id pair is linked in the most documents of all
    pairs of their A id, and the sum of the links' document counts.

    The counts go to sorted files of bounded size in the checkpoint folder;
    tasks read them one after the other for a bounded number of documents at a time, so
    nothing that grows with the corpus is broadcast.
    """
    shift = bits_for(len(Model(b_path).pieces))
    counts = cut_lineage(pair_counts(aligned, a_path, b_path))
    counts = counts.withColumn("a", F.shiftright("key", shift))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most one row for each id of A's vocabulary
    ranked = counts.join(F.broadcast(top), "a").select("key", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    uri = write_sorted(ranked, "key", "pairs")

    def job(batches):
        t = _tables(a_path, b_path)
        table = opened(uri, "key", ("n", "best"))
        for b in batches:
            size = np.asarray(pc.binary_length(b.column("keys"))).astype(np.int64) // t.key_type.itemsize
            ends, i = np.cumsum(size), 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_KEYS, "right")))
                part = b.slice(i, j - i)
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), t.key_type).astype(np.int64)
                times = np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
                _, (n, best) = table.find(keys)
                edges = np.concatenate([[0], np.cumsum(size[i:j])])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x)])[edges]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums),
                                                  part.column("groups_sha256")], names=SCORED)
                i = j

    return aligned.mapInArrow(job, f"id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string")


SCORED = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against SentencePiece over all of ``documents``."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return scored(align(table(spark, sf_dir, "documents"), *paths), *paths).withColumnRenamed("id", "doc_id")


QUERIES = {"op13_token_alignment": op13_token_alignment}
SQL = {}

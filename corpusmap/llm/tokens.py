"""Token ids as bit-packed binary files: every id in the fewest bits the vocabulary needs.

A shard file holds, in this order (all numbers little-endian):

- header: magic ``CMTOKEN1``, bits per id (u32), ids per block (u32)
- blocks: ``ids per block`` ids of ``bits`` bits each, lowest bit first; the last may be short
- index: block offsets in the file (u64 each), then per document its id (i64), whether it
  has one (u8) and the place of its first token in the shard (u64)
- footer: places of the index's parts, counts of blocks, documents and tokens (u64 each), magic

Whole blocks are unpacked with a few numpy calls, and the offsets give any range of ids
without reading what comes before it.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.util import cut_lineage
from .common import kept_in_worker, new_folder, partitions, picked, task_number
from .pieces import Numbers, batches_of, numbered, spans, split_before

MAGIC = b"CMTOKEN1"
HEADER = "<8sII"
FOOTER = "<QQQQQQ8s"
ENDS_SAFE, ENDS_WORD, IS_SIGN = 1, 2, 4  # kinds of pieces
PLAIN = re.compile(r" ?[\w!-~](?:\S*[\w!-~])?")
KEEP_PIECES = 400_000
BLOCK_IDS = 8192  # a multiple of 8, so that blocks end at whole bytes


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    return np.packbits(planes.reshape(-1), bitorder="little").view("<u4")


class Writer:
    """Writes one shard; the file gets its name only when it is whole, so a task that is run again replaces it."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.bits, self.rest, self.tokens = bits, np.zeros(0, np.uint32), 0
        self.blocks, self.docs, self.starts = [], [], []
        self.out.write(struct.pack(HEADER, MAGIC, bits, BLOCK_IDS))
        self.at = struct.calcsize(HEADER)

    def _block(self, ids):
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray):
        self.docs += doc_ids
        self.starts.append(self.tokens + np.cumsum(lengths) - lengths)
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(ids[i:i + BLOCK_IDS])
        self.rest = ids[whole:]

    def close(self):
        if len(self.rest):
            self._block(self.rest)
        offsets_at = self.at
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)]).astype("<u8")
        parts = [np.array(self.blocks, "<u8"), np.array([d or 0 for d in self.docs], "<i8"),
                 np.array([d is not None for d in self.docs], np.uint8), starts]
        for p in parts:
            self.out.write(p.tobytes())
        docs_at = offsets_at + 8 * len(self.blocks)
        self.out.write(struct.pack(FOOTER, offsets_at, docs_at, len(self.blocks), len(self.docs), self.tokens, self.bits, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Random access to the ids of one shard."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        offsets_at, docs_at, blocks, docs, self.tokens, _, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        head, self.bits, self.per_block = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.offsets = np.append(np.frombuffer(self.file.read_at(8 * blocks, offsets_at), "<u8"), np.uint64(offsets_at))
        data = self.file.read_at(17 * docs, docs_at)
        self.doc_ids = np.frombuffer(data, "<i8", docs)
        self.has_id = np.frombuffer(data, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(data, "<u8", docs, 9 * docs), np.uint64(self.tokens)).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the shard; reads only the blocks that hold them."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.per_block, (start + count - 1) // self.per_block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        held = min(self.tokens, (last + 1) * self.per_block) - first * self.per_block
        found = unpack(self.file.read_at(end - at, at), self.bits, held)
        return found[start - first * self.per_block:][:count]


def encode_pieces(tokenizer, pieces: list[str], line_end: int | None, special: list[str], together: int = 2000) -> list[np.ndarray]:
    """Ids of each piece, plain ones together in one text with a line end (id ``line_end``) between them."""
    plain = [line_end is not None and PLAIN.fullmatch(u) is not None for u in pieces]
    for s in special:
        for i in np.flatnonzero(np.asarray(pc.match_substring(pa.array(pieces, pa.string()), s))).tolist():
            plain[i] = False
    joint = [i for i, p in enumerate(plain) if p]
    ids = [None] * len(pieces)
    for g in (joint[i:i + together] for i in range(0, len(joint), together)):
        e, = tokenizer.encode_batch_fast(["\n".join([pieces[i] for i in g])], add_special_tokens=False)
        got = np.array(e.ids, np.uint32)
        ends = np.append(np.flatnonzero(got == line_end), len(got)).tolist()
        if len(ends) != len(g):
            raise ValueError("the tokenizer doesn't keep line ends apart")
        a = 0
        for i, z in zip(g, ends):
            ids[i] = got[a:z]
            a = z + 1
    other = [i for i, p in enumerate(plain) if not p]
    for i, e in zip(other, tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)):
        ids[i] = np.array(e.ids, np.uint32)
    return ids


def line_end_id(tokenizer) -> int | None:
    """The id of a line end, if the tokenizer gives it one of its own between letters."""
    between, alone = (tokenizer.encode(t, add_special_tokens=False).ids for t in ("a\nb", "\n"))
    return between[1] if len(between) == 3 and alone == between[1:2] else None


#: Where texts are cut: first as finely as is safe, then between words and lines only.
CUTS = ({" ": "\0 ", "\n": "\0\n\0", ",": "\0,", ".": "\0."}, {" ": "\0 ", "\n": "\0\n\0"})


class UnitEncoder:
    """Encodes texts with a byte-level BPE tokenizer, piece by piece, each different piece once.

    The tokenizer's first step always starts a new pre-token at white space that follows
    something else, after a lone line end, and at a comma or full stop that follows a
    letter or digit.  A text in which each space and line end follows a letter, digit or
    ASCII sign is therefore cut there, and the ids of the pieces, joined, are the ids of
    the text.  Any other text is encoded whole.  Arrow cuts the texts and numbers the
    pieces, which are kept up to ``limit`` and then forgotten.
    """

    def __init__(self, path: str, limit: int = KEEP_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = line_end_id(self.tokenizer)
        self.numbers = Numbers(self._learn, limit)
        self._learn(None)

    def _learn(self, new):
        if new is None:
            self.flat, self.kind = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
            self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        ids = encode_pieces(self.tokenizer, new, self.line_end, self.special)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, *ids])
        self.size = np.concatenate([self.size, size])
        self.kind = np.concatenate([self.kind, np.array([_KINDS[u[-1:]] | IS_SIGN * (u[:1] in (",", ".")) for u in new], np.uint8)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(numbers of all pieces, pieces of each text)``: the finest cut that is safe."""
        n = len(texts)
        found, begin, count = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
        nul = np.asarray(pc.match_substring(texts, "\0"))
        todo, held = np.flatnonzero(~nul), 0
        for marks in CUTS:
            names, codes, counts = numbered(split_before(texts.take(pa.array(todo)), marks))
            at = self.numbers(names)[codes]
            kind = self.kind[at]
            bad = ((kind[:-1] & ENDS_SAFE) == 0) | ((kind[1:] & IS_SIGN) > 0) & ((kind[:-1] & ENDS_WORD) == 0)
            ends = np.cumsum(counts)
            bad[ends[:-1] - 1] = False  # between two texts
            faults = np.concatenate([[0], np.cumsum(bad), [0]])
            good = faults[ends - 1] == faults[ends - counts]
            found.append(at)
            begin[todo[good]], count[todo[good]] = held + (ends - counts)[good], counts[good]
            held += len(at)
            todo = todo[~good]
        rest = np.concatenate([np.flatnonzero(nul), todo])
        whole = texts.take(pa.array(rest)).dictionary_encode()
        found.append(self.numbers(whole.dictionary.to_pylist())[np.asarray(whole.indices)])
        begin[rest], count[rest] = held + np.arange(len(rest)), 1
        return np.concatenate(found)[spans(begin, count)], count

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with ``end_id`` after each text, and the count for each text."""
        self.numbers.trim()
        at, count = self._cut(texts)
        size = self.size[at]
        total = np.add.reduceat(size, np.cumsum(count) - count) + 1 if len(count) else np.zeros(0, np.int64)
        out = np.full(int(total.sum()), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(total) - 1] = False
        out[body] = self.flat[spans(self.first[at], size)]
        return out, total


class _Kinds(dict):
    """Last character of a piece -> what may follow it."""

    def __missing__(self, last):
        word = last.isalnum()
        kind = self[last] = ENDS_WORD * word | ENDS_SAFE * (word or "!" <= last <= "~" or last == "\n")
        return kind


_KINDS = _Kinds()


def _encoder(path: str, limit: int) -> UnitEncoder:
    """One encoder for each Python worker."""
    encoder = kept_in_worker(("token files", path), lambda: UnitEncoder(path))
    encoder.numbers.limit = limit
    return encoder


def write_tokens(df: DataFrame, tokenizer_path: str, out_uri: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", vocabulary: int | None = None, batch_chars: int = 2_000_000, keep_pieces: int = KEEP_PIECES) -> DataFrame:
    """Encode every text, write shards in ascending id order, return ``(shard, uri, n_docs, n_tokens)``.

    Each text gets ``end_id`` at its end; a null or empty text is that id alone.  Null
    ids come first; rows with equal ids are ordered by a hash of the text, and rows that
    repeat id and text are all written.  An empty table writes no shards.  ``out_uri`` is a
    folder that all executors share.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer
        vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    bits = bits_for(vocabulary)

    def write(batches):
        shard = task_number()
        uri = f"{out_uri}/shard-{shard:06d}.tok"
        writer = None
        for b in batches:
            for part in batches_of(b, "text", batch_chars):
                writer = writer or Writer(uri, bits)
                writer.add(part.column("id").to_pylist(), *_encoder(tokenizer_path, keep_pieces).encode(part.column("text"), end_id))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri],
                                              "n_docs": pa.array([len(writer.docs)], pa.int64()),
                                              "n_tokens": pa.array([writer.tokens], pa.int64())})

    rows = picked(df, id_col, text_col)
    spread = rows.repartitionByRange(partitions(df.sparkSession), F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = spread.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long")


def read_tokens(shards: DataFrame, chunk_ids: int = 4_000_000) -> DataFrame:
    """``(id, shard, first, n_tokens, ids_crc32, max_id)`` per document, read from the files of ``shards(shard, uri)``.

    ``first`` is the place of the document's first token in its shard.
    """
    def read(batches):
        for b in batches:
            for shard, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(uri)
                lo, n = 0, len(r.doc_ids)
                while lo < n:  # a few documents at a time
                    hi = max(lo + 1, int(np.searchsorted(r.starts, r.starts[lo] + chunk_ids, "right")) - 1)
                    hi = min(hi, n)
                    ids = r.ids(int(r.starts[lo]), int(r.starts[hi] - r.starts[lo])).astype("<u4")
                    edges = r.starts[lo:hi + 1] - r.starts[lo]
                    raw = memoryview(ids.tobytes())
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(r.doc_ids[lo:hi], pa.int64(), mask=~r.has_id[lo:hi]),
                        "shard": pa.array([shard] * (hi - lo), pa.int64()),
                        "first": pa.array(r.starts[lo:hi], pa.int64()),
                        "n_tokens": pa.array(np.diff(r.starts[lo:hi + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(edges[:-1], edges[1:])], pa.int64()),
                        "max_id": pa.array([int(ids[a:z].max()) if z > a else 0 for a, z in zip(edges[:-1], edges[1:])], pa.int64()),
                    })
                    lo = hi
    spark = shards.sparkSession
    return (shards.select("shard", "uri").repartition(partitions(spark), "shard")
            .mapInArrow(read, "id long, shard long, first long, n_tokens long, ids_crc32 long, max_id long"))


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                out_uri: str | None = None, batch_chars: int = 2_000_000, keep_pieces: int = KEEP_PIECES) -> DataFrame:
    """Write all documents as token files, read them back: ``id, start, n_tokens, ids_crc32, shard, uri``.

    ``start`` counts the tokens of all documents before this one.  Files go to a new
    folder in the checkpoint folder unless ``out_uri`` names one.  ``batch_chars`` and
    ``keep_pieces`` bound what a Python worker holds of texts and of pieces encoded before.
    """
    spark = df.sparkSession
    out_uri = new_folder(spark, "tokens", out_uri)
    shards = cut_lineage(write_tokens(df, tokenizer_path, out_uri, end_id, id_col, text_col,
                                     batch_chars=batch_chars, keep_pieces=keep_pieces))
    # one row for each shard file: their prefix sums are small whatever the corpus
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", "uri", F.coalesce(before, F.lit(0)).alias("offset"))
    docs = read_tokens(shards)
    return docs.join(F.broadcast(offsets), "shard").select(
        "id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard", "uri")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as bit-packed byte-level BPE ids, read back from the files."""
    import public_tokenizers

    out = token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_files": op1_token_files}
SQL = {}

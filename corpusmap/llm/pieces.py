"""Texts cut into pieces that tokenizers treat alone, each different piece numbered once.

A cut comes before a space that follows anything but white space.  Byte-level BPE starts a
new pre-token there, and SentencePiece vocabularies without a piece that goes on after a
word into the next space never merge across it, so the tokens of the pieces, joined, are
the tokens of the text.  Most texts are cut and numbered by Arrow; those with runs of white
space are cut by one regular expression.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters after which a space begins no new piece: white space by any definition, U+2581 and NUL.
NO_CUT_AFTER = r"\0\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581"
SAFE_CUT = re.compile(f"(?<=[^{NO_CUT_AFTER}])(?= )")
_OPEN = {"", *re.findall(f"[{NO_CUT_AFTER}]", "".join(map(chr, range(0x3100))))}


def split_before(texts: pa.Array, marks: dict[str, str]) -> pa.ListArray:
    """The parts of each text after putting a NUL where ``marks`` says (mark -> mark with NULs)."""
    for mark, cut in marks.items():
        texts = pc.replace_substring(texts, mark, cut)
    return pc.split_pattern(texts, "\0")


def numbered(parts: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(different parts, the number of each part, parts of each text)``."""
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), np.diff(np.asarray(parts.offsets)).astype(np.int64)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + count[i] - 1`` of all ``i``, one after the other."""
    count = np.asarray(count, np.int64)
    ends = np.cumsum(count)
    return np.repeat(np.asarray(first, np.int64) - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def distinct(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, times, edges)``: each owner's different keys, ascending, and how often they occur."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    bits = max(1, int(key.max()).bit_length())
    both = owner.astype(np.uint64) << np.uint64(bits) | key.astype(np.uint64)
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    times = np.diff(np.append(first, len(both)))
    both = both[first]
    edges = np.searchsorted(both >> np.uint64(bits), np.arange(n + 1, dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), times, edges


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(different pieces, the number of each piece, pieces of each text)``."""
    nul = pc.match_substring(texts, "\0")
    names, codes, counts = numbered(split_before(pc.if_else(nul, "", texts), {" ": "\0 "}))
    if not len(counts):
        return names, codes, counts
    begin = np.cumsum(counts) - counts
    open_end = np.array([s[-1:] in _OPEN for s in names], bool)
    empty = np.array([not s for s in names], bool)
    unsafe = open_end[codes]
    unsafe[begin + counts - 1] = False       # the end of a text is no cut,
    unsafe[begin[empty[codes[begin]]]] = False  # nor is its beginning
    odd = np.flatnonzero(np.asarray(nul) | (np.add.reduceat(unsafe, begin) > 0))
    if not len(odd):
        return names, codes, counts
    place = {s: i for i, s in enumerate(names)}
    extra, firsts, sizes = [], begin.copy(), counts.copy()
    for i in odd.tolist():
        found = [place.setdefault(p, len(place)) for p in SAFE_CUT.split(texts[i].as_py())]
        firsts[i], sizes[i] = len(codes) + len(extra), len(found)
        extra += found
    codes = np.concatenate([codes, np.array(extra, np.int64)])
    return list(place), codes[spans(firsts, sizes)], sizes


def batches_of(columns: pa.RecordBatch, text: str, chars: int):
    """Parts of an Arrow batch whose texts have at most about ``chars`` bytes (a longer text is a part of its own)."""
    size = np.asarray(pc.binary_length(columns.column(text))).astype(np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chars, "right")))
        yield columns.slice(i, j - i)
        i = j


class Numbers:
    """Piece -> its number; ``learn`` is told the new ones in order."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.known, self.chars = learn, limit, {}, 0

    def trim(self):
        """Forget all if there are more than ``limit``, or of more than 32 characters on average; ``learn(None)`` says so."""
        if len(self.known) > self.limit or self.chars > 32 * self.limit:
            self.known, self.chars = {}, 0
            self.learn(None)

    def __call__(self, names: list[str]) -> np.ndarray:
        """The numbers of different ``names``."""
        get, before = self.known.get, len(self.known)
        at = np.array([get(s, -1) for s in names], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(before, before + len(new))
            fresh = [names[i] for i in new.tolist()]
            self.known.update(zip(fresh, range(before, before + len(fresh))))
            self.chars += sum(map(len, fresh))
            self.learn(fresh)
        return at

"""External induced sorting of the suffixes of one shard.

The text is a string of integers whose last symbol is the only smallest one.  A suffix is
of type S if it is smaller than the next suffix, else of type L; an S after an L is a
*seed*.  Seeds are sorted by recursion on the string of their names; all other suffixes
follow from them: the sorted suffixes are visited in order, and each visit puts the suffix
one place to the left into a queue under its first symbol.  What is put under one symbol
arrives in sorted order, so the queue never sorts by more than that symbol.

Texts, types, seeds, names, orders, counts and the queue live in files of a scratch folder
once they pass ``MEMORY`` bytes, and are worked through in chunks.  The queue has a part in
memory at a time, of about a 64th of ``MEMORY`` suffixes, and works through BLOCK suffixes
at once with numpy; a symbol with more suffixes than a part is read from its file by chunks.

Seeds that fit into ``MEMORY`` end the recursion: their substrings are named by comparing
several symbols at once, and the string of names is sorted by doubling the compared prefix.
All other suffixes of the level are induced from them as ever.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

MEMORY = 64 << 20
PARTS, BLOCK = 64, 4096
CHUNK = 1 << 20
SEED_BYTES = 48  # of memory for each seed sorted without recursion
NONE = np.iinfo(np.int64).max


class Scratch:
    """Arrays in memory, or in files of ``folder`` when they are large."""

    def __init__(self, folder: str, memory: int = MEMORY):
        self.folder, self.memory = folder, memory

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def path(self) -> str:
        return os.path.join(self.folder, uuid.uuid4().hex)

    def free(self, *arrays):
        for a in arrays:
            if isinstance(a, np.memmap):
                os.unlink(a.filename)


class _Log:
    """Numbers appended in order; beyond ``most`` bytes in memory they go to a file."""

    def __init__(self, scratch: Scratch, most: int):
        self.scratch, self.most, self.parts, self.held, self.path = scratch, most, [], 0, None

    def add(self, a: np.ndarray):
        self.parts.append(a)
        self.held += a.nbytes
        if self.held > self.most:
            self._write()

    def _write(self):
        self.path = self.path or self.scratch.path()
        with open(self.path, "ab") as file:  # open only now: there may be many logs
            if self.parts:
                np.concatenate(self.parts).astype(np.int64).tofile(file)
        self.parts, self.held = [], 0

    def take(self) -> np.ndarray:
        """All that was added, in order (still in its file if that is large); the log is empty afterwards."""
        if self.path:
            self._write()
            found = np.memmap(self.path, np.int64, "r+")
            if found.nbytes <= self.scratch.memory:
                kept = np.array(found)
                self.scratch.free(found)
                found = kept
        else:
            found = np.concatenate([*self.parts, np.zeros(0, np.int64)]).astype(np.int64)
        self.parts, self.held, self.path = [], 0, None
        return found

    def drain(self, step: int):
        """All that was added, also meanwhile, in chunks of about ``step``; the log is empty afterwards."""
        at = 0
        while True:
            if self.path and os.path.getsize(self.path) > at:
                some = np.fromfile(self.path, np.int64, step, offset=at)
                at += some.nbytes
                yield some
            elif self.parts:
                some, self.parts, self.held = np.concatenate(self.parts).astype(np.int64), [], 0
                for a in range(0, len(some), step):
                    yield some[a:a + step]
            else:
                break
        if self.path:
            os.unlink(self.path)
            self.path = None


def _types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True for S."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    follow = True  # type of the position after the chunk
    for z in range(n - 1, 0, -CHUNK):
        a = max(0, z - CHUNK)
        now, after = text[a:z].astype(np.int64), text[a + 1:z + 1].astype(np.int64)
        step = np.sign(after - now)
        step = np.append(step, 1 if follow else -1)
        at = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        out[a:z] = step[nearest][:-1] > 0
        follow = bool(out[a])
    return out


def _edges(counts: np.ndarray, most: int) -> np.ndarray:
    """Symbols at which parts of about ``most`` suffixes begin, the number of symbols last; a symbol with more is a part."""
    found, last, total = [], -1, 0
    for a in range(0, len(counts), CHUNK):
        n = np.asarray(counts[a:a + CHUNK])
        part = (total + np.cumsum(n) - n) // max(1, most)
        heavy = np.flatnonzero(n > most)
        found.append(a + np.union1d(np.flatnonzero(np.diff(part, prepend=last) > 0), np.append(heavy, heavy + 1)))
        last, total = part[-1], total + int(n.sum())
    return np.unique(np.append(np.concatenate(found), len(counts)))


def _induce(text, stype, seeds, symbols_of, counts, down: bool, scratch: Scratch) -> np.ndarray:
    """Visit ``seeds`` (in sorted order) and all that they induce; the induced suffixes in order.

    ``down``: from the largest to the smallest, inducing type S; else up, inducing type L.
    Under one symbol the induced come before the seeds, in either direction.
    """
    sigma = len(counts)
    rank = (lambda s: sigma - 1 - s) if down else (lambda s: s)
    sized = counts[::-1] if down else counts
    part = max(BLOCK, scratch.memory // PARTS)  # suffixes
    supers = _edges(sized, part)
    most = scratch.memory // (2 * len(supers))
    far = [_Log(scratch, most) for _ in range(len(supers) - 1)]
    out, at = _Log(scratch, scratch.memory // PARTS), 0

    def aims(pos):
        """The key under which each suffix puts the one to its left; NONE if it puts none."""
        left = np.maximum(pos - 1, 0)
        return np.where((pos > 0) & (stype[left] == down), rank(symbols_of(left)) * 2, NONE)

    def safe(key, aim):
        """How many of the pending suffixes may be visited before what they induce joins in."""
        a, least = 0, NONE
        while a < len(key):
            z = min(len(key), a + 512 + a)
            low = np.minimum(np.minimum.accumulate(aim[a:z]), least)
            over = key[a:z] > low
            n = int(over.argmax())
            if over[n]:
                return a + n
            least, a = low[-1], z
        return a

    def place(near, edges, pos, keys):
        """Append to the parts of ``edges``, in order."""
        part = np.searchsorted(edges, keys, "right") - 1
        by = np.argsort(part, kind="stable")
        part, pos = part[by], pos[by]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for a, z in zip(cut, np.append(cut[1:], len(part))):
            near(part[a], pos[a:z])

    def seed_chunks(limit):
        """The next seeds with keys below ``limit``."""
        nonlocal at
        while at < len(seeds):
            some = np.asarray(seeds[at:at + BLOCK]).astype(np.int64)
            keys = rank(symbols_of(some))
            n = int(np.searchsorted(keys, limit))
            at += n
            if n:
                yield some[:n]
            if n < len(some):
                break

    def seeds_until(limit):
        return np.concatenate([*seed_chunks(limit), np.zeros(0, np.int64)])

    def put(new, symbol):
        """Queue ``new`` under their symbols: in the part in memory, or in the logs of the others."""
        near = symbol < edges[-1]
        if near.any():
            place(lambda p, x: inner[p].append(x), edges, new[near], symbol[near])
        if not near.all():
            place(lambda p, x: far[p].add(x), supers, new[~near], symbol[~near])

    def pass_on(pos):
        """Queue what ``pos``, all under one symbol, induce."""
        aim = aims(pos)
        wanted = aim < NONE
        put(pos[wanted] - 1, aim[wanted] // 2)

    for s in range(len(supers) - 1):
        if supers[s + 1] - supers[s] == 1 and sized[supers[s]] > BLOCK:
            # one symbol: its induced suffixes come in the order of its queue, and what they
            # put under the same symbol joins its end; its seeds induce under later ones
            edges, inner = supers[:1], []
            for some in far[s].drain(max(BLOCK, CHUNK // 16)):
                out.add(some)
                pass_on(some)
            for some in seed_chunks(supers[s + 1]):
                pass_on(some)
            continue
        edges = supers[s] + _edges(sized[supers[s]:supers[s + 1]], BLOCK)
        inner = [[] for _ in range(len(edges) - 1)]
        pos = np.asarray(far[s].take())
        if len(pos):
            place(lambda p, x: inner[p].append(x), edges, pos, rank(symbols_of(pos)))
        for b in range(len(edges) - 1):
            if edges[b + 1] - edges[b] == 1:  # in the same way, in memory
                while inner[b]:
                    pending, inner[b] = np.concatenate(inner[b]), []
                    out.add(pending)
                    pass_on(pending)
                for some in seed_chunks(edges[b + 1]):
                    pass_on(some)
                continue
            pending = np.concatenate([*inner[b], np.zeros(0, np.int64)])
            inner[b] = []
            fresh = seeds_until(edges[b + 1])
            pos = np.concatenate([pending, fresh])
            key = np.concatenate([rank(symbols_of(pending)) * 2, rank(symbols_of(fresh)) * 2 + 1])
            by = np.argsort(key, kind="stable")
            pos, key = pos[by], key[by]
            aim = aims(pos)
            while len(pos):
                n = safe(key, aim)  # these come before anything they induce
                out.add(pos[:n][key[:n] % 2 == 0])
                wanted = aim[:n] < NONE
                new, new_key = pos[:n][wanted] - 1, aim[:n][wanted]
                here = new_key < 2 * edges[b + 1]
                pos, key, aim = pos[n:], key[n:], aim[n:]
                if not here.all():
                    put(new[~here], new_key[~here] // 2)
                    new, new_key = new[here], new_key[here]
                if len(new):
                    pos, key, aim = np.concatenate([pos, new]), np.concatenate([key, new_key]), np.concatenate([aim, aims(new)])
                    by = np.argsort(key, kind="stable")
                    pos, key, aim = pos[by], key[by], aim[by]
    return out.take()


def _all(text, stype, seeds, scratch):
    """``(order of L suffixes, order of S suffixes)`` induced from sorted seeds."""
    counts = _counts(text, scratch)
    symbols_of = lambda pos: text[pos].astype(np.int64)
    large = _induce(text, stype, seeds, symbols_of, counts, False, scratch)
    # the last suffix has nothing after it: visited first going up, never induced
    small = _induce(text, stype, large[::-1], symbols_of, counts, True, scratch)[::-1]
    scratch.free(counts)
    return large, small


def _chunks(n: int):
    return ((a, min(n, a + CHUNK)) for a in range(0, n, CHUNK))


def _counts(text, scratch, at=None) -> np.ndarray:
    """How often each symbol comes, in the text or at the places ``at``."""
    total = scratch.array(max(int(text[a:z].max()) for a, z in _chunks(len(text))) + 1, np.int64)
    for a, z in _chunks(len(text if at is None else at)):
        some = text[a:z] if at is None else text[at[a:z]]
        if len(total) <= CHUNK:
            total += np.bincount(some, minlength=len(total))
        else:
            symbol, n = np.unique(some, return_counts=True)
            total[symbol] += n
    return total


def _before(counts, scratch) -> np.ndarray:
    """The sum of the counts before each."""
    out, total = scratch.array(len(counts), np.int64), 0
    for a, z in _chunks(len(counts)):
        n = np.asarray(counts[a:z])
        out[a:z] = total + np.cumsum(n) - n
        total += int(n.sum())
    return out


def _names(text, starts, order, scratch):
    """``(names, the largest)`` of the seeds' substrings (up to the next seed), by their sorted order: equal ones get equal names."""
    n = len(starts)
    name, last = scratch.array(n, np.int64), -1
    for a, z in _chunks(n):
        first = np.asarray(order[max(0, a - 1):z])  # with the one before the chunk
        slot = np.searchsorted(starts, first)
        length = np.asarray(starts[np.minimum(slot + 1, n - 1)]) + 1 - first
        differ = np.ones(len(first), bool)
        differ[1:] = length[1:] != length[:-1]
        left = np.flatnonzero(~differ)
        step = 0
        while len(left):
            unequal = text[first[left] + step] != text[first[left - 1] + step]
            differ[left[unequal]] = True
            left = left[~unequal]
            step += 1
            left = left[length[left] > step]
        own = slice(min(a, 1), None)
        found = last + np.cumsum(differ[own])
        name[slot[own]] = found
        last = int(found[-1])
    return name, last


def _seeds(stype, scratch) -> np.ndarray:
    """The places of the seeds, from left to right."""
    def found():
        for a, z in _chunks(len(stype) - 1):
            yield a + 1 + np.flatnonzero(np.asarray(stype[a + 1:z + 1]) & ~np.asarray(stype[a:z]))

    out, at = scratch.array(sum(map(len, found())), np.int64), 0
    for some in found():
        out[at:at + len(some)] = some
        at += len(some)
    return out


def _by_symbol(text, starts, scratch) -> np.ndarray:
    """``starts`` stably sorted by their first symbols."""
    counts = _counts(text, scratch, starts)
    free = _before(counts, scratch)  # the next place of each symbol
    out = scratch.array(len(starts), np.int64)
    for a, z in _chunks(len(starts)):
        some = np.asarray(starts[a:z])
        symbol = text[some].astype(np.int64)
        by = np.argsort(symbol, kind="stable")
        some, symbol = some[by], symbol[by]
        first = np.flatnonzero(np.diff(symbol, prepend=-1))
        n = np.diff(np.append(first, len(symbol)))
        out[free[symbol] + np.arange(len(symbol)) - np.repeat(first, n)] = some
        free[symbol[first]] += n
    scratch.free(counts, free)
    return out


def _base(a):
    return a.base if isinstance(a.base, np.memmap) else a


def _packed(text, at, left, bits, many) -> np.ndarray:
    """The next ``many`` symbols of each place as one number; where fewer are ``left``, the largest symbol fills up."""
    out, last = np.zeros(len(at), np.int64), len(text) - 1
    for j in range(many):
        out = out << bits | np.where(left > j, text[np.minimum(at + j, last)].astype(np.int64), (1 << bits) - 1)
    return out


def _split(order, rank, live, key) -> np.ndarray:
    """Sort the groups at the places ``live`` of ``order`` by ``key``; the places that are still in groups of several.

    The rank of all in a group is its first place.
    """
    item = order[live]
    group, width = rank[item].astype(np.int64), int(key.max()) + 1
    if width < (1 << 62) // (int(group[-1]) + 1):
        by = np.argsort(group * width + key)
    else:
        by = np.lexsort((key, group))
    item, group, key = item[by], group[by], key[by]
    order[live] = item
    new = np.ones(len(live) + 1, bool)
    new[1:-1] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    rank[item] = np.maximum.accumulate(np.where(new[:-1], live, 0))
    return live[~(new[:-1] & new[1:])]


def _short_named(text, starts):
    """:func:`_names` in memory, without an order: several symbols of all substrings at a time, then of those still equal.

    A substring that goes on where another ends is the smaller one: it goes on with type L, the other ends with type S.
    """
    n = len(starts)
    left = np.diff(starts, append=len(text) - 1) + 1
    bits = (max(int(text[a:z].max()) for a, z in _chunks(len(text))) + 1).bit_length()
    many = 63 // bits
    order, rank, live = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    step = 0
    while len(live):
        item = order[live]
        live = _split(order, rank, live, _packed(text, starts[item] + step, left[item] - step, bits, many))
        step += many
        live = live[left[order[live]] >= step]  # none of a group of equals, or all
    head = np.zeros(n, np.int32)
    head[rank] = 1
    name = np.cumsum(head, dtype=np.int32)[rank] - 1
    return name, int(name.max())


def _doubled(text, most: int) -> np.ndarray:
    """The suffixes' positions in sorted order, in memory; the last symbol is the only smallest one."""
    n, bits = len(text), (most + 1).bit_length()
    order, rank, live = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    step = 63 // bits
    live = _split(order, rank, live, _packed(text, order, n - order, bits, step))
    while len(live):  # equal so far, so the last symbol lies beyond
        live = _split(order, rank, live, rank[order[live] + step].astype(np.int64))
        step *= 2
    return order


def suffix_order(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The suffixes' positions in sorted order."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    stype = _types(text, scratch)
    starts = _seeds(stype, scratch)
    if len(starts) * SEED_BYTES <= scratch.memory:
        seeds = starts[_doubled(*_short_named(text, starts))]
    else:
        seeds = _sorted_seeds(text, stype, starts, scratch)
    scratch.free(starts)
    large, small = _all(text, stype, seeds, scratch)
    scratch.free(stype, seeds)
    out = scratch.array(n, np.int64)
    out[0] = n - 1
    # under each symbol, L comes before S; the last suffix is the first of all
    counts, counts_large = _counts(text, scratch), _counts(text, scratch, large)
    begin, large_before = _before(counts, scratch), _before(counts_large, scratch)
    # among its own kind a suffix keeps its order: its place shifts by the others before it
    for own, skip in ((large, 0), (small, 1)):
        for a, z in _chunks(len(own)):
            some = np.asarray(own[a:z])
            symbol = text[some]
            shift = counts_large[symbol] + large_before[symbol] if skip else begin[symbol] - large_before[symbol]
            out[np.arange(a, z) + skip + shift] = some
    scratch.free(large, _base(small), counts, counts_large, begin, large_before)
    return out


def _sorted_seeds(text, stype, starts, scratch) -> np.ndarray:
    """The seeds in sorted order, by recursion on their names; no array needs to fit into memory."""
    rough = _by_symbol(text, starts, scratch)
    large, small = _all(text, stype, rough, scratch)
    scratch.free(rough)
    order, at = scratch.array(len(starts), np.int64), 1
    order[0] = len(text) - 1
    for a, z in _chunks(len(small)):
        some = np.asarray(small[a:z])
        some = some[(some > 0) & ~np.asarray(stype[np.maximum(some - 1, 0)])]
        order[at:at + len(some)] = some
        at += len(some)
    scratch.free(large, _base(small))
    name, most = _names(text, starts, order, scratch)
    scratch.free(order)
    seeds = scratch.array(len(starts), np.int64)
    if most + 1 < len(starts):
        short = scratch.array(len(name), np.uint16 if most < 65536 else np.uint32)
        for a, z in _chunks(len(name)):
            short[a:z] = name[a:z]
        scratch.free(name)
        inner = suffix_order(short, scratch)
        for a, z in _chunks(len(inner)):
            seeds[a:z] = starts[inner[a:z]]
        scratch.free(short, inner)
    else:
        for a, z in _chunks(len(name)):
            seeds[name[a:z]] = starts[a:z]
        scratch.free(name)
    return seeds


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` share ``length`` symbols; all must be that long."""
    width = 8 // data.itemsize
    if length >= width:  # as many symbols as fill eight bytes at once, from any place on
        data = np.ndarray(len(data) - width + 1, np.uint64, data, strides=data.strides)
    else:
        width = 1
    live = np.arange(len(a))
    for step in [*range(0, length - width, width), length - width]:
        live = live[data[a[live] + step] == data[b[live] + step]]
    same = np.zeros(len(a), bool)
    same[live] = True
    return same

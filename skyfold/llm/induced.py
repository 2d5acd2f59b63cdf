"""Suffix arrays by induced sorting and permuted common prefixes, over the byte strings of one shard.

Suffixes are classified, leftmost smaller pieces are sorted and named, the string of
names is sorted in the same way, and its order induces that of all suffixes. A
shard's array is induced bucket by bucket, in linear time: what a bucket holds is a
batch, and all suffixes that a batch induces are placed at once. A string of names
has nearly as many letters as places, so its batches would be single suffixes; its
suffixes are induced side by side instead.
"""

from __future__ import annotations

import numpy as np

#: A string with fewer places than this for each letter is induced side by side.
PLACES = 1000


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last place counts as smaller."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        step = text[1:] != text[:-1]
        differ = np.where(step, np.arange(n - 1), n - 1)
        next_step = np.minimum.accumulate(differ[::-1])[::-1]
        rise = np.append(text[1:] > text[:-1], True)
        out[:-1] = rise[next_step]
    return out


def _placed(text, at, slots, step):
    """Places and order for the suffixes ``at`` (in order) in the buckets of their letters; moves the slots on."""
    letters = text[at]
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    cut = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
    counts = np.diff(np.append(cut, len(letters)))
    own = letters[cut]
    inside = np.arange(len(letters)) - np.repeat(cut, counts)
    if step > 0:
        places = np.repeat(slots[own], counts) + inside
        slots[own] += counts
    else:
        places = np.repeat(slots[own], counts) - 1 - inside
        slots[own] -= counts
    return places, at[order]


def _induce_batches(text, size, small, lms):
    """The suffix array that the leftmost smaller suffixes, in the given order, induce."""
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = np.concatenate(([0], ends[:-1]))
    heads, tails = starts.copy(), ends.copy()
    sa = np.empty(len(text), np.int32)
    used = np.flatnonzero(ends > starts)
    letters = text[lms]
    by = np.argsort(letters, kind="stable")
    seeds, cuts = lms[by].astype(np.int32), np.searchsorted(letters[by], np.arange(size + 1))

    def larger(batch):
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before):
            places, at = _placed(text, before, heads, 1)
            sa[places] = at

    def smaller(batch):
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            places, at = _placed(text, before, tails, -1)
            sa[places] = at

    for c in used.tolist():
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            larger(sa[done:upto])
            done = upto
        larger(seeds[cuts[c] : cuts[c + 1]])
    sa[0] = len(text) - 1  # the last place is smaller, and no suffix induces it
    for c in used[::-1].tolist():
        done = ends[c]
        while tails[c] < done:
            upto = tails[c]
            smaller(sa[upto:done][::-1])
            done = upto
        smaller(sa[starts[c] : heads[c]][::-1])
    return sa


def _induce_ranks(text, size, small, lms, wanted):
    """The suffixes ``wanted`` in the order that the leftmost smaller suffixes, in the given order, induce.

    A suffix is known by its letters and types up to the next leftmost smaller
    suffix, and by that one's rank. Two suffixes that agree in letters and types so
    far meet such a suffix at the same distance, so all are sorted side by side, a
    letter at a time, and only those still alike go on.
    """
    n = len(text)
    letters = text.astype(np.int64) * 2 + small
    rank = np.zeros(n, np.int64)
    rank[lms] = np.arange(1, len(lms) + 1)
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    nexts = np.append(places, n - 1)
    until = nexts[np.searchsorted(places, wanted, side="right")] - wanted
    span = max(2 * size, n + 1)
    sa, ends = wanted.astype(np.int64), until
    group = np.zeros(len(sa), np.int64)
    active = np.arange(len(sa))
    step = 0
    while len(active):
        at, left = sa[active], ends[active] - step
        letter = letters[np.minimum(at + step, n - 1)]
        key = group[active] * span + np.where(left >= 0, letter, rank[at + ends[active]])
        by = np.argsort(key)
        key = key[by]
        sa[active], ends[active] = at[by], ends[active][by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(key)))
        group[active] = np.repeat(active[first], sizes)
        active = active[(np.repeat(sizes, sizes) > 1) & (ends[active] >= step)]
        step += 1
    return sa


def _same_pieces(text: np.ndarray, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether text[a : a + n] equals text[b : b + n] for each a, b, n (n at least 1)."""
    out = np.empty(len(lengths), bool)
    at = 0
    while at < len(lengths):  # some million letters at a time
        upto = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), 1 << 21)) + at)
        n = lengths[at:upto]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        differ = text[np.repeat(first[at:upto], n) + inside] != text[np.repeat(second[at:upto], n) + inside]
        out[at:upto] = ~np.logical_or.reduceat(differ, begin)
        at = upto
    return out


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of all suffixes in order; letters are 0 to size - 1, and the last one is 0 and occurs nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = small_types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) == 0:
        return np.argsort(text, kind="stable")
    dense = n >= PLACES * size
    if dense:
        ordered = _induce_batches(text, size, small, lms)
        ordered = ordered[is_lms[ordered]].astype(np.int64)
    else:
        ordered = _induce_ranks(text, size, small, lms[:0], lms)
    # a piece runs to the next leftmost smaller place, which it includes
    length = np.empty(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    equal = np.flatnonzero(length[a] == length[b])
    new = np.ones(len(ordered), bool)
    new[1 + equal] = ~_same_pieces(text, a[equal], b[equal], length[a[equal]])
    names = np.cumsum(new) - 1
    if names[-1] + 1 < len(ordered):
        rank = np.empty(n, np.int32)
        rank[ordered] = names
        ordered = lms[suffix_array(rank[lms], int(names[-1]) + 1)]
    return _induce_batches(text, size, small, ordered) if dense else _induce_ranks(text, size, small, ordered, np.arange(n))


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as letters, each ended by 1 and all by 0, and where each starts (and the last ends)."""
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text = np.empty(len(raw) + 1, np.uint16)
    text[:-1] = raw
    text += 2
    borders = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    text[borders[1:] - 1] = 1
    text[-1] = 0
    return text, borders


def common_prefixes(text: np.ndarray, sa: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """For each place the length of its common prefix with the suffix before it in order, inside its string.

    Permuted order: from a place to the next one the length falls by one at most,
    so it is carried along; all strings of the shard take this walk side by side.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    # eight letters at a time; a border is a letter that equals no other, not even another border
    raw = np.zeros(n + 8, np.uint8)
    raw[:n] = np.maximum(text, 2) - 2
    words = np.ndarray((n,), np.uint64, raw.data, 0, (1,))
    room = np.empty(n, np.int64)
    for_each = np.diff(borders)
    room[: borders[-1]] = np.repeat(borders[1:] - 1, for_each) - np.arange(borders[-1])
    room[borders[-1] :] = 0
    out = np.zeros(n, np.int64)
    order = np.argsort(-for_each, kind="stable")
    firsts, lengths = borders[:-1][order], (for_each - 1)[order]
    have = np.zeros(len(firsts), np.int64)
    alive = len(firsts)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while alive and lengths[alive - 1] <= step:
            alive -= 1
        at = firsts[:alive] + step
        other = before[at]
        got = np.maximum(have[:alive] - 1, 0)
        most = np.where(other >= 0, np.minimum(room[at], room[other]), 0)
        open_ = np.flatnonzero(got < most)
        while len(open_):
            x = words[at[open_] + got[open_]] ^ words[other[open_] + got[open_]]
            low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
            same = np.where(x == 0, 8, (np.frexp(low)[1] - 1) >> 3)
            got[open_] = np.minimum(got[open_] + same, most[open_])
            open_ = open_[(same == 8) & (got[open_] < most[open_])]
        out[at] = got
        have[:alive] = got
    return out


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string its places from which ``width`` bytes also start at another place of the strings."""
    if not strings:
        return []
    text, borders = joined(strings)
    sa = suffix_array(text, 258)
    prefix = common_prefixes(text, sa, borders)
    long = prefix >= width
    hit = long.copy()
    follows = np.flatnonzero(long[sa])
    hit[sa[follows - 1]] = True
    return [np.flatnonzero(hit[a : b - 1]) for a, b in zip(borders[:-1], borders[1:], strict=True)]

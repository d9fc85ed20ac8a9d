"""Suffix arrays and common prefixes of byte strings in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson and Sadakane's refinement: suffixes are sorted by their first bytes, then only groups that are not
    settled are sorted again by the rank of what follows, which doubles the compared length each time."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    place = np.int32 if n < 1 << 31 else np.int64
    width = 5  # bytes of the first sort, beside the position in one number while n allows it
    padded = np.concatenate([data.astype(np.uint16) + np.uint16(1), np.zeros(width, dtype=np.uint16)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        key *= np.uint64(257)
        key += padded[k:k + n]  # a suffix that ends sorts first
    order = sorted_by(key, 41, n).astype(place)
    del padded
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    first = np.flatnonzero(head).astype(place)
    rank = np.empty(n + 1, dtype=place)  # a group's rank is the place of its last member, plus one
    ends = np.concatenate([first[1:], [n]])
    rank[order] = np.repeat(ends, ends - first)
    rank[n] = 0
    open_at = np.flatnonzero(np.repeat(ends - first > 1, ends - first)).astype(place)  # places in groups of two or more
    depth, bits = width, max(1, int(n).bit_length())
    while len(open_at):
        own = order[open_at]
        group, follow = rank[own], rank[np.minimum(own + depth, n)]
        key = group.astype(np.uint64)
        key <<= np.uint64(bits)
        key |= follow.astype(np.uint64)
        del group, follow
        turn = sorted_by(key, 2 * bits, len(own))
        order[open_at] = own = own[turn]
        key = key[turn]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(head)
        size = np.diff(np.concatenate([first, [len(own)]]))
        last = open_at[first + size - 1] + 1
        rank[own] = np.repeat(last, size)
        open_at = open_at[np.repeat(size > 1, size)]
        depth *= 2
    return order


def sorted_by(key: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Order of the keys; key and position are sorted as one number where 64 bits hold both."""
    room = max(1, (n - 1).bit_length())
    if bits + room <= 64:
        packed = key << np.uint64(room)
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        packed &= np.uint64((1 << room) - 1)
        return packed.astype(np.int64)
    return np.argsort(key, kind="stable")


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes: for each place in the array, bytes shared with the suffix before it.

    In text order a value falls by at most one, and by exactly one where the
    bytes in front agree; only the other places are compared, eight bytes at a time.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    place = np.int32 if n < 1 << 31 else np.int64
    before = np.empty(n, dtype=place)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=place)
    left_at, left_before = np.maximum(at - 1, 0), np.maximum(before - 1, 0)
    falls = (at > 0) & (before > 0) & (data[left_at] == data[left_before])
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.zeros(n + 8, dtype=np.uint64)
    for k in range(8):
        eight |= padded[k:k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    found = np.zeros(n, dtype=place)
    places = np.flatnonzero(~falls & (before >= 0)).astype(place)
    a, b, done = places, before[places], np.zeros(len(places), dtype=place)
    live = np.arange(len(places))
    while len(live):
        x, y = a[live] + done[live], b[live] + done[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        differ = eight[x] ^ eight[y]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        done[live] += np.minimum(same, n - np.maximum(x, y)).astype(place)
        live = live[(differ == 0)]
    found[places] = done
    # Places that fall by one: the last compared value less the distance.
    anchor = np.maximum.accumulate(np.where(falls, 0, at))
    found = np.where(falls, found[anchor] - (at - anchor), found)
    return found[order]

"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search in another shard."""

from __future__ import annotations

import numpy as np

#: 2**8 to 2**56.
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def words8(text: np.ndarray) -> np.ndarray:
    """Big-endian integer of the 8 bytes from each position on (zeros beyond the end)."""
    t = np.zeros(len(text) + 8, np.uint64)
    t[: len(text)] = text
    v = t[: len(text)]
    for width in (1, 2, 4):
        shifted = np.zeros(len(t), np.uint64)
        shifted[:-width] = t[width:]
        t = (t << np.uint64(8 * width)) | shifted
        v = t[: len(text)]
    return v


def suffix_array(text: np.ndarray, depth: int, past: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text (uint8) by their first `depth` bytes (at least 8), and which slots are tied with the one before. Starts from 8 bytes and doubles, or trebles; only groups that are still tied are sorted again.

    past: how far each position lies beyond the last one, at or before it, whose order is wanted. It is then ordered by that much less only, as no wanted one looks further; it may lie anywhere in its group, and so parts nothing that is tied.
    """
    n = len(text)
    v = words8(text)
    sa = np.argsort(v).astype(np.int32)
    head = np.ones(n, bool)
    head[1:] = np.diff(v[sa]) != 0
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, at, 0))
    base, h = n + 1, 8
    while h < depth:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        # one further rank doubles what is known of a suffix; two, where three fit a number, treble it
        steps = [min(h, depth - h)]
        if base**3 < 1 << 63 and steps[0] == h:
            steps.append(min(2 * h, depth - h))
        if past is not None:
            slots = slots[past[sa[slots]] + h + steps[-1] <= depth]
        if not len(slots):
            if past is None:
                break
            h += steps[-1]
            continue
        pos = sa[slots]
        key = rank[pos].astype(np.int64)
        for step in steps:
            key = key * base + np.where(pos < n - step, rank[np.minimum(pos + step, n - 1)] + 1, 0)
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[slots] = pos
        head[slots[1:]] |= key[1:] != key[:-1]
        rank[pos] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        h += steps[-1]
    return sa, ~head


def common_prefix(text8: np.ndarray, other8: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most`, of the suffixes at a (of text8) and b (of other8), of which `known` bytes are known equal."""
    got = known.copy()
    live = np.flatnonzero(got < most)
    while len(live):
        i, j = a[live] + got[live], b[live] + got[live]
        inside = (i < len(text8)) & (j < len(other8))
        x = np.where(inside, text8[np.minimum(i, len(text8) - 1)] ^ other8[np.minimum(j, len(other8) - 1)], ~np.uint64(0))
        same = np.full(len(x), 8)
        differ = x != 0
        same[differ] = 7 - np.searchsorted(_BYTES, x[differ], side="right")
        room = np.minimum(len(text8) - i, len(other8) - j).clip(0)
        got[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8) & (got[live] < most)]
    return np.minimum(got, most)


def kasai(text: np.ndarray, sa: np.ndarray, tied: np.ndarray, most: int, wanted: np.ndarray | None = None, lane: int = 32) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix with the one before it in sa. In text order the value falls by one at most, so each comparison starts where the last one ended; `lane` long stretches of the text go side by side. Tied suffixes share `most` bytes, and nothing follows from their order; those that aren't wanted, if given, have 0."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    v = words8(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    whole = np.zeros(n, bool)
    whole[sa] = tied
    out, firsts = np.zeros(n, np.int64), np.arange(0, n, lane)
    got = np.zeros(len(firsts), np.int64)
    for k in range(min(lane, n)):
        i = firsts + k
        i, got = i[i < n], got[: int((firsts + k < n).sum())]
        j = before[i]
        got = np.where(j >= 0, got, 0)
        got = np.where(whole[i], most, got)
        ok = (j >= 0) & ~whole[i]
        if wanted is not None:
            ok &= wanted[i]
            got = np.where(ok | whole[i], got, 0)
        if ok.any():
            got[ok] = common_prefix(v, v, i[ok], j[ok], got[ok], most)
        out[i] = got
        got = np.where(whole[i], 0, np.maximum(got - 1, 0))
    return out[sa]


def find(text: np.ndarray, sa: np.ndarray, other: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Binary search: for each suffix of `other` at starts, the slot in sa whose suffix of `text` has the same first `depth` bytes, or -1."""
    t, o = words8(text), words8(other)
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa))
    zero = np.zeros(len(starts), np.int64)

    def below(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sa[slots]
        same = common_prefix(t, o, p, starts, zero, depth)
        a = np.where(p + same < len(text), text[np.minimum(p + same, len(text) - 1)].astype(np.int64), -1)
        b = np.where(starts + same < len(other), other[np.minimum(starts + same, len(other) - 1)].astype(np.int64), -1)
        return (same < depth) & (a < b), same

    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less, _ = below(np.minimum(mid, len(sa) - 1))
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    _, same = below(np.minimum(lo, len(sa) - 1))
    return np.where((lo < len(sa)) & (same >= depth), lo, -1)

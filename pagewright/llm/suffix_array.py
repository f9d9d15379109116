"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search of one shard in another."""

from __future__ import annotations

import numpy as np

U = np.uint64


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, first byte highest; zeros after the end."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (t[:-1] << U(8)) | t[1:]
    four = (two[:-2] << U(16)) | two[2:]
    return ((four[:-4] << U(32)) | four[4:])[: len(text)]


def suffix_array(text: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first depth bytes at least. Groups of suffixes that agree so far are refined by
    the rank of what follows, twice as far each time; groups of one are not touched again."""
    n = len(text)
    keys = packed(text) if keys is None else keys
    sa = np.argsort(keys, kind="stable").astype(np.int64)
    first = keys[sa]
    head = np.ones(n, bool)
    head[1:] = first[1:] != first[:-1]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0))
    h = 8
    while h < depth:
        alone = head.copy()
        alone[:-1] &= head[1:]
        act = np.flatnonzero(~alone)
        if not len(act):
            break
        suffix = sa[act]
        after = suffix + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[suffix].astype(np.uint64) << U(32)) | second.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        suffix, key = suffix[order], key[order]
        sa[act] = suffix
        new = np.ones(len(act), bool)
        new[1:] = key[1:] != key[:-1]
        head[act] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, act, 0))
        h *= 2
    return sa


def _equal_bytes(keys: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, eight bytes at a time."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    room = n - np.maximum(a, b)
    while len(live):
        at = out[live]
        inside = at < room[live]
        live, at = live[inside], at[inside]
        if not len(live):
            break
        x = keys[a[live] + at] ^ keys[b[live] + at]
        same = x == 0
        out[live[same]] += 8
        stop, x = live[~same], x[~same]
        for j in range(7):
            out[stop] += (x >> U(56 - 8 * j)) == 0
        live = live[same]
    return np.minimum(out, room)


def common_prefixes(text: np.ndarray, sa: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Kasai: lcp[k] of the suffixes sa[k-1] and sa[k] (lcp[0] is 0). In text order a common prefix is one shorter
    than that of the position before wherever both neighbours moved on by one; only the others are compared."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] > 0) & (phi[:-1] >= 0) & (phi[1:] == phi[:-1] + 1)
    at = np.flatnonzero(follows)
    follows[at] = text[at - 1] == text[phi[at] - 1]
    starts = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    real = starts[phi[starts] >= 0]
    length[real] = _equal_bytes(keys, n, real, phi[real])
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    plcp = length[last] - (np.arange(n) - last)
    return plcp[sa]


class Shard:
    """A suffix array over some texts of which certain starts are asked about."""

    def __init__(self, text: np.ndarray, asked: np.ndarray, width: int):
        keys = packed(text)
        sa = suffix_array(text, width, keys)
        run = np.cumsum(common_prefixes(text, sa, keys) < width)
        mine = asked[sa]
        self.text, self.width = text, width
        self.starts = sa[mine]  # in suffix order
        self.run = run[mine]
        n = np.bincount(self.run, minlength=int(run[-1]) + 1 if len(run) else 1)
        self.repeated = n[self.run] > 1

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, self.width)[starts]

    def merge(self, other: Shard, block: int = 8192) -> None:
        """Mark the windows that both shards have: binary search of what is single here in the other's order."""
        single = np.flatnonzero(~self.repeated)
        for k in range(0, len(single), block):
            some = single[k : k + block]
            mine = self.windows(self.starts[some])
            lo, hi = np.zeros(len(some), np.int64), np.full(len(some), len(other.starts))
            while (lo < hi).any():
                live = np.flatnonzero(lo < hi)
                mid = (lo[live] + hi[live]) // 2
                a, b = other.windows(other.starts[mid]), mine[live]
                differ = a != b
                j = differ.argmax(axis=1)
                at = np.arange(len(live))
                less = differ[at, j] & (a[at, j] < b[at, j])
                lo[live] = np.where(less, mid + 1, lo[live])
                hi[live] = np.where(less, hi[live], mid)
            found = np.flatnonzero(lo < len(other.starts))
            found = found[(other.windows(other.starts[lo[found]]) == mine[found]).all(axis=1)]
            self.repeated[some[found]] = True
            other.repeated |= np.isin(other.run, other.run[lo[found]])


def repeated_starts(texts: list[np.ndarray], asked: list[np.ndarray], width: int, shard_bytes: int) -> list[np.ndarray]:
    """For each text, which of its asked starts (a mask over its bytes) begin a string of width bytes that begins at
    another asked start too. Texts are cut into shards of shard_bytes, which are merged pairwise."""
    shards, bounds, lo, size = [], [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > shard_bytes:
            bounds.append((lo, k))
            lo, size = k, 0
        size += len(t)
    bounds.append((lo, len(texts)))
    out: list[np.ndarray] = []
    for a, b in bounds:
        shards.append(Shard(np.concatenate(texts[a:b]), np.concatenate(asked[a:b]), width))
    for i in range(len(shards)):
        for j in range(len(shards)):
            if i != j:
                shards[i].merge(shards[j])
    for (a, b), shard in zip(bounds, shards, strict=True):
        mask = np.zeros(len(shard.text), bool)
        mask[shard.starts[shard.repeated]] = True
        cut = np.cumsum([len(t) for t in texts[a:b]])[:-1]
        out += np.split(mask, cut)
    return out

"""Suffix-array dedup by deep-shallow sorting (operator 3).

repeats.py leaves the boundaries of copied passages: for each anchor key, variants of text around
one anchor. Here the suffixes that start at the anchors (a sparse suffix array), and the reversed
prefixes that end there, are sorted: multikey quicksort over 8-byte symbols to a shallow depth,
then a blind trie orders each remaining group with a long common prefix. Runs of the two sorted
orders with a common prefix of at least 100 - s and s bytes are the variants that share the
window which starts s bytes before the anchor; all but the first of them are repeats.

Results: one row per row of docs. A null or empty text, or one under 100 bytes, loses nothing.
Equal documents: the smallest id keeps its text, the others lose all. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm.repeats import Kind, remove_repeats
from sparkloom.util import Scratch

SHALLOW = 4  # words of 8 bytes before blind tries take over


def padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of bytes, zero padded to whole words; lengths)."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(8, int(lens.max(initial=1) + 7) // 8 * 8)
    out = np.zeros((len(strings), width), np.uint8)
    out[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, lens


def multikey(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Ternary multikey quicksort of all groups at once, to `depth` words.

    Returns the order and the ranges of it that are still equal at that depth.
    """
    order = np.argsort(group, kind="stable")
    deep: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
    lo, size, at = edge[:-1], np.diff(edge), np.zeros(len(edge) - 1, np.int64)
    while True:
        more = size > 1
        lo, size, at = lo[more], size[more], at[more]
        done = at >= min(depth, words.shape[1])
        deep += zip(lo[done].tolist(), (lo + size)[done].tolist(), strict=True)
        lo, size, at = lo[~done], size[~done], at[~done]
        if not len(lo):
            return order, deep
        seg = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + lo[seg]
        key = words[order[place], at[seg]]
        ends = np.cumsum(size)
        a, b, c = key[ends - size], key[ends - size + size // 2], key[ends - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]  # median of three
        third = seg * 3 + (key > pivot) * 2 + (key == pivot)
        by = np.argsort(third, kind="stable")
        order[place] = order[place[by]]
        third = third[by]
        cut = np.flatnonzero(np.concatenate(([True], third[1:] != third[:-1], [True])))
        first = third[cut[:-1]]
        lo, size, at = place[cut[:-1]], np.diff(cut), at[first // 3] + (first % 3 == 1)


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie that stores branching depths and single bytes only; texts are compared once per insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # inner node: [depth, {byte: node}], leaf: ids of equal strings in a tuple-like list [-1, ids]

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        path, node = [], self.root
        while node[0] >= 0:  # blind descent: bytes between branchings are not looked at
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        above = None
        at = self.root
        for at in path:
            if at[0] >= depth:
                break
            above = at
        else:
            at = node
        mine = s[depth] if depth < len(s) else -1
        if at[0] == depth:
            at[1][mine] = [-1, [i]]
            return
        theirs = other[depth] if depth < len(other) else -1
        branch = [depth, {mine: [-1, [i]], theirs: at}]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = branch

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings within ascending groups, common prefix with the string before; -1 at a group's first)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    matrix, lens = padded(strings)
    order, deep = multikey(matrix.view(">u8").astype(np.uint64), group, SHALLOW)
    for lo, hi in deep:
        ids = order[lo:hi].tolist()
        trie = BlindTrie([strings[i] for i in ids])
        for i in range(len(ids)):
            trie.add(i)
        order[lo:hi] = [ids[i] for i in trie.order()]
    lcp = np.full(n, -1, np.int64)
    a, b = order[1:], order[:-1]
    differ = matrix[a] != matrix[b]
    first = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    lcp[1:] = np.where(group[a] == group[b], np.minimum(first, np.minimum(lens[a], lens[b])), -1)
    return order, lcp


def later_windows(window: int):
    """The method for repeats.by_key: variants in the order (key, doc, pos) -> repeated windows."""

    def method(key, doc, pos, n, off, ctx):
        edge = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(edge) - 1
        many = np.bincount(group)[group] > 1
        keep = np.flatnonzero(many)
        if not len(keep):
            return [], [], []
        group, doc, pos, n, off = group[keep], doc[keep], pos[keep], n[keep], off[keep]
        ctx = [ctx[i] for i in keep.tolist()]
        cuts = off.tolist()
        right, r_lcp = deep_shallow([c[o:] for c, o in zip(ctx, cuts, strict=True)], group)
        left, l_lcp = deep_shallow([c[:o][::-1] for c, o in zip(ctx, cuts, strict=True)], group)
        size, most = len(group), int(off.max())
        repeated = np.zeros((size, most + 2), bool)  # by bytes before the anchor
        rc, lc = np.empty(size, np.int64), np.empty(size, np.int64)
        for s in range(max(0, int((off - n + 1).min())), most + 1):
            has = np.flatnonzero((off >= s) & (off - n + 1 <= s))
            if len(has) < 2:
                continue
            rc[right] = np.cumsum(r_lcp < window - s)
            lc[left] = np.cumsum(l_lcp < s)
            _, first, of = np.unique(rc[has] * (size + 1) + lc[has], return_index=True, return_inverse=True)
            head = has[first[of]]
            repeated[has, s] = (doc[head] != doc[has]) | (pos[head] + off[head] != pos[has] + off[has])
        # runs of s, descending in s being ascending in the text
        flip = repeated[:, ::-1]
        step = np.diff(np.pad(flip, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        s = flip.shape[1] - 1 - start
        return doc[row], pos[row] + off[row] - s, end - start

    return method


BYTES = Kind("bytes", 100, 28)


def dedup_substrings(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", kind: Kind = BYTES, whole: bool = False, carry: tuple = ()) -> DataFrame:
    """Remove every byte that an earlier equal string of `kind.window` bytes covers.

    (doc_id, n_symbols, n_removed, n_spans, kept) with kept as bytes: a cut may fall inside a character,
    unless `whole` extends it to whole characters. Columns in carry come back as c0, c1, ...
    """
    return remove_repeats(docs, kind, later_windows(kind.window), scratch, id_col, text_col, whole=whole, carry=carry)

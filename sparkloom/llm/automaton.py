"""Substring dedup by suffix automata of reference shards (operator 5).

A shard is all reference text of one range of anchor keys (see repeats.py), so every passage that
could repeat is streamed only through the automaton that can hold it. Each key's automaton grows
in the order (document, position): a variant is first streamed for its matching statistics, the
longest suffix at each word that an earlier variant holds, and then joins the automaton. Maximal
spans whose statistic reaches the threshold are repeats. Automata of the whole corpus grow with it,
so they are routed by key instead of broadcast to every executor; each is bounded by `hot` variants.

Results: one row per row of docs. A null or empty text, or one under 20 words, loses nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm.repeats import Kind, remove_repeats
from sparkloom.util import Scratch


class Automaton:
    """A generalized suffix automaton over integer symbols, grown online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def statistics(self, symbols: list[int]) -> list[int]:
        """Per symbol, the length of the longest suffix ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.len
        at, n, out = 0, 0, []
        for c in symbols:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            q = nxt[at].get(c)
            if q is None:
                at = n = 0
            else:
                at, n = q, n + 1
            out.append(n)
        return out


def streamed(window: int):
    """The method for repeats.by_key: variants in the order (key, doc, pos) -> repeated windows."""

    def method(key, doc, pos, n, off, ctx):
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
        docs, starts, d, p, m = doc.tolist(), pos.tolist(), [], [], []
        for lo, hi in zip(edge, edge[1:], strict=False):
            if hi - lo < 2:
                continue
            automaton = Automaton()
            for i in range(lo, hi):
                if i > lo and docs[i] == docs[i - 1] and starts[i] == starts[i - 1]:
                    continue  # a row listed twice
                symbols = np.frombuffer(ctx[i], np.uint64).tolist()
                if i > lo:
                    begin = None
                    for j, length in enumerate([*automaton.statistics(symbols), 0]):
                        if length >= window:
                            begin = j if begin is None else begin
                        elif begin is not None:
                            d.append(docs[i])
                            p.append(starts[i] + begin - window + 1)
                            m.append(j - begin)
                            begin = None
                if i + 1 < hi:
                    automaton.add(symbols)
        return d, p, m

    return method


WORDS = Kind("words", 20, 6)


def dedup_windows(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", kind: Kind = WORDS) -> DataFrame:
    """Remove every word that an earlier equal run of `kind.window` words covers.

    (doc_id, n_symbols, n_removed, n_spans, kept); kept is UTF-8, words joined by one space.
    """
    return remove_repeats(docs, kind, streamed(kind.window), scratch, id_col, text_col)

"""Token ids of whole texts with the tokenizers library, words of a block being encoded once."""

from __future__ import annotations

import os
import re

import numpy as np

from sparkloom.llm.chunks import ChunkEncoder

JOINED = 256  # plain words that are encoded by one call

#: A plain word: one match for both public BPE files.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class Encoder(ChunkEncoder):
    """Texts -> ids, equal to the library's on each whole text.

    New plain words are encoded many at a time, and told apart by the ids that end (or begin) a
    word. Texts that hold an added token are encoded as wholes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        one = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        # the file may fold case, and drop white space: a word is then the same with and without its space
        super().__init__(self._learn, [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()], folds=one("A\u00c9Z") == one("a\u00e9z"), bare=one(" a b") == one("a b"))
        #: by id: whether it ends a word (files that drop white space) or begins with the word's space; None where unknown
        edge = np.zeros(1 + max(self.tok.get_vocab().values()), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            edge[i] = token.endswith("</w>") if self.bare else token.startswith("\u0120")
        self.edge = edge if edge.any() else None

    def _singly(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.batch(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of plain words (with their space, where the file keeps it), many to a call of the library."""
        if self.edge is None or len(words) < JOINED:
            return self._singly(words)
        glue, out = " " if self.bare else "", []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.batch([glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edge = np.flatnonzero(self.edge[ids]) + self.bare
            cut = (4 * (np.append(0, edge) if self.bare else np.append(edge, len(ids)))).tolist()
            if len(cut) != len(group) + 1:  # some word is not one piece of the file's pattern
                out += self._singly(group)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        out: dict[str, bytes] = dict.fromkeys(chunks)
        match = _PLAIN.fullmatch
        # a word without its space, at the start of a text, does not join with others
        plain = [c for c in out if match(c) and (self.bare or c[0] == " ")]
        out.update(zip(plain, self._joined(plain), strict=True))
        others = [c for c, ids in out.items() if ids is None]
        out.update(zip(others, self._singly(others), strict=True))
        return [out[c] for c in chunks]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_blocks(batch, column: int, limit: int = 1 << 20):
    """(first row, texts) of blocks of a batch with about `limit` bytes of text."""
    from sparkloom.llm.kernels import blocks, buffers

    _, offsets = buffers(batch.column(column))
    for i, j in blocks(offsets, limit):
        yield i, batch.column(column).slice(i, j - i).to_pylist()

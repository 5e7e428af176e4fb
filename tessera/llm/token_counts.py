"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  A failure link tells where matching goes on when a character
has no child, and a number beside it says how many pieces are complete by then, so one
pass over a word's characters yields the length of its greedy longest-match segmentation
without building a piece.

Nulls and edge cases: null and empty texts have no words and no tokens; a word that the
vocabulary cannot spell is one unknown token; very long words take one pass like others;
an empty table gives an empty result; repeated rows count alike; extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import texts_of
from tessera.llm.common import map_arrow

#: Words a worker keeps in its memo; it starts afresh when full.
MEMO_WORDS = 300_000


class LongestMatch:
    """Automaton over pieces that start a word and pieces that go on with one."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                if not piece:
                    continue
                v = root
                for c in piece:
                    nxt = self.child[v].get(c)
                    if nxt is None:
                        nxt = self.child[v][c] = len(self.child)
                        self.child.append({})
                        ends.append(False)
                    v = nxt
                ends[v] = True
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Number of greedy pieces of a word; 0 if it cannot be spelt."""
        child, fail, popped = self.child, self.fail, self.popped
        v = n = 0
        for c in word:
            nxt = child[v].get(c)
            while nxt is None:
                if fail[v] < 0:
                    return 0
                n += popped[v]
                v = fail[v]
                nxt = child[v].get(c)
            v = nxt
        while v != 1:
            if fail[v] < 0:
                return 0
            n += popped[v]
            v = fail[v]
        return n


def pieces_of_model(path: str) -> tuple[list[str], list[str]]:
    """Word-starting and following pieces of a sentencepiece vocabulary file."""
    from tessera.llm.spm import MARK, NORMAL, MergeModel

    with open(path, "rb") as f:
        found = [p for p, _, k in MergeModel(f.read()).pieces if k == NORMAL]
    return [p[1:] for p in found if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1], [p for p in found if MARK not in p]


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = n
        return n


_memos: dict[str, _Memo] = {}


def _memo(path: str) -> _Memo:
    if path not in _memos:
        _memos[path] = _Memo(LongestMatch(*pieces_of_model(path)))
    return _memos[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count one) and n_unknown of every text."""
    def run(batches):
        memo = _memo(vocabulary_path)
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in texts_of(b.column(1)).to_pylist():
                counts = list(map(memo.__getitem__, t.encode().split()))
                zero = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + zero)
                unknown.append(zero)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long, n_unknown long")

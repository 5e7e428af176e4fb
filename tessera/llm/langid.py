"""Language identification of mixed text: script ranges, word scores and Viterbi.

The scripts of a word's letters narrow its candidate languages to those whose training
texts use them.  Hashed character n-grams score every word for each candidate, and the
best path over a text's words, where each change of language costs a penalty, labels the
spans.  The label that most letters have is the text's language.

N-gram counts cover all training texts: documents with a language whose id's crc32 is
not 0 mod 5.

Nulls and edge cases: null texts and texts without letters are ``und`` with score 0;
documents without a language teach nothing but are labelled; ties go to the language that
sorts first; without any training text everything is ``und``; very long texts and words
are labelled whole; an empty table gives an empty result; repeated rows are labelled
alike; extra columns don't matter.  The n-gram table has a column for each language, so at
most ``MAX_LANGUAGES`` are learned, those with most training documents (ties: that which
sorts first); texts in a rarer one are labelled with one of these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import chunks, code_points
from tessera.llm.common import map_arrow, tree_sum

UNDETERMINED = "und"
BITS = 16
GRAMS = (2, 3)
#: A change of language costs this much log-likelihood.
PENALTY = 8.0
#: Languages of the model; their table of n-grams is broadcast (256 KB each).
MAX_LANGUAGES = 512
#: Languages counted in one pass over their training texts.
_PASS = 32
#: Entries (characters by languages) scored at a time.
_ENTRIES = 1 << 22
_BLOCK = 64

# Unicode block ranges of scripts.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF), ("Han", 0x4E00, 0x9FFF),
]
_tables: list[np.ndarray] = []


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: script number (0 no letter, last: other script) and folded character."""
    if not _tables:
        script = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000).astype(np.uint8)
        script[script == 1] = len(SCRIPTS) + 1
        for i, (_, lo, hi) in enumerate(SCRIPTS):
            part = script[lo:hi + 1]
            part[part > 0] = i + 1
        fold = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x2000):
            low = chr(c).lower()
            if len(low) == 1:
                fold[c] = ord(low)
        fold[script == 0] = 32
        _tables[:] = script, fold
    return _tables[0], _tables[1]


class _Letters:
    """Code points of a chunk with word and row bounds, and hashed n-grams."""

    def __init__(self, ch):
        script, fold = char_tables()
        codes, at = code_points(ch.buf)
        codes = np.minimum(codes, 0x10FFFF)
        self.at = at
        self.start, self.stop = at[ch.start], at[ch.end]
        self.script = script[codes]
        self.fold = fold[codes]
        self.n = len(codes)

    def grams(self):
        """n and hashed n-grams around every position of a word, edges as spaces."""
        c = np.concatenate(([32], self.fold, [32, 32])).astype(np.uint32)
        for n in GRAMS:
            h = np.zeros(self.n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + c[k:k + self.n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            yield n, (h * np.uint32(0x297A2D39) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def learns(column="doc_id"):
    """Rows that may be learned from: crc32 of the id as text is not 0 mod 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # bucket x language, float32
    allowed: np.ndarray  # script x language


def fit_languages(docs: DataFrame) -> LanguageModel:
    """n-gram and script counts of all training texts, added up on the executors."""
    known = docs.filter("lang is not null and doc_id is not null").filter(learns()).select("lang", "text")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    languages = sorted(r[0] for r in most.collect())
    k, scripts = len(languages), len(SCRIPTS) + 2
    if not k:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((scripts, 0), bool))
    logp, allowed = np.empty((1 << BITS, k), np.float32), np.empty((scripts, k), bool)
    for lo in range(0, k, _PASS):
        total = _counts(known, languages[lo:lo + _PASS], scripts)
        width = 1 << BITS
        grams = total[:, :width].T + 0.5
        share = total[:, width:] / np.maximum(1, total[:, width:].sum(1, keepdims=True))
        logp[:, lo:lo + _PASS] = np.log(grams / grams.sum(0))
        allowed[:, lo:lo + _PASS] = share.T >= 0.002
    return LanguageModel(languages, logp, allowed)


def _counts(known: DataFrame, languages: list[str], scripts: int) -> np.ndarray:
    """Numbers of n-grams by bucket, then of letters by script, of each language."""
    number = {x: i for i, x in enumerate(languages)}
    width = 1 << BITS

    def count(batches):
        total = np.zeros((len(number), width + scripts), np.int64)
        for b in batches:
            lang = np.fromiter((number[x] for x in b.column(0).to_pylist()), np.int64, b.num_rows)
            for ch in chunks(b.column(1)):
                t = _Letters(ch)
                row = np.repeat(lang[ch.lo:ch.hi], np.diff(t.at[ch.off]))
                letter = t.script > 0
                r = row[letter]
                first = r * total.shape[1]
                for _, g in t.grams():
                    np.add.at(total.reshape(-1), first + g[letter], 1)
                np.add.at(total.reshape(-1), first + width + t.script[letter], 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    own = known.filter(F.col("lang").isin(languages))
    return tree_sum(map_arrow(own, count, "counts binary"), np.int64).reshape(len(languages), width + scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; rows are words first[r] .. first[r + 1].

    Words go in blocks of 64.  All blocks of all rows advance together, for every state a
    block may begin in; then blocks are linked along each row and traced back.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    length = np.diff(first)
    blocks = -(-length // _BLOCK)
    total = int(blocks.sum())
    row_of = np.repeat(np.arange(len(length)), blocks)
    first_block = np.cumsum(blocks) - blocks
    level = np.arange(total) - first_block[row_of]
    begin = first[:-1][row_of] + level * _BLOCK
    size = np.minimum(_BLOCK, first[1:][row_of] - begin)
    index = np.minimum(begin[:, None] + np.arange(_BLOCK), n - 1)
    s = scores[index]
    used = np.arange(_BLOCK) < size[:, None]
    # a[b, i, j]: best score of block b from state i before it to state j at its end
    a = np.full((total, k, k), -np.inf, np.float32)
    a[:, np.arange(k), np.arange(k)] = 0
    for t in range(_BLOCK):
        go = np.flatnonzero(used[:, t])
        if not len(go):
            break
        v = a[go]
        a[go] = s[go, t][:, None, :] + np.maximum(v, v.max(2, keepdims=True) - penalty)
    enter = np.zeros((total, k), np.float32)
    leave = np.zeros((total, k), np.float32)
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    for d in range(len(bounds) - 1):
        b = order[bounds[d]:bounds[d + 1]]
        if d:
            e = leave[b - 1]
            enter[b] = e - e.max(1, keepdims=True)
        leave[b] = (enter[b][:, :, None] + a[b]).max(1)
    # again with known beginnings, keeping where each state came from
    came = np.empty((total, _BLOCK, k), np.int16)
    v = enter
    states = np.arange(k, dtype=np.int16)
    for t in range(_BLOCK):
        best = v.argmax(1)
        jump = v[np.arange(total), best] - penalty
        stay = v >= jump[:, None]
        came[:, t] = np.where(stay & used[:, t][:, None] | ~used[:, t][:, None], states, best[:, None])
        v = np.where(used[:, t][:, None], s[:, t] + np.where(stay, v, jump[:, None]), v)
    # trace back from every end state at once, then choose along the rows
    path = np.empty((total, _BLOCK, k), np.int16)
    now = np.broadcast_to(states, (total, k)).copy()
    for t in range(_BLOCK - 1, -1, -1):
        path[:, t] = now
        now = np.take_along_axis(came[:, t], now.astype(np.int64), 1)
    end = v.argmax(1)
    for d in range(len(bounds) - 2, 0, -1):
        b = order[bounds[d]:bounds[d + 1]]
        end[b - 1] = now[b, end[b]]
    labels = path[np.arange(total)[:, None], np.arange(_BLOCK), end[:, None]]
    return labels[used].astype(np.int64)


def label_column(column, model: LanguageModel, penalty: float = PENALTY):
    """For each chunk: the letters object, each word's label (-1: no letter), word weights."""
    k = len(model.languages)
    for ch in chunks(column, max(1 << 14, min(1 << 19, (1 << 21) // max(1, k)))):
        t = _Letters(ch)
        letter = t.script > 0
        weight = np.diff(np.concatenate(([0], np.cumsum(letter)))[np.stack((t.start, t.stop), 1)], axis=1)[:, 0] if len(t.start) else np.zeros(0, np.int64)
        if not len(t.start) or not k:
            yield ch, np.full(len(t.start), -1), weight
            continue
        grams = [g for _, g in t.grams()]
        scores = np.empty((len(t.start), k), np.float32)
        lo = 0
        while lo < len(t.start):
            # whole words, a bounded number of characters together
            hi = max(lo + 1, int(np.searchsorted(t.stop, t.start[lo] + _ENTRIES // k, "right")))
            x, y = t.start[lo], t.stop[hi - 1]
            per = model.logp[grams[0][x:y]]
            for g in grams[1:]:
                per += model.logp[g[x:y]]
            per[~letter[x:y]] = 0
            bounds = np.stack((t.start[lo:hi] - x, t.stop[lo:hi] - x), 1).reshape(-1)[:-1]
            # sums over each word; every second one is over the gap between two words
            scores[lo:hi] = np.add.reduceat(per, bounds, axis=0)[::2]
            lo = hi
        scores[weight == 0] = 0
        seen = np.zeros((len(t.start), model.allowed.shape[0]), bool)
        word_of = np.repeat(np.arange(len(t.start)), t.stop - t.start)
        inside = np.repeat(t.start - (np.cumsum(t.stop - t.start) - (t.stop - t.start)), t.stop - t.start) + np.arange(len(word_of))
        seen[word_of, t.script[inside]] = True
        seen[:, 0] = False
        barred = seen.astype(np.float32) @ (~model.allowed).astype(np.float32) > 0
        barred[barred.all(1)] = False  # no language has these scripts
        scores -= 1000 * barred
        scores -= scores.max(1, keepdims=True)
        labels = viterbi(scores, ch.first, penalty)
        labels[weight == 0] = -1
        yield ch, labels, weight


def _predictions(column, model: LanguageModel, penalty: float):
    names, scores = [], []
    for ch, labels, weight in label_column(column, model, penalty):
        k = max(1, len(model.languages))
        row = ch.word_row
        ok = labels >= 0
        sums = np.bincount(row[ok] * k + labels[ok], weights=weight[ok], minlength=ch.rows * k).reshape(ch.rows, k)
        total = sums.sum(1)
        best = sums.argmax(1)
        names += [model.languages[b] if n > 0 else UNDETERMINED for b, n in zip(best, total)]
        scores.append(np.where(total > 0, sums.max(1) / np.maximum(1, total), 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def predict_languages(docs: DataFrame, *, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred and score (share of letters with that label)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))

    def run(batches):
        for b in batches:
            names, scores = _predictions(b.column(1), sent.value, penalty)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_spans(docs: DataFrame, model: LanguageModel, *, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang, first and stop word of every span of one language, whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = ([], [], [], [])
            for ch, labels, _ in label_column(b.column(1), sent.value, penalty):
                row = ch.word_row
                # words without letters go with the span before them
                at = np.flatnonzero(labels >= 0)
                r, x = row[at], labels[at]
                new = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))) if len(at) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                for i, j in zip(begin, [*begin[1:], len(at)]):
                    out[0].append(ids[ch.lo + r[i]])
                    out[1].append(sent.value.languages[x[i]])
                    out[2].append(int(at[i] - ch.first[r[i]]))
                    out[3].append(int(at[j - 1] - ch.first[r[i]]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["doc_id", "lang", "first", "stop"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang string, first int, stop int")

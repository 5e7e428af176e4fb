"""Substring dedup with word-level suffix automata of reference shards.

``remove_reference_spans`` takes a reference table in shards of bounded size, broadcasts
each shard's suffix automaton and streams the documents through it for matching
statistics; maximal spans matched over at least ``min_words`` words go.

``remove_repeats`` takes the corpus as its own reference.  Its automata would grow with
the corpus, so each is sent only where it is needed.  In every window of ``WINDOW`` words
the ``ANCHOR``-gram with the least hash is its anchor; equal windows have equal anchors.
Consecutive windows with one anchor make a segment.  Only segments whose anchor occurs in
two documents are kept; distinct segments are dealt out by anchor, and each shard builds
the suffix automaton of its segments, every state knowing the least doc_id among its
occurrences.  Streaming the segments through it, with matches cut at ``WINDOW`` words,
gives for each window the least document it starts in.  Anchors of more than ``HOT``
documents are dealt out window by window instead, so that no shard grows with a group.

Nulls and edge cases: null and empty texts have no words; a null doc_id counts as larger
than any other; exact copies lose every window but in the smallest doc_id; rows with the
same doc_id are one document for "smaller" and are cut each by their own text; an empty
table gives an empty result; extra columns are kept by ``cut_repeats`` and otherwise
don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bloom import FILTER_ROWS, bloom_filter, in_filter
from tessera.llm.bytesops import Chunk, chunks, covered, texts_of
from tessera.llm.common import discard, map_arrow, materialise, unused

WINDOW = 13
ANCHOR = 7
HOT = 4096
#: Words of the segments behind one suffix automaton, and of a broadcast reference shard.
SHARD_WORDS = 4096
#: Broadcast shards whose spans are found before they are written.
SHARDS_A_PASS = 8
#: Repeated anchors whose Bloom filter may be broadcast; beyond it they are joined.
BROADCAST_ANCHORS = FILTER_ROWS
NO_ID = (1 << 63) - 1
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class SuffixAutomaton:
    """Suffix automaton over words of any number of texts, each with a number."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [NO_ID]

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NO_ID)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word) -> int:
        """State of the strings of q that end a step after p's longest string."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, number: int) -> None:
        """Add a text; ``number`` is noted at every occurrence of its substrings."""
        last = 0
        for word in words:
            p = last
            q = self.next[p].get(word)
            if q is not None:
                last = self._split(p, q, word)
            else:
                last = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    link = self._split(p, self.next[p][word], word)
                    self.link[last] = link
            if number < self.least[last]:
                self.least[last] = number

    def close(self) -> "SuffixAutomaton":
        """Pass the least numbers on to the suffixes, from long to short."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]
        return self

    def matches(self, words):
        """Matching statistics: at each word the longest match that ends there."""
        v = length = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            nxt = self.next[v].get(word)
            if nxt is None:
                length = 0
            else:
                v, length = nxt, length + 1
            yield length

    def least_of_windows(self, words, width: int) -> list[int]:
        """Least number among the texts that hold each window of ``width`` words."""
        out, v, length = [], 0, 0
        nxt, link, longest = self.next, self.link, self.length
        for i, word in enumerate(words):
            while v and word not in nxt[v]:
                v = link[v]
                length = longest[v]
            if word in nxt[v]:
                v, length = nxt[v][word], length + 1
            else:
                length = 0
            if length >= width:
                while longest[link[v]] >= width:
                    v = link[v]
                length = width
            if i >= width - 1:
                out.append(self.least[v] if length == width else NO_ID)
        return out


def _segments(ch: Chunk) -> tuple[np.ndarray, ...] | None:
    """Anchor hash, first window and number of windows of the chunk's segments."""
    words = ch.word_hash()
    at, gram = ch.windows(words, ANCHOR)
    if not len(at):
        return None
    h = np.full(len(words) + WINDOW, _MAX)
    h[at] = gram
    left = np.repeat(ch.first[1:], ch.n_words) - np.arange(len(words))
    i = np.flatnonzero(left >= WINDOW)
    if not len(i):
        return None
    span = WINDOW - ANCHOR + 1
    least = h[i]
    for k in range(1, span):
        least = np.minimum(least, h[i + k])
    pos = np.zeros(len(i), np.int64)
    for k in range(span - 1, -1, -1):
        pos[h[i + k] == least] = k
    pos += i
    new = np.ones(len(i), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(i)))
    return least[begin], i[begin], count


def _anchor_batches(batches):
    for b in batches:
        for ch in chunks(b.column(0)):
            s = _segments(ch)
            if s is None:
                continue
            # an anchor twice in one text counts twice: a needless candidate, no more
            yield pa.RecordBatch.from_arrays([pa.array(s[0].view(np.int64))], names=["anchor"])


_SEGMENT_DDL = "id long, th long, begin int, anchor long, hot boolean, content string"
_SEGMENT_NAMES = ["id", "th", "begin", "anchor", "hot", "content"]


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _emit(ch: Chunk, ids: np.ndarray, th: np.ndarray, anchor, begin, count, hot) -> pa.RecordBatch:
    words = ch.word_row
    row = words[begin]
    text = ch.buf.tobytes()
    start, end = ch.start, ch.end
    content = [b" ".join(text[start[b]:end[b + c + WINDOW - 2]].split()).decode("utf-8", "surrogateescape") for b, c in zip(begin, count)]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[ch.lo:ch.hi][row]), pa.array(th[ch.lo:ch.hi][row]), pa.array((begin - ch.first[row]).astype(np.int32)),
        pa.array(anchor.view(np.int64)), pa.array(hot), pa.array(content, pa.string())], names=_SEGMENT_NAMES)


def _single_windows(anchor, begin, count, hot):
    """Hot segments cut into one segment a window."""
    if not hot.any():
        return anchor, begin, count, hot
    n = np.where(hot, count, 1)
    rep = np.repeat(np.arange(len(begin)), n)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    return anchor[rep], begin[rep] + step, np.where(hot, 1, count)[rep], hot[rep]


def _segments_by_filter(sent):
    def run(batches):
        known, hot = sent.value
        for b in batches:
            ids, th = _ids(b.column(0)), b.column(2).to_numpy()
            for ch in chunks(b.column(1)):
                s = _segments(ch)
                if s is None:
                    continue
                anchor, begin, count = s
                keep = in_filter(anchor, known)
                if keep.any():
                    anchor, begin, count = anchor[keep], begin[keep], count[keep]
                    yield _emit(ch, ids, th, *_single_windows(anchor, begin, count, in_filter(anchor, hot)))
    return run


def _place_batches(batches):
    """Places of all segments, without their words: for the join with repeated anchors."""
    for b in batches:
        ids, th = _ids(b.column(0)), b.column(2).to_numpy()
        for ch in chunks(b.column(1)):
            s = _segments(ch)
            if s is None:
                continue
            anchor, begin, count = s
            row = ch.word_row[begin]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[ch.lo:ch.hi][row]), pa.array(th[ch.lo:ch.hi][row]), pa.array((begin - ch.first[row]).astype(np.int32)), pa.array(anchor.view(np.int64))], names=["id", "th", "begin", "anchor"])


def _segments_by_places(batches):
    for b in batches:
        ids, th = _ids(b.column(0)), b.column(2).to_numpy()
        places = b.column(3)
        for ch in chunks(b.column(1)):
            s = _segments(ch)
            if s is None:
                continue
            anchor, begin, count = s
            row = ch.word_row[begin]
            local = begin - ch.first[row]
            keep, hot = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
            for r in range(ch.rows):
                found = places[ch.lo + r].as_py()
                if found:
                    lo, hi = np.searchsorted(row, [r, r + 1])
                    codes = np.array(found)
                    mine = np.searchsorted(local[lo:hi], codes >> 1) + lo
                    keep[mine] = True
                    hot[mine] = (codes & 1).astype(bool)
            if keep.any():
                yield _emit(ch, ids, th, *_single_windows(anchor[keep], begin[keep], count[keep], hot[keep]))


#: Bytes of segments that a task holds while it merges equal ones.
MERGE_BYTES = 1 << 26


def _merged_batches(batches):
    """Equal segments of a task as one, with the least id: fewer go into the shuffle."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).group_by(["chash", "route", "content"]).aggregate([("id", "min")])
        return table.select(["route", "chash", "content", "id_min"]).rename_columns(["route", "chash", "content", "first"]).combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= MERGE_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _verdict_batches(batches):
    """Least document of each window, from the automaton of a shard of whole routes.

    Rows come sorted by route; a segment comes once from each task that saw it.
    """
    shard: dict[int, tuple[list[str], int]] = {}
    words, route = 0, None

    def flush():
        automaton = SuffixAutomaton()
        for content, first in shard.values():
            automaton.add(content, first)
        automaton.close()
        return pa.RecordBatch.from_arrays([
            pa.array(list(shard), pa.int64()),
            pa.array([automaton.least_of_windows(c, WINDOW) for c, _ in shard.values()], pa.list_(pa.int64()))], names=["chash", "least"])

    for b in batches:
        routes, hashes, contents, firsts = b.columns
        for i, (r, k, first) in enumerate(zip(routes.to_pylist(), hashes.to_pylist(), firsts.to_pylist())):
            if r != route and words >= SHARD_WORDS:
                yield flush()
                shard, words = {}, 0
            route = r
            known = shard.get(k)
            if known is None:
                w = contents[i].as_py().split(" ")
                shard[k] = w, first
                words += len(w)
            elif first < known[1]:
                shard[k] = known[0], first
    if shard:
        yield flush()


def repeat_marks(docs: DataFrame, *, hot: int = HOT, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Windows that also start in a smaller doc_id, by id and text hash.

    Returns id, th and ``marks``: an array of codes, (first window << 8) | bits of the
    windows from there on that go.
    """
    sc = docs.sparkSession.sparkContext
    # all 64 bits: many different texts may share an id, null above all
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    anchors = map_arrow(docs.select("text"), _anchor_batches, "anchor long")
    known = materialise(anchors.groupBy("anchor").count().filter("count > 1").select("anchor", (F.col("count") > hot).alias("hot")), "substring-anchors", free=True)
    n = known.agg(F.count("*").alias("n"), F.count_if("hot").alias("hot")).first()
    if n["n"] <= broadcast_anchors:
        few = bloom_filter(known.select("anchor"), n["n"]), bloom_filter(known.filter("hot").select("anchor"), n["hot"])
        segments = map_arrow(docs, _segments_by_filter(sc.broadcast(few)), _SEGMENT_DDL)
    else:
        places = map_arrow(docs, _place_batches, "id long, th long, begin int, anchor long").join(known, "anchor")
        places = places.groupBy("id", "th").agg(F.collect_set(F.col("begin") * 2 + F.col("hot").cast("int")).alias("places"))
        own = docs.join(places, (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == places["id"]) & (docs["th"] == places["th"]))
        segments = map_arrow(own.select("doc_id", "text", docs["th"], "places"), _segments_by_places, _SEGMENT_DDL)
    segments = materialise(segments.select(
        "id", "th", "begin", F.xxhash64("anchor", "content").alias("chash"), "content",
        # a hot anchor's windows are dealt out by their own words
        F.when(F.col("hot"), F.xxhash64("content")).otherwise(F.col("anchor")).alias("route")), "substring-segments", free=True)
    discard(known)
    # words are shuffled once, one copy of a segment from each task; the verdicts are
    # written by themselves, so that this shuffle is gone before the next one begins
    merged = map_arrow(segments.select("route", "chash", "content", "id"), _merged_batches, "route long, chash long, content string, first long")
    dealt = merged.repartition("route").sortWithinPartitions("route")
    verdicts = materialise(map_arrow(dealt, _verdict_batches, "chash long, least array<long>"), "substring-verdicts", free=True)
    # get() is null beyond the segment's last window, which counts as no
    bits = sum((F.when(F.get("least", F.lit(k)) < F.col("id"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(WINDOW - ANCHOR + 1)), F.lit(0))
    marked = segments.select("id", "th", "begin", "chash").join(verdicts, "chash").withColumn("bits", bits).filter("bits > 0")
    # copies under one id have the same marks, so a set
    marks = marked.groupBy("id", "th").agg(F.collect_set(F.col("begin").cast("long") * 256 + F.col("bits")).alias("marks"))
    marks = materialise(marks, "substring-marks", free=True)
    discard(segments)
    discard(verdicts)
    return marks


def _removed(ch: Chunk, r: int, marks) -> np.ndarray:
    n = int(ch.n_words[r])
    if not marks:
        return np.zeros(n, bool)
    codes = np.array(marks, np.int64)
    starts = np.concatenate([(codes >> 8)[(codes >> j & 1) == 1] + j for j in range(8)])
    return covered(n, starts, WINDOW)


def _with_marks(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and any others) with marks as one more column, the last."""
    names = [unused(docs.columns, x) for x in ("mark_id", "mark_text", "marks")]
    marks = repeat_marks(docs, **options).toDF(*names)
    # both sides know a text by id and hash; ids alone would mix rows that share one
    own = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(names[0])) & (F.xxhash64(docs["text"]) == F.col(names[1]))
    return docs.join(marks, own, "left").drop(*names[:2])


def _digest_batches(batches):
    for b in batches:
        n_words, n_removed, digest = [], [], []
        for ch in chunks(b.column(1)):
            text = ch.buf.tobytes()
            for r, marks in enumerate(b.column(2).slice(ch.lo, ch.rows).to_pylist()):
                words = text[ch.off[r]:ch.off[r + 1]].split()
                gone = _removed(ch, r, marks) if marks else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces."""
    rows = _with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return map_arrow(rows, _digest_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated windows cut out of their texts.

    Texts that lose nothing stay as they are; the others keep their remaining words and
    the white space that stands before each.
    """
    from pyspark.sql.types import StructType

    schema = docs.schema
    at = schema.fieldNames().index("text")

    def cut(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for ch in chunks(b.column(at)):
                text = ch.buf.tobytes()
                for r, marks in enumerate(b.column(b.num_columns - 1).slice(ch.lo, ch.rows).to_pylist()):
                    if not marks:
                        continue
                    gone = _removed(ch, r, marks)
                    lo, begin = ch.first[r], int(ch.off[r])
                    parts = []
                    for k, g in enumerate(gone.tolist()):
                        stop = int(ch.end[lo + k])
                        if not g:
                            parts.append(text[begin:stop])
                        begin = stop
                    texts[ch.lo + r] = b"".join(parts).strip(b" \t\n\v\f\r").decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])], names=b.schema.names[:-1])

    return map_arrow(_with_marks(docs, **options), cut, StructType(schema.fields))


def remove_reference_spans(docs: DataFrame, reference: DataFrame, *, min_words: int = WINDOW, shard_words: int = 1 << 16) -> DataFrame:
    """Spans of ``docs`` (doc_id, text) that stand in ``reference`` (text).

    Returns doc_id and ``spans``, an array of maximal (first word, end word) pairs, each
    inside one reference text and at least ``min_words`` long, for documents with any.
    Reference texts are dealt by hash into shards of ``shard_words`` words on average (one
    with a longer text is larger); one shard at a time is built into an automaton, broadcast, and
    all documents stream through it.
    """
    spark = docs.sparkSession
    ref = reference.select("text").filter("text is not null").distinct()
    ref = materialise(ref.withColumn("n", F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))), "substring-reference")
    total = ref.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shard in range(shards):
        rows = ref.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).select("text").collect()
        automaton = SuffixAutomaton()
        for i, r in enumerate(rows):
            automaton.add(r["text"].encode().split(), i)
        sent = spark.sparkContext.broadcast(automaton.close())
        part = map_arrow(docs, _span_batches(sent, min_words), "doc_id long, spans array<struct<first:int,stop:int>>")
        found = part if found is None else found.unionByName(part)
        if shard % SHARDS_A_PASS == SHARDS_A_PASS - 1:
            # the plan does not grow with the reference
            found = materialise(found, "substring-spans")
    return found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _span_batches(sent, min_words: int):
    def run(batches):
        for b in batches:
            ids, spans = [], []
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)).to_pylist()):
                mine, before = [], 0
                lengths = [*sent.value.matches(t.encode().split()), 0]
                for k, n in enumerate(lengths):
                    if before >= min_words and n != before + 1:
                        mine.append({"first": k - before, "stop": k})
                    before = n
                if mine:
                    ids.append(i)
                    spans.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "spans"])
    return run

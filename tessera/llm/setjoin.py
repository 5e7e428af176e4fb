"""N-gram Jaccard self-join: groups of equal prefixes, filtered in pairs, then expanded.

A document's set are the 64-bit hashes of its distinct shingles.  In one global order, rare
shingles before frequent ones, two sets that are similar enough share a shingle of their
prefixes.  Documents with equal sets become one node, nodes with the same prefix and size
one group, and groups meet in the lists of their prefix shingles.  Pairs of groups pass the
size, the place of the shared shingle and parity bitmaps: of the bits that all members of
a group have alike, no more may differ than shingles may.  None of these filters loses a
link.  What is left is expanded to members and verified on the whole sets.

Links only have to connect.  First every list and group yields a forest of candidates, so a
crowd of near copies costs about one verification a member, not one a pair.  What passes a
filter lies inside one component of these candidates; where all candidates of a component
link, nothing is left to find in it.  The others, whose members are about as alike as the
bound, are expanded to members with wider bitmaps: another forest, then every pair of
members from different components that still passes is verified.
Long lists are cut into parts and each pair of parts is a task's unit, so nothing grows
with a list.  The order comes from a sketch of shingle counts of fixed size: a poor count
only makes a list longer, it never changes a row.

Nulls and edge cases: null and empty texts, and texts of spaces, have no shingles and are
alone; texts with fewer words than a shingle have one, the whole; very long texts are
taken whole; repeated rows and rows with equal doc_id give a row each; rows without a
doc_id link like others, and a component of such rows alone has no id; an empty table gives
an empty result; extra columns don't matter.  Two shingles count as equal by chance about
once in 2^64 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bloom import FILTER_ROWS, bloom_filter, in_filter
from tessera.llm.bytesops import Chunk, chunks, mix
from tessera.llm.common import discard, map_arrow, materialise, tree_sum
from tessera.llm.components import connected_components
from tessera.llm.simhash import _Groups

SHINGLE, PERCENT = 3, 90
#: Counters of the sketch, and the part of all hashes, the least ones, that it counts:
#: prefixes of cold shingles are made of these.
BUCKETS, COUNTED = 1 << 20, np.uint64(1 << 62)
TILE = 1024
#: Items to a 64-bit word of a bitmap: of the groups, and of members about the bound, where
#: few of a pair's differences may meet in one bit.
NARROW, WIDE = 128, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _shingles(c: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of a chunk, A-Z lowered."""
    c.buf = _LOWER[c.buf]
    words, row, size = c.word_hash(), c.word_row, c.n_words
    at, h = c.windows(words, shingle)
    rows, hashes = [row[at]], [h]
    for n in range(1, shingle):  # texts that are shorter than a shingle
        at, h = c.windows(words, n)
        own = size[row[at]] == n
        rows.append(row[at][own])
        hashes.append(h[own])
    return np.concatenate(rows), np.concatenate(hashes)


def _sketch_batches(shingle: int):
    def run(batches):
        total, held, waiting = np.zeros(BUCKETS, np.int64), [], 0

        def count():
            np.add(total, np.bincount(np.concatenate(held), minlength=BUCKETS), out=total)
            held.clear()

        for b in batches:
            for c in chunks(b.column(0)):
                _, h = _shingles(c, shingle)
                h = h[h < COUNTED]
                held.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
                waiting += len(h)
                if waiting > 1 << 20:
                    count()
                    waiting = 0
        if held:
            count()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])
    return run


def frequent_buckets(docs: DataFrame, shingle: int) -> np.ndarray:
    """Packed flags of the sketch's buckets with frequent shingles."""
    counts = tree_sum(map_arrow(docs.select("text"), _sketch_batches(shingle), "counts binary"), np.int64)
    if counts is None:
        return np.zeros(BUCKETS // 8, np.uint8)
    return np.packbits(counts > 64 + 4 * counts.mean(), bitorder="little")


def map_words(n: np.ndarray, share: int) -> np.ndarray:
    """64-bit words of the parity bitmap of a set of n: a power of two, at least n / share."""
    return 1 << np.ceil(np.log2(np.maximum(n, share) / share)).astype(np.int64)


def _bitmaps(h: np.ndarray, which: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Parity of the hashes at each bit, for the sets ``which`` names, one after the other."""
    first = np.concatenate(([0], np.cumsum(words)))
    bit = first[which] * 64 + (h & (words[which] * 64 - 1).astype(np.uint64)).astype(np.int64)
    bits = np.bincount(bit, minlength=int(first[-1]) * 64).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<u8")


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _sums(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """128-bit fingerprints of the runs of ``values`` that begin at ``start``, none empty."""
    out = np.empty((len(start), 2), np.uint64)
    if len(start):
        for i, code in enumerate((_A, _B)):
            out[:, i] = np.add.reduceat(mix(values * code + code), start) + n.astype(np.uint64) * code
    return pa.array([x.tobytes() for x in out], pa.binary())


class _Sets:
    """Distinct shingles of a chunk's rows, by row and, inside it, frequency and hash."""

    def __init__(self, c: Chunk, shingle: int, frequent: np.ndarray | None):
        row, h = _shingles(c, shingle)
        hot = np.zeros(len(h), bool)
        if frequent is not None:
            low = np.flatnonzero(h < COUNTED)
            at = (h[low] & np.uint64(BUCKETS - 1)).astype(np.int64)
            hot[low] = frequent[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        order = np.lexsort((h, hot, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        self.row, self.h = row[new], h[new]
        self.n = np.bincount(self.row, minlength=c.rows).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))[:-1]
        self.full = np.flatnonzero(self.n)  # rows with shingles


def _mark_batches(shingle: int, percent: int, frequent: np.ndarray):
    """doc_id, n, key of the set, key of the group, prefix and bitmap of every document."""
    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                s = _Sets(c, shingle, frequent)
                full, n = s.full, s.n[s.full]
                size = prefix_size(n, percent)
                place = np.arange(len(s.h)) - s.start[s.row]
                inside = place < prefix_size(s.n, percent)[s.row]
                prefix = s.h[inside]
                words = map_words(n, NARROW)
                bitmap = _bitmaps(s.h, np.searchsorted(full, s.row), words)
                starts = np.concatenate(([0], np.cumsum(size)))[:-1]
                take = np.full(c.rows, -1)
                take[full] = np.arange(len(full))
                take = pa.array(take, mask=take < 0)
                own = [_sums(s.h, s.start[full], n), _sums(prefix, starts, n), _lists(prefix, size), _lists(bitmap, words)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.rows), pa.array(s.n), *[x.take(take) for x in own]], names=["doc_id", "n", "key", "gid", "prefix", "bitmap"])
    return run


def _set_batches(shingle: int, wanted: np.ndarray):
    """Keys and whole sets of the documents whose key the filter may hold."""
    def run(batches):
        for b in batches:
            for c in chunks(b.column(0)):
                s = _Sets(c, shingle, None)
                key = _sums(s.h, s.start[s.full], s.n[s.full])
                hit = np.flatnonzero(in_filter(_key_hash(key), wanted))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(hit)), _lists(s.h, s.n[s.full]).take(pa.array(hit))], names=["key", "items"])
    return run


def _wide_batches(batches):
    """Wide bitmaps (key, bitmap, known) of whole sets (node, items)."""
    for b in batches:
        offsets = b.column(1).offsets.to_numpy()
        n = np.diff(offsets).astype(np.int64)
        h = b.column(1).values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
        words = map_words(n, WIDE)
        maps = _lists(_bitmaps(h, np.repeat(np.arange(len(n)), n), words), words)
        yield pa.RecordBatch.from_arrays([b.column(0), maps, pa.nulls(len(n), maps.type)], names=["key", "bitmap", "known"])


def _key_hash(key: pa.Array) -> np.ndarray:
    """First halves of 16-byte keys."""
    return np.frombuffer(b"".join(x.as_py()[:8] for x in key), "<u8")


def _key_batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_key_hash(b.column(0)).view(np.int64))], names=["h"])


# ---- filters on pairs

class Bitmaps:
    """Parity bitmaps of many sets or groups, with the bits that are known of each."""

    def __init__(self, values: pa.Array, known: pa.Array):
        size = np.diff(values.offsets.to_numpy())
        self.level = np.log2(np.maximum(size, 1)).astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sure = np.full(len(flat), np.uint64(0xFFFFFFFFFFFFFFFF))
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        told = np.flatnonzero(~np.asarray(known.is_null()))
        if len(told):
            at = np.repeat(start[told], size[told]) + np.arange(size[told].sum()) - np.repeat(np.cumsum(size[told]) - size[told], size[told])
            sure[at] = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        #: for each level: place of every row, values and known bits folded down to it
        self.levels = {}
        above = None
        for level in range(int(self.level.max(initial=0)), -1, -1):
            rows = np.flatnonzero(self.level == level)
            at = start[rows][:, None] + np.arange(1 << level)
            v, k = flat[at], sure[at]
            place = np.full(len(size), -1)
            if above is not None:
                half = 1 << level
                v = np.concatenate((v, above[1][:, :half] ^ above[1][:, half:]))
                k = np.concatenate((k, above[2][:, :half] & above[2][:, half:]))
                rows = np.concatenate((rows, above[0]))
            place[rows] = np.arange(len(rows))
            above = rows, v, k
            self.levels[level] = place, v, k

    def at_most(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Flags of the pairs of rows of which at most ``limit`` known bits differ."""
        ok = np.zeros(len(a), bool)
        common = np.minimum(self.level[a], self.level[b])
        for level in np.unique(common):
            i = np.flatnonzero(common == level)
            place, v, k = self.levels[int(level)]
            x, y = place[a[i]], place[b[i]]
            ok[i] = np.bitwise_count((v[x] ^ v[y]) & k[x] & k[y]).sum(1) <= limit[i]
        return ok


def near_pairs(unit, label, n, pos, maps: Bitmaps, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a unit, of different labels, that no filter rules out.

    Rows are sorted by unit and n.  With ``forest``, only enough of them to connect what all
    of them connect.
    """
    m = len(unit)
    last = np.flatnonzero(np.append(unit[1:] != unit[:-1], True)) if m else np.zeros(0, int)
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    live, found, d = np.arange(m), [], 1
    sets = _Groups(m)
    while True:
        live = live[live + d < end[live]]
        live = live[100 * n[live] >= percent * n[live + d]]  # sizes only grow from here on
        if not len(live):
            break
        a, b = live, live + d
        ok = label[a] != label[b]
        if forest:
            ok &= sets.root[a] != sets.root[b]
        a, b = a[ok], b[ok]
        both = n[a] + n[b]
        need = -(-percent * both // (100 + percent))
        most = np.minimum(pos[a], pos[b]) + 1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1
        ok = most >= need
        a, b, left = a[ok], b[ok], (both - 2 * need)[ok]
        ok = maps.at_most(a, b, left)
        a, b = a[ok], b[ok]
        if forest:
            sets.join(a, b)
        found.append((a, b))
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in found] or [none]), np.concatenate([b for _, b in found] or [none]))


def _unit_batches(percent: int, forest: bool, rows: int = 1 << 13):
    """``near_pairs`` over a partition sorted by unit and n: ids of the pairs."""
    def run(batches):
        held: pa.Table | None = None

        def flush(t: pa.Table):
            t = t.combine_chunks()
            unit, label, ids, n, pos = (t.column(i).combine_chunks().to_numpy() for i in range(5))
            maps = Bitmaps(*(t.column(i).combine_chunks() for i in (5, 6)))
            a, b = near_pairs(unit, label, n, pos, maps, percent, forest)
            if len(a):
                x, y = ids[a], ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= rows:
                unit = held.column(0).to_numpy()
                cut = int(np.flatnonzero(unit == unit[-1])[0])  # the last unit may go on
                if cut:
                    yield from flush(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from flush(held)
    return run


def candidates(rows: DataFrame, maps: DataFrame, percent: int, *, forest: bool, tile: int = TILE) -> DataFrame:
    """Pairs a < b of ids of rows (list, label, id, n, pos, key), without repeats.

    ``maps`` has the bitmap and known bits of each key.  Rows of a list meet in parts of
    about ``tile``, every two parts in a unit of their own; bitmaps only join the rows of
    lists with more than one label.
    """
    own = "own" if "own" in rows.columns else F.lit(True)
    size = rows.groupBy("list").agg(F.count("*").alias("_size"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max(own).alias("_own"))
    size = size.filter("_lo <> _hi and _own").select("list", F.ceil(F.col("_size") / F.lit(tile)).cast("int").alias("cuts"))
    near = rows.join(size, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    near = near.select(F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "label", "id", "n", F.col("pos").cast("long"), "key")
    near = materialise(near, "set-units", free=True)
    placed = near.join(maps, "key").select("unit", "label", "id", "n", "pos", "bitmap", "known")
    placed = placed.repartition("unit").sortWithinPartitions("unit", "n", "id")
    found = materialise(map_arrow(placed, _unit_batches(percent, forest), "a long, b long").distinct(), "set-pairs", free=True)
    discard(near)
    return found


# ---- verification

def _verify_batches(percent: int):
    """Rows (a, salt, role, node, items), each a's own first: whether a and node link."""
    def run(batches):
        key, items = None, None
        for batch in batches:
            a, salt, role, node = (batch.column(i).to_numpy() for i in range(4))
            off = batch.column(4).offsets.to_numpy()
            flat = batch.column(4).values.to_numpy()
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                own = flat[off[i]:off[i + 1]]
                if role[i] == 0:
                    key, items = (a[i], salt[i]), own.copy()
                    continue
                assert key == (a[i], salt[i])
                both = len(np.intersect1d(items, own, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(items) + len(own) - both)
            tail = role == 1
            yield pa.RecordBatch.from_arrays([pa.array(a[tail]), pa.array(node[tail]), pa.array(ok[tail])], names=["a", "b", "ok"])
    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int, *, share: int = 256) -> DataFrame:
    """The pairs (a, b) with ``ok``: whether their sets link.

    Each a meets its b's in shares of about ``share``, so its set is sent once a share.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("cuts"))
    tails = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    first = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    rows = first.union(tails).join(sets, "node").select("a", "salt", "role", "node", "items")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return materialise(map_arrow(rows, _verify_batches(percent), "a long, b long, ok boolean"), "set-verified", free=True)


def _whole_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of ``nodes``; texts are read again, and a filter of fixed size at most
    passes over most of those that no one asks for."""
    wanted = materialise(classes.join(nodes.distinct(), "node").select("node", "key"), "sets-wanted")
    bits = bloom_filter(map_arrow(wanted.select("key"), _key_batches, "h long"), min(max(1, wanted.count()), FILTER_ROWS))
    found = map_arrow(docs.select("text"), _set_batches(shingle, bits), "key binary, items array<bigint>")
    sets = materialise(found.groupBy("key").agg(F.first("items").alias("items")).join(wanted, "key").select("node", "items"), "sets", free=True)
    discard(wanted)
    return sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _group_table(members: DataFrame) -> DataFrame:
    """(g, n, prefix, bitmap, known): a row a group; g is its least node."""
    whole = members.groupBy("g").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("one"))
    many = members.join(whole.filter("size > 1").select("g"), "g", "left_semi").select("g", F.posexplode("bitmap").alias("i", "w"))
    many = many.groupBy("g", "i").agg(F.bit_and("w").alias("every"), F.bit_or("w").alias("some"))
    # as many words as a bitmap has
    many = many.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "every", "some"))).alias("x"))
    x = lambda f: F.transform("x", f)
    many = many.select("g", x(lambda e: e["every"]).alias("every"), x(lambda e: F.bitwise_not(e["every"].bitwiseXOR(e["some"]))).alias("known"))
    return whole.join(many, "g", "left").select("g", "n", "prefix", F.coalesce("every", "one").alias("bitmap"), "known")


def _list_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of prefix shingles (list, label, id, n, pos, key), cut into lists by size.

    Sets that link are of one size class or two adjacent ones, so each row goes to the list
    of its own class and to that of the next; lists that have no row of their own class
    find nothing new.
    """
    live = rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("list")
    live = materialise(rows.join(live, "list", "left_semi"), "set-lists", free=True)
    # a little wider than needed, so that no rounding parts a pair
    step = F.floor(F.log("n") / F.lit(-np.log(percent / 100) * (1 + 1e-9))).cast("int")
    sized = live.select("*", step.alias("step"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    return sized.select(F.xxhash64("list", F.when(F.col("own"), F.col("step")).otherwise(F.col("step") + 1)).alias("list"), "label", "id", "n", "pos", "key", "own")


def _undecided(found: DataFrame, label: DataFrame) -> DataFrame:
    """(node, label): the nodes of components that a refuted candidate touches.

    Every component of candidates with a refuted one is made of such components.
    """
    ends = found.select("ok", F.explode(F.array("a", "b")).alias("node"))
    ends = ends.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("label"), (~F.col("ok")).alias("open"))
    touched = ends.filter("open").select("label").distinct()
    return ends.select("node", "label").distinct().join(touched, "label").select("node", "label")


def jaccard_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links).

    Two documents link where their sets' intersection has at least ``percent`` hundredths
    of the union's size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = frequent_buckets(docs, shingle)
    marks = materialise(map_arrow(docs, _mark_batches(shingle, percent, frequent), "doc_id long, n long, key binary, gid binary, prefix array<bigint>, bitmap array<bigint>"), "set-marks")
    one = lambda c: F.first(c).alias(c)
    classes = marks.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), one("n"), one("gid"), one("prefix"), one("bitmap"))
    # written before it is read, so that the numbers stay what they are
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes", free=True)
    names = classes.groupBy("gid").agg(F.min("node").alias("g"))
    members = materialise(classes.select("node", "gid", "n", "prefix", "bitmap").join(names, "gid").drop("gid"), "set-members", free=True)
    groups = materialise(_group_table(members), "set-groups", free=True)

    star = members.filter("node <> g").select(F.col("g").alias("a"), F.col("node").alias("b"))
    own = groups.select(F.col("g").alias("id"), F.col("g").alias("label"), F.col("g").alias("key"), "n", F.posexplode("prefix").alias("pos", "list"))
    forest = candidates(_list_rows(own, percent), groups.select(F.col("g").alias("key"), "bitmap", "known"), percent, forest=True, tile=tile)
    tested = materialise(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(forest).distinct(), "set-forest", free=True)
    sets = _whole_sets(docs, _ends(tested), classes, shingle)
    found = verified(tested, sets, percent)
    links = found.filter("ok").select("a", "b")

    label = materialise(connected_components(links), "set-labels")
    left = materialise(_undecided(found, label), "set-undecided")
    if not left.isEmpty():
        wide = materialise(map_arrow(sets.join(left, "node", "left_semi").select("node", "items"), _wide_batches, "key long, bitmap array<bigint>, known array<bigint>"), "set-wide", free=True)
        own = members.join(left, "node").select(F.col("node").alias("id"), F.col("node").alias("key"), "label", "n", F.posexplode("prefix").alias("pos", "list"))
        for forest in (True, False):
            late = candidates(_list_rows(own, percent), wide, percent, forest=forest, tile=tile)
            late = materialise(late.join(tested, ["a", "b"], "left_anti"), "set-late", free=True)
            if late.isEmpty():
                continue
            tested = tested.union(late)
            new = verified(late, sets, percent).filter("ok").select("a", "b")
            if new.isEmpty():
                continue
            links = links.union(new)
            label = materialise(connected_components(links), "set-labels")
            own = own.drop("label").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    discard(sets)

    of_key = classes.select("key", "node", "first_id").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of_key.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = marks.select("doc_id", "n", "key").join(of_key.join(least, "root").select("key", "component_id"), "key", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

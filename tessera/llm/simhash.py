"""SimHash near-duplicates: 64-bit fingerprints compared in vertical bit planes.

Fingerprints within a small Hamming radius agree on whole blocks of bits: of ``blocks``
blocks at most ``radius`` can differ, so every link shares the key made of some
``blocks - radius`` of them.  Distinct fingerprints are dealt out by those keys.  Inside a
key's group, bit plane p holds bit p of all members, 64 members to a machine word;
shifting a plane by d lines member i up with member i + d.  Carry-save counters add up
the differing bits of all these pairs at once, and a block of pairs is abandoned when
every one of them has passed the radius.

Groups above ``tile`` members are cut into parts, and every pair of parts is a task of
its own, so no task grows with a group.  A group reports links that span its components,
at most one a member, never all its pairs.

Nulls and edge cases: null and empty texts have no words and get fingerprint 0, which
links like any other; copies and ties share a fingerprint; rows with equal doc_id give a
row each; empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import texts_of
from tessera.llm.common import map_arrow, materialise, unused
from tessera.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
FINGER_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _add_planes(counters: list[np.ndarray], word: np.ndarray, at: int) -> None:
    """Add one-bit numbers (64 a machine word) to binary counters, carries saved upwards."""
    while True:
        if at == len(counters):
            counters.append(word)
            return
        carry = counters[at] & word
        counters[at] = counters[at] ^ word
        if not carry.any():
            return
        word, at = carry, at + 1


def majority_bits(h: np.ndarray) -> int:
    """64-bit number whose bits are those set in over half of the hashes ``h``.

    Three numbers of a weight become a sum of that weight and a carry of the next one
    (carry-save), so the column counts of n hashes take about 5 n word operations.
    """
    n = len(h)
    if n == 0:
        return 0
    level, weights = [h], []
    while level:
        rest = level[0] if len(level) == 1 else np.concatenate(level)
        up: list[np.ndarray] = []
        while len(rest) > 2:
            k = len(rest) // 3
            a, b, c, left = rest[:k], rest[k:2 * k], rest[2 * k:3 * k], rest[3 * k:]
            half = a ^ b
            up.append((a & b) | (half & c))
            rest = np.concatenate((half ^ c, left)) if len(left) else half ^ c
        if len(rest) == 2:
            up.append(rest[:1] & rest[1:])
            rest = rest[:1] ^ rest[1:]
        weights.append(rest[0])
        level = up
    counts = np.zeros(64, np.int64)
    for w, word in enumerate(weights):
        counts += np.unpackbits(np.array([word], "<u8").view(np.uint8), bitorder="little").astype(np.int64) << w
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """SimHash of a text: majority of the XXH64 of its 3-word shingles, A-Z lowered."""
    words = (text or "").encode().lower().split()
    return _fingerprint(words)


def _fingerprint(words: list[bytes]) -> int:
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    h = np.array([digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])], np.uint64)
    return majority_bits(h)


def _finger_batches(batches):
    for b in batches:
        texts = texts_of(b.column(1))
        fp = np.fromiter((_fingerprint(texts[i].as_py().encode().lower().split()) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=FINGER_SCHEMA)


def _key_finger_batches(batches):
    """Fingerprints beside all columns but the last one, the text."""
    for b in batches:
        of_text = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(b.num_columns - 1)], names=["doc_id", "text"])
        fp = [x.column(1) for x in _finger_batches([of_text])]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(fp), *b.columns[:-1]], names=["fp", *b.schema.names[:-1]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long ``fp``) of every document."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _finger_batches, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` of the blocks of a 64-bit number."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Groups:
    """Union-find over the rows of a batch."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union all pairs by repeated minimum labels and pointer jumps."""
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            keep = ra != rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            if not len(a):
                return
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                nxt = root[root]
                if (nxt == root).all():
                    break
                root[:] = nxt


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 bit planes: plane p, packed 64 rows a word, has bit p of every row."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = (-len(fp)) % 64
    if pad:
        bits = np.concatenate((bits, np.zeros((pad, 64), np.uint8)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes moved down by d rows: row i then holds row i + d."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    n = planes.shape[1] - words
    if n <= 0:
        return out
    out[:, :n] = planes[:, words:] >> np.uint64(bits) if bits else planes[:, words:]
    if bits and n > 1:
        out[:, :n - 1] |= planes[:, words + 1:] << np.uint64(64 - bits)
    return out


def within_radius(a: np.ndarray, b: np.ndarray, radius: int, live: np.ndarray, step: int = 8) -> np.ndarray:
    """Packed flags of the pairs at most ``radius`` apart, of those flagged in ``live``.

    ``a`` and ``b`` have 64 planes each.  Carry-save counters hold every pair's distance
    so far; a counter that reaches the next power of two above the radius sticks.  All
    pairs are given up as soon as none of them is alive.
    """
    levels = (radius + 1).bit_length()
    counters = [np.zeros_like(live) for _ in range(levels)]
    over = ~live
    for p in range(64):
        carry = np.bitwise_xor(a[p], b[p])
        for c in counters:
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if p % step == step - 1:
            beyond = over.copy()
            beyond |= _above(counters, radius)
            if (beyond == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                return np.zeros_like(live)
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Flags of the counts over ``radius``, compared from the top bit down."""
    more = np.zeros_like(counters[0])
    same = np.full_like(counters[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            same &= counters[level]
        else:
            more |= same & counters[level]
            same &= ~counters[level]
    return more


def _flags(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def _packed(flags: np.ndarray) -> np.ndarray:
    pad = (-len(flags)) % 64
    return np.packbits(np.concatenate((flags, np.zeros(pad, bool))), bitorder="little").view("<u8").copy()


def link_groups(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, probe: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each group, what pairs within the radius connect.

    ``group`` is sorted.  Rows are compared with those 1, 2, 3 ... places on until every
    group is one component or its largest offset is reached.  After ``probe`` offsets,
    groups that are still split compare only the rows outside their largest component,
    each with the whole group: pairs inside one component add nothing.
    Returns indices a, b: every row that is not its component's first, and that first row.
    """
    n = len(fp)
    sets = _Groups(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(first, n))
    start = np.repeat(first, size)
    end = start + np.repeat(size, size)
    planes = planes_of(fp)
    largest = int(size.max(initial=0))
    pos = np.arange(n)
    for d in range(1, min(probe + 1, largest)):
        live = pos + d < end
        split = np.maximum.reduceat(sets.root, first) != np.minimum.reduceat(sets.root, first)
        live &= np.repeat(split, size)
        if not live.any():
            break
        hit = np.flatnonzero(_flags(within_radius(planes, _shifted(planes, d), radius, _packed(live)), n))
        sets.join(hit, hit + d)
    if largest > probe + 1:
        for g in np.flatnonzero(size > probe + 1):
            lo, hi = first[g], first[g] + size[g]
            roots, counts = np.unique(sets.root[lo:hi], return_counts=True)
            if len(roots) == 1:
                continue
            own = planes_of(fp[lo:hi])
            for i in lo + np.flatnonzero(sets.root[lo:hi] != roots[counts.argmax()]):
                bits = np.unpackbits(np.array([fp[i]], "<u8").view(np.uint8), bitorder="little")
                query = np.where(bits[:, None] == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
                live = _packed(sets.root[lo:hi] != sets.root[i])
                hit = lo + np.flatnonzero(_flags(within_radius(own, query, radius, live), hi - lo))
                sets.join(np.full(len(hit), i), hit)
    tail = np.flatnonzero(sets.root != pos)
    return tail, sets.root[tail]


def _link_batches(radius: int):
    def run(batches):
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush(last: bool):
            nonlocal pending, held
            group = np.concatenate([g for g, _ in pending])
            fp = np.concatenate([f for _, f in pending])
            cut = len(group)
            if not last:  # the last group may go on in the next batch
                cut = int(np.searchsorted(group, group[-1], "left")) if group[0] != group[-1] else 0
            pending, held = ([(group[cut:], fp[cut:])], len(group) - cut) if cut < len(group) else ([], 0)
            if cut:
                a, b = link_groups(group[:cut], fp[:cut], radius)
                f = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                pending.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
                held += batch.num_rows
                if held >= 1 << 15:
                    yield from flush(False)
        if held:
            yield from flush(True)
    return run


def link_fingerprints(distinct: DataFrame, *, radius: int = RADIUS, blocks: int = 6, tile: int = 8192) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``fp``, signed) within ``radius``.

    They connect exactly what all pairs within the radius connect.  Keys that one
    fingerprint alone has are dropped before fingerprints are gathered.  A group of n
    members is cut into ceil(n / tile) parts and every pair of parts is compared.
    """
    masks = [_signed(m) for m in block_masks(blocks, radius)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("byte").alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.m", "x.k")
    crowds = materialise(keyed.groupBy("m", "k").count().filter("count > 1"), "simhash-keys")
    cuts = F.ceil(F.col("count") / F.lit(tile)).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    near = keyed.join(crowds, ["m", "k"]).withColumn("cuts", cuts).withColumn("part", part)
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    near = near.select(F.xxhash64("m", "k", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "fp")
    near = near.repartition("g").sortWithinPartitions("g", "fp")
    return map_arrow(near, _link_batches(radius), "a long, b long").distinct()


def _component_roots(ids: DataFrame, **options) -> DataFrame:
    """``ids`` (fp and others, a row a fingerprint) with ``root``, the same all over a component."""
    labels = connected_components(link_fingerprints(ids.select("fp"), **options))
    return ids.join(labels, ids["fp"] == labels["node"], "left").select(*ids.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, *, radius: int = RADIUS, blocks: int = 6, tile: int = 8192) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every document."""
    prints = materialise(fingerprints(docs), "simhash")
    ids = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    rooted = _component_roots(ids, radius=radius, blocks=blocks, tile=tile)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    comp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(comp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _row_key(names: list[str]) -> list:
    """Columns that tell rows apart but for copies under one doc_id, none of them null."""
    key = F.col("doc_id").cast("long")
    return [c.alias(n) for c, n in zip((key.isNull(), F.coalesce(key, F.lit(0)), F.xxhash64("text")), names)]


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id.

    Rows without a doc_id come after all others; among rows with one id the least text
    hash decides, and of copies under one id any one stays.
    """
    names = [unused(docs.columns, x) for x in ("no_id", "id_key", "text_key")]
    keyed = docs.select("*", *_row_key(names))
    prints = map_arrow(keyed.select(*names, "text").toDF("no_id", "id_key", "text_key", "text"), _key_finger_batches, "fp long, no_id boolean, id_key long, text_key long")
    ids = materialise(prints.groupBy("fp").agg(F.min(F.struct("no_id", "id_key", "text_key")).alias("first")), "simhash-distinct")
    least = _component_roots(ids, **options).groupBy("root").agg(F.min("first").alias("first")).select("first.*").toDF(*names)
    # copies meet before the shuffle, so that many of them don't fall to one task
    return keyed.dropDuplicates(names).join(least, names, "left_semi").select(*docs.columns)

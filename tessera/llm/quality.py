"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Statistics are counted from the UTF-8 bytes of Arrow batches.  The forest is a small
table: every tree isolates a random subset of labelled rows by random splits, and a
document's path lengths, averaged over the trees, give its anomaly score.  The score
above which a document is rejected comes from all labelled rows.

Nulls and edge cases: a null text counts as empty; an empty text has no words and fails
the base rules; repeated rows and ties are judged alike; an empty table gives an empty
result; without labelled rows only the base rules decide; extra columns are kept as they
are unless they bear a name of the output, which is then replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bloom import FILTER_ROWS, bloom_filter, in_filter
from tessera.llm.bytesops import chunks, covered, mix, repeated
from tessera.llm.common import map_arrow, materialise

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_alpha_words", "n_digits", "n_marks"]
STATS_SCHEMA = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in STATS + EXTRA])
STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in STATS + EXTRA)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:|")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def count_statistics(column) -> dict[str, np.ndarray]:
    """Rule statistics of every text of a string column; see ``STATS`` and ``EXTRA``.

    ``n_repeat_words`` counts the words inside 8-word windows that occur at least twice in
    the same text, ``n_dup_lines`` the lines with a word that equal an earlier line.
    """
    parts: dict[str, list] = {c: [] for c in STATS + EXTRA}
    for ch in chunks(column):
        row = ch.word_row
        salt = mix(np.arange(ch.rows, dtype=np.uint64) + np.uint64(1))
        words = ch.word_hash()
        at, h = ch.windows(words, REPEAT_WINDOW)
        more, _ = repeated(h + salt[row[at]]) if len(at) else (np.zeros(0, bool), None)
        hit = covered(len(words), at[more], REPEAT_WINDOW)
        parts["n_repeat_words"].append(np.bincount(row[hit], minlength=ch.rows))
        # lines: between line feeds and row edges
        feeds = np.flatnonzero(ch.buf == 10)
        # a row that is empty or ends with a line feed shares its edge with the next row
        opens = np.zeros(len(ch.buf) + 1, bool)
        opens[ch.off[:-1]] = True
        opens[feeds + 1] = True
        begin = np.flatnonzero(opens[:-1])
        # a line ends at the next line feed or at the end of its row
        line_row = np.searchsorted(ch.off[1:], begin, "right")
        stop = ch.off[line_row + 1]
        nxt = np.searchsorted(feeds, begin)
        has = nxt < len(feeds)
        stop = np.where(has, np.minimum(stop, feeds[np.minimum(nxt, max(0, len(feeds) - 1))] if len(feeds) else stop), stop)
        with_word = np.searchsorted(ch.start, stop) > np.searchsorted(ch.start, begin)
        begin, stop, line_row = begin[with_word], stop[with_word], line_row[with_word]
        keys = np.unique(ch.span_hash(begin, stop) + salt[line_row], return_index=True)[1] if len(begin) else np.zeros(0, np.int64)
        lines = np.bincount(line_row, minlength=ch.rows)
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(lines - np.bincount(line_row[keys], minlength=ch.rows))
        parts["n_words"].append(ch.n_words)
        parts["word_chars"].append(ch.per_row(~ch.space & ((ch.buf & 0xC0) != 0x80)))
        parts["n_symbols"].append(ch.per_row(_SYMBOL[ch.buf]))
        parts["n_upper"].append(ch.per_row(_UPPER[ch.buf]))
        parts["n_digits"].append(ch.per_row(_DIGIT[ch.buf]))
        parts["n_marks"].append(ch.per_row(_MARK[ch.buf]))
        alpha = np.concatenate(([0], np.cumsum(_ALPHA[ch.buf], dtype=np.int64)))
        whole = alpha[ch.end] - alpha[ch.start] == ch.end - ch.start
        parts["n_alpha_words"].append(np.bincount(row[whole], minlength=ch.rows))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in parts.items()}


def _statistics_batches(batches):
    for b in batches:
        found = count_statistics(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(found[c]) for c in STATS + EXTRA], schema=STATS_SCHEMA)


def statistics(docs: DataFrame) -> DataFrame:
    """One row of rule statistics per document, from its whole text."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _statistics_batches, STATS_DDL)


def base_failed():
    """The fixed base rules as a column over ``STATS``."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free feature rows for the forest, from arrays of statistics."""
    n = np.maximum(1, s["n_words"]).astype(float)
    chars = np.maximum(1, s["word_chars"]).astype(float)
    return np.column_stack([
        s["word_chars"] / n,
        np.minimum(4.0, s["n_symbols"] / n),
        s["n_dup_lines"] / np.maximum(1, s["n_lines"]),
        s["n_repeat_words"] / n,
        s["n_upper"] / chars,
        s["n_alpha_words"] / n,
        s["n_digits"] / chars,
        s["n_marks"] / chars,
    ])


@dataclass
class Forest:
    """Isolation trees as arrays: split feature (-1: leaf), split value, children, depth."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** -(mean path length / expected length), 0 to 1."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = rows
            while len(live):
                f = self.feature[at[live]]
                live = live[f >= 0]
                if not len(live):
                    break
                node = at[live]
                go = x[live, self.feature[node]] < self.value[node]
                at[live] = np.where(go, self.left[node], self.right[node])
            total += self.depth[at]
        return 2.0 ** (-(total / max(1, len(self.roots))) / self.normal)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int = 200, subsample: int = 256, seed: int = 7) -> Forest:
    """Grow isolation trees over random subsets of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(2, size)))) + 4
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(rows))])
        if len(rows) > 1 and depth < limit:
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if len(open_):
                f = int(rng.choice(open_))
                v = float(rng.uniform(low[f], high[f]))
                side = x[rows, f] < v
                if side.any() and not side.all():
                    nodes[me][:2] = f, v
                    nodes[me][2] = grow(rows[side], depth + 1)
                    nodes[me][3] = grow(rows[~side], depth + 1)
        return me

    roots = [grow(rng.choice(len(x), size, replace=False), 0) for _ in range(trees)]
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), max(1e-9, expected_path(size)))


@dataclass
class QualityModel:
    forest: Forest | None
    threshold: float


def fit_quality(stats: DataFrame, labels: DataFrame, *, max_rows: int = 8192, bad_share: float = 0.01,
                max_good_lost: float = 0.004, trees: int = 200, subsample: int = 256, seed: int = 7) -> QualityModel:
    """Forest over at most ``max_rows`` labelled rows, threshold from all labelled rows.

    The forest sees rows of quality 1 with a share ``bad_share`` of rows of quality 0, so
    that bad rows are rare in it.  Among the thresholds that reject at most
    ``max_good_lost`` of all good labelled rows, that which rejects most bad labelled rows
    is taken, the highest of several.  The driver
    receives at most ``max_rows`` rows of statistics and a histogram of 10,001 bins.
    """
    spark = stats.sparkSession
    cols = STATS + EXTRA
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    seen = stats.join(known, "doc_id").filter(~base_failed())
    seen = materialise(seen, "quality-labelled")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    bad_most = max(1, int(max_rows * bad_share))
    good = seen.filter("quality = 1").orderBy(order, "doc_id").limit(max_rows - bad_most).toPandas()
    if not len(good):
        return QualityModel(None, 1.1)
    bad = seen.filter("quality = 0").orderBy(order, "doc_id").limit(max(1, min(bad_most, int(len(good) * bad_share)))).toPandas()
    x = features({c: np.concatenate((good[c].to_numpy(), bad[c].to_numpy())) for c in cols})
    forest = grow_forest(x, trees, subsample, seed)
    sent = spark.sparkContext.broadcast(forest)
    bins = _scored(seen, sent, ["quality"]).groupBy("quality", F.floor(F.col("anomaly") * 10000).alias("b")).count().collect()
    count = {(r["quality"], r["b"]): r["count"] for r in bins}
    allowed = max_good_lost * sum(n for (q, _), n in count.items() if q == 1)
    threshold, lost, caught, most = 1.1, 0, 0, 0
    for b in sorted({b for _, b in count}, reverse=True):
        lost += count.get((1, b), 0)
        caught += count.get((0, b), 0)
        if lost > allowed:
            break
        if caught > most:
            threshold, most = b / 10000, caught
    return QualityModel(forest, threshold)


def _scored(stats: DataFrame, sent, keep: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    names = ["doc_id", *STATS, *EXTRA, *keep]
    ddl = ", ".join(f"`{n}` {fields[n]}" for n in names) + ", anomaly double"

    def score(batches):
        for b in batches:
            s = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATS + EXTRA}
            a = sent.value.score(features(s)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a)], names=[*b.schema.names, "anomaly"])

    return map_arrow(stats.select(*names), score, ddl)


def judge_quality(docs: DataFrame, labels: DataFrame, *, keep_extra: bool = False, **fit) -> DataFrame:
    """Statistics and verdict of every document.

    Returns doc_id, ``STATS``, base_failed, anomaly (0 to 1, null where no forest could be
    grown) and kept, which is false for failed base rules and for anomalies at or above
    the calibrated threshold.
    """
    stats = materialise(statistics(docs), "quality-stats")
    model = fit_quality(stats, labels, **fit)
    if model.forest is None:
        scored = stats.withColumn("anomaly", F.lit(None).cast("double"))
    else:
        scored = _scored(stats, stats.sparkSession.sparkContext.broadcast(model.forest), [])
    return scored.select(
        "doc_id", *STATS, *(EXTRA if keep_extra else []), base_failed().alias("base_failed"), "anomaly",
        (~base_failed() & (F.coalesce("anomaly", F.lit(0.0)) < model.threshold)).alias("kept"))


def _labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the documents with a label, and of few others.

    A filter of the labelled ids, where they are few enough for one, spares the others the
    count; the join with the labels decides.
    """
    ids = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = ids.count()
    if n <= FILTER_ROWS:
        bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(ids.select(F.xxhash64("doc_id")), n))

        def labelled(batches):
            for b in batches:
                b = b.filter(pa.array(in_filter(b.column(2).to_numpy().view(np.uint64), bits.value)))
                yield from _statistics_batches([b.select([0, 1])])

        ids_and_texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
        return materialise(map_arrow(ids_and_texts, labelled, STATS_DDL), "quality-stats")
    return materialise(statistics(docs), "quality-stats")


def drop_rejected(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents that the rules keep, with their columns.

    Each row is judged by its own text where it is read, so no text is shuffled; its
    doc_id, null or shared, doesn't matter.
    """
    model = fit_quality(_labelled_statistics(docs, labels), labels, **fit)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            s = count_statistics(b.column(at))
            n = s["n_words"]
            ok = (n >= MIN_WORDS) & (100 * s["n_repeat_words"] <= MAX_REPEAT_PERCENT * n)
            if sent.value.forest is not None and b.num_rows:
                ok &= sent.value.forest.score(features(s)) < sent.value.threshold
            yield b.filter(pa.array(ok))

    return map_arrow(docs, keep, docs.schema)

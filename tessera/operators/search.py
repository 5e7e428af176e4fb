"""Document search: inverted and positional index, Boolean, phrase, proximity, TF-IDF.

Documents are rows (doc_id, text).  Queries read postings filtered to their terms first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.text import SEPARATORS, jaccard, shingles, tokens
from tessera.sources.shared import written


def inverted_index(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    term = docs.select("doc_id", F.explode(F.split(F.lower("text"), SEPARATORS)).alias("term")).filter("term <> ''")
    return term.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def counted_index(docs: DataFrame) -> DataFrame:
    """``inverted_index`` of documents dealt out whole: texts are moved, not their words."""
    return inverted_index(docs.select("doc_id", "text").repartition("doc_id"))


def positional_index(docs: DataFrame) -> DataFrame:
    """(term, doc_id, pos), positions from 0."""
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).select("term", "doc_id", "pos")


def postings(index: DataFrame, term: str) -> DataFrame:
    return index.filter(F.col("term") == term.lower()).select("doc_id").distinct()


def boolean_and(index: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with all terms: one pass over the postings of any of them."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.filter(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select("doc_id")


def boolean_or(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.filter(F.col("term").isin(sorted({t.lower() for t in terms}))).select("doc_id").distinct()


def boolean_not(index: DataFrame, term: str, without: str) -> DataFrame:
    """Documents with ``term`` that lack ``without``."""
    return postings(index, term).join(postings(index, without), "doc_id", "left_anti")


def phrase_spans(positions: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, start, stop) of every occurrence of a phrase.

    Each position of a phrase word votes for the start it would give; starts with all
    votes are occurrences.  One shuffle, however long the phrase.
    """
    words = phrase.lower().split()
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    hits = positions.filter(F.col("term").isin(sorted(places)))
    offset = None
    for w, at in places.items():
        value = F.array(*[F.lit(i) for i in at])
        offset = F.when(F.col("term") == w, value) if offset is None else offset.when(F.col("term") == w, value)
    votes = hits.select("doc_id", "pos", F.explode(offset).alias("i")).select("doc_id", (F.col("pos") - F.col("i")).alias("start"), "i")
    full = votes.groupBy("doc_id", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(words))
    return full.select("doc_id", "start", (F.col("start") + len(words) - 1).alias("stop"))


def phrase_query(positions: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, occurrences)."""
    return phrase_spans(positions, phrase).groupBy("doc_id").agg(F.count("*").alias("occurrences"))


def proximity_query(positions: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """(doc_id, distance): documents where both sides come within ``within`` words.

    The distance is that from the end of the earlier side to the start of the later one.
    Each occurrence only needs the nearest one of the other side before it, found by a
    window, so no pairs of positions are made.
    """
    spans = phrase_spans(positions, left).withColumn("side", F.lit("a")).unionByName(phrase_spans(positions, right).withColumn("side", F.lit("b")))
    before = W.partitionBy("doc_id").orderBy("start", "stop", "side").rowsBetween(W.unboundedPreceding, -1)
    last_a = F.max(F.when(F.col("side") == "a", F.col("stop"))).over(before)
    last_b = F.max(F.when(F.col("side") == "b", F.col("stop"))).over(before)
    gap = F.col("start") - F.when(F.col("side") == "a", last_b).otherwise(last_a)
    near = spans.withColumn("gap", gap).filter((F.col("gap") >= 1) & (F.col("gap") <= within))
    return near.groupBy("doc_id").agg(F.min("gap").alias("distance"))


def parse_proximity(query: str) -> tuple[str, int, str]:
    """Sides and width of a query such as ``acid /5 corrosive``."""
    left, _, rest = query.partition(" /")
    number, _, right = rest.partition(" ")
    return left.strip(), int(number), right.strip()


def idf_table(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    n = docs.agg(F.count("*").alias("n")).scalar()  # a subquery of one value
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def previous_of(rows: DataFrame, group: str, key: str, *, bucket: int = 100_000) -> DataFrame:
    """(key, previous): for each integer key the one before it in its group, if any.

    Keys are cut into ranges; each range looks back inside itself, and its first row takes
    the last key of the ranges before it, of which only one row each is kept.
    """
    cut = rows.select(group, key, F.floor(F.col(key) / F.lit(bucket)).alias("_range"))
    inside = cut.withColumn("_inside", F.lag(key).over(W.partitionBy(group, "_range").orderBy(key)))
    ends = cut.groupBy(group, "_range").agg(F.max(key).alias("_last"))
    before = ends.select(group, "_range", F.max("_last").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    joined = inside.join(before, [group, "_range"])
    return joined.select(key, F.coalesce("_inside", "_before").alias("previous")).filter("previous is not null")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


def tfidf_search(docs: DataFrame, queries: DataFrame, *, k: int = 5, least_idf: float | None = None, least_jaccard: float | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): top k by TF-IDF cosine (raw counts, L2 norms).

    With ``least_idf`` and ``least_jaccard``, index elimination comes first: query terms
    below that idf are left out, and so are documents whose distinct terms have a lower
    Jaccard similarity with the remaining query terms.  Scores have eight decimals.
    """
    index = written(counted_index(docs), "index")  # read for idf, norms and postings
    idf = written(idf_table(index, docs), "idf")
    w = F.col("tf") * F.col("idf")
    norms = index.join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.count("*").alias("doc_terms"))
    q = inverted_index(queries.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")
    qw = written(q.join(idf, "term").select("item_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("qw")), "asked")
    qnorm = qw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    if least_idf is not None:
        qw = qw.filter(F.col("idf") >= least_idf)
    kept = qw.groupBy("item_id").agg(F.count("*").alias("query_terms"))
    # a document's postings of query terms come together before items multiply them
    postings = index.join(qw.select("term", "idf").distinct(), "term").select("doc_id", "term", w.alias("w")).repartition("doc_id")
    dots = postings.join(qw.select("item_id", "term", "qw"), "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"), F.count("*").alias("shared"))
    full = dots.join(norms, "doc_id").join(qnorm, "item_id").join(kept, "item_id")
    if least_jaccard is not None:
        full = full.filter(F.col("shared") / (F.col("query_terms") + F.col("doc_terms") - F.col("shared")) >= least_jaccard)
    return _ranked(full.select("item_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 8).alias("score")), k)


def shingle_difference(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Shingles that one text of a pair has alone.

    ``pairs`` has left_id, left_text, right_id, right_text.  Returns the ids, the arrays
    only_left and only_right, and the similarity.
    """
    a, b = shingles(tokens(F.col("left_text")), n), shingles(tokens(F.col("right_text")), n)
    cut = pairs.select("left_id", "right_id", a.alias("a"), b.alias("b"))
    return cut.select("left_id", "right_id", F.array_except("a", "b").alias("only_left"), F.array_except("b", "a").alias("only_right"), jaccard(F.col("a"), F.col("b")).alias("similarity"))

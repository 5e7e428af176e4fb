"""Top-k TF-IDF cosine by block bounds: only blocks that can reach the k-th score are scored.

Documents of like norm form blocks.  A block keeps, for each of its terms, the greatest
normalised weight, so the bounds of an item's terms in a block add up to no less than the
score of any document there.  The blocks with the highest bounds are scored first, which
gives each item a k-th score that the answer cannot fall below.  Of the other blocks those
are scored whose bounds add up to that score.  The answer is that of scoring everything.

A block is one row with the postings of all its documents, and what is made of it stays in
its task: only sums of bounds, a row for each item and block, are shuffled and written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.operators.search import counted_index, idf_table, inverted_index
from tessera.sources.shared import written

#: Documents of a block, and blocks of an item that are scored first.
BLOCK, PROBES = 8, 32
#: Scores have eight decimals: what comes this near the k-th one may tie with it.
MARGIN = 2e-8
#: Terms of one in so many documents are common: at most that many times a document's mean number of terms.
COMMON = 1000


@dataclass
class BlockIndex:
    """``blocks`` (block, terms), where ``terms`` lists (term, bound, hits) and ``hits`` (doc_id, w, norm, doc_terms).

    ``asked`` are the queries that ``bounded`` was last given.
    """

    blocks: DataFrame
    asked: DataFrame | None = None

    @property
    def cells(self) -> DataFrame:
        """(block, term, bound, hits)."""
        return self.blocks.select("block", F.inline("terms"))

    @property
    def postings(self) -> DataFrame:
        """(term, block, doc_id, w, norm, doc_terms)."""
        return self.cells.select("term", "block", F.inline("hits"))


def _norms(index: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, norm, doc_terms): only the postings of terms that are not common are shuffled by term."""
    common = F.broadcast(idf.filter(F.col("idf") <= 1 + math.log(COMMON)).select("term", "idf"))
    rare = index.join(common, "term", "left_anti").join(idf.filter(F.col("idf") > 1 + math.log(COMMON)).select("term", "idf"), "term")
    w = F.col("tf") * F.col("idf")
    sums = [x.groupBy("doc_id").agg(F.sum(w * w).alias("squares"), F.count("*").alias("n")) for x in (index.join(common, "term"), rare)]
    return sums[0].unionByName(sums[1]).groupBy("doc_id").agg(F.sqrt(F.sum("squares")).alias("norm"), F.sum("n").alias("doc_terms"))


def block_index(index: DataFrame, idf: DataFrame, terms: DataFrame, *, size: int = BLOCK) -> BlockIndex:
    """Blocks of the documents of ``index`` (term, doc_id, tf) with postings of ``terms``.

    Norms are of all terms.  Blocks are cut inside quarter octaves of the norm, by a hash
    of the doc_id, into as many as hold about ``size`` documents.
    """
    norms = written(_norms(index, idf).withColumn("octave", F.floor(F.log2("norm") * 4)), "norms")
    cuts = norms.groupBy("octave").agg(F.ceil(F.count("*") / F.lit(size)).alias("cuts"))  # a row a quarter octave
    slot = F.pmod(F.xxhash64("doc_id"), F.col("cuts"))
    placed = norms.join(cuts, "octave").select("doc_id", "norm", "doc_terms", (F.col("octave") * F.lit(1 << 40) + slot).alias("block"))
    own = index.join(terms.select("term", "idf"), "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w"))
    dealt = own.join(placed, "doc_id").repartition("block")
    cells = dealt.groupBy("block", "term").agg(F.max(F.col("w") / F.col("norm")).alias("bound"), F.collect_list(F.struct("doc_id", "w", "norm", "doc_terms")).alias("hits"))
    return BlockIndex(written(cells.groupBy("block").agg(F.collect_list(F.struct("term", "bound", "hits")).alias("terms")), "blocks"))


def _by_block(pairs: DataFrame) -> DataFrame:
    """(block, items) of (item_id, block)."""
    return pairs.groupBy("block").agg(F.collect_list("item_id").alias("items"))


def _scored(wanted: DataFrame, index: BlockIndex, least_jaccard: float | None) -> DataFrame:
    """(item_id, doc_id, score) of all documents of each block in ``wanted`` (block, items) for each of its items."""
    cells = index.blocks.join(wanted, "block").select("block", "items", F.inline("terms"))
    met = cells.join(index.asked.select("item_id", "term", "qw", "qnorm", "query_terms"), "term").filter(F.array_contains("items", F.col("item_id")))
    hits = met.select("item_id", "block", "qw", "qnorm", "query_terms", F.inline("hits"))
    full = hits.groupBy("block", "item_id", "doc_id").agg(  # blocks lie together already
        F.sum(F.col("qw") * F.col("w")).alias("dot"), F.count("*").alias("shared"), F.first("norm").alias("norm"),
        F.first("doc_terms").alias("doc_terms"), F.first("qnorm").alias("qnorm"), F.first("query_terms").alias("query_terms"))
    if least_jaccard is not None:
        full = full.filter(F.col("shared") / (F.col("query_terms") + F.col("doc_terms") - F.col("shared")) >= least_jaccard)
    return full.select("item_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 8).alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


def query_terms(queries: DataFrame, idf: DataFrame, least_idf: float | None = None) -> DataFrame:
    """(item_id, term, idf, qw, qnorm, query_terms): terms below ``least_idf`` only count in the norm."""
    q = inverted_index(queries.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")
    qw = q.join(idf, "term").select("item_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    item = W.partitionBy("item_id")
    qw = qw.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(item)))
    if least_idf is not None:
        qw = qw.filter(F.col("idf") >= least_idf)
    return qw.withColumn("query_terms", F.count("*").over(item))


def bounded(asked: DataFrame, index: BlockIndex) -> DataFrame:
    """(item_id, block, most): no score in the block is above ``most``."""
    index.asked = asked
    hit = index.cells.select("block", "term", "bound").join(asked.select("item_id", "term", (F.col("qw") / F.col("qnorm")).alias("share")), "term")
    return hit.groupBy("item_id", "block").agg(F.sum(F.col("share") * F.col("bound")).alias("most"))


def candidates(held: DataFrame, index: BlockIndex, k: int, *, least_jaccard: float | None = None, probes: int = PROBES) -> DataFrame:
    """(item_id, doc_id, score) of the documents that reach the item's k-th score among the blocks scored first."""
    order = W.partitionBy("item_id").orderBy(F.desc("most"), "block")
    first = written(_by_block(held.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= probes)), "probes")
    probed = _ranked(_scored(first, index, least_jaccard), k)
    # without k documents so far everything may be an answer
    floor = written(probed.filter(F.col("rank") == k).select("item_id", (F.col("score") - MARGIN).alias("floor")), "floor")
    least = F.coalesce("floor", F.lit(0.0))
    live = held.join(floor, "item_id", "left").filter(F.col("most") >= least)
    return _scored(_by_block(live), index, least_jaccard).join(floor, "item_id", "left").filter(F.col("score") >= least).select("item_id", "doc_id", "score")


def tfidf_search(docs: DataFrame, queries: DataFrame, *, k: int = 5, least_idf: float | None = None, least_jaccard: float | None = None, size: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(item_id, doc_id, score, rank): top k by TF-IDF cosine (raw counts, L2 norms).

    With ``least_idf`` and ``least_jaccard``, index elimination comes first: query terms
    below that idf are left out, and so are documents whose distinct terms have a lower
    Jaccard similarity with the remaining query terms.  Scores have eight decimals.
    """
    index = written(counted_index(docs), "index")  # read for idf, norms and postings
    idf = written(idf_table(index, docs), "idf")
    asked = written(query_terms(queries, idf, least_idf), "asked")
    blocks = block_index(index, idf, asked.select("term", "idf").distinct(), size=size)
    held = written(bounded(asked, blocks), "bounds")
    return _ranked(candidates(held, blocks, k, least_jaccard=least_jaccard, probes=probes), k)

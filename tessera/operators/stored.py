"""A positional index kept as files: queries read the folders of their terms alone.

Documents are numbered in the order of their ids and cut into blocks of as many; a row holds
what one term has in one block: the documents as offsets from the block's start, and their
positions.  Rows are dealt out by a hash of the term into folders and sorted by term inside
them; Parquet's second format packs offsets and positions as differences.  A term that all
documents have is as many rows as there are blocks, never one.  Blocks that lack a word of
a phrase are passed over before any postings are unpacked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.numbering import numbered
from tessera.operators.search import phrase_query, positional_index, proximity_query
from tessera.sources.shared import written

FOLDERS, BLOCK = 64, 1024


def _folder(term, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str, *, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders
        self.rows = spark.read.parquet(f"{self.path}/terms")
        self.docs = spark.read.parquet(f"{self.path}/docs")

    @staticmethod
    def build(docs: DataFrame, path: str, *, folders: int = FOLDERS, block: int = BLOCK) -> StoredIndex:
        """Write the index of (doc_id, text); doc_ids are distinct integers."""
        numbers = numbered(docs.select("doc_id"), ["doc_id"], "no", start=0)
        numbers.write.parquet(f"{path}/docs")
        # documents are dealt out whole with their numbers, so that words are gathered where they lie
        whole = docs.select("doc_id", "text").join(docs.sparkSession.read.parquet(f"{path}/docs"), "doc_id").select(F.col("no").alias("doc_id"), "text").repartition("doc_id")
        hits = positional_index(whole).groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
        placed = hits.select("term", F.floor(F.col("doc_id") / F.lit(block)).cast("int").alias("block"), F.struct((F.col("doc_id") % block).cast("int").alias("at"), "places").alias("hit"))
        # dealt out by folder once, for the blocks and for the files; a block's documents at most
        rows = placed.withColumn("folder", _folder(F.col("term"), folders)).repartition(folders, "folder").groupBy("folder", "term", "block").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        rows = rows.select("term", "block", F.lit(block).alias("width"), "hits.at", "hits.places", "folder")
        rows.sortWithinPartitions("folder", "term", "block").write.option("parquet.writer.version", "v2").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/terms")
        return StoredIndex(docs.sparkSession, path, folders=folders)

    def blocks(self, terms: list[str]) -> DataFrame:
        """The rows of the terms, read from their folders."""
        terms = sorted({t.lower() for t in terms})
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_folder(F.col("t"), self.folders)).distinct().collect()]
        return self.rows.filter(F.col("folder").isin(folders) & F.col("term").isin(terms))

    def positions(self, terms: list[str], *, every: list[list[str]] = ()) -> DataFrame:
        """(term, doc_id, pos); with ``every``, of blocks where all terms of each list stand."""
        rows = self.blocks(terms)
        for group in every:
            wanted = sorted({t.lower() for t in group})
            full = rows.filter(F.col("term").isin(wanted)).groupBy("block").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("block")
            rows = rows.join(full, "block", "left_semi")
        hit = rows.select("term", (F.col("block").cast("long") * F.col("width")).alias("start"), F.explode(F.arrays_zip("at", "places")).alias("h"))
        places = hit.select("term", (F.col("start") + F.col("h.at")).alias("no"), F.explode("h.places").alias("pos"))
        return places.join(self.docs, "no").select("term", "doc_id", "pos")

    def phrase(self, phrase: str) -> DataFrame:
        """(doc_id, occurrences)."""
        words = phrase.lower().split()
        return phrase_query(self.positions(words, every=[words]), phrase)

    def proximity(self, left: str, right: str, within: int) -> DataFrame:
        """(doc_id, distance) as ``search.proximity_query`` gives."""
        a, b = left.lower().split(), right.lower().split()
        # read twice, once a side; both sides must stand in a block
        return proximity_query(written(self.positions(a + b, every=[a + b]), "positions"), left, right, within)

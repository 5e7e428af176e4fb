"""Tolerant name retrieval: k-gram index, edit distance, phonetic code, wildcards.

Vocabularies are tables (ord, term), queries tables with a ``query`` column.  All stages
are equi-joins, so neither side has to fit one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.text import kgrams, normalised, sound_code
from tessera.operators.numbering import numbered

MAX_EDITS = 2
MAX_CANDIDATES = 5


def ordered(names: DataFrame) -> DataFrame:
    """(ord, term): distinct names numbered from 1 in their order."""
    return numbered(names.select("term").distinct(), ["term"], "ord").select(F.col("ord").cast("int").alias("ord"), "term")


def kgram_index(vocabulary: DataFrame, k: int = 3) -> DataFrame:
    """One row (gram, term) for each distinct gram of a term."""
    return vocabulary.select("term").distinct().select(F.explode(kgrams(F.col("term"), k)).alias("gram"), "term")


def kgram_candidates(queries: DataFrame, index: DataFrame, *, k: int = 3, min_overlap: int = 1) -> DataFrame:
    """(query, term, overlap): terms that share at least ``min_overlap`` grams."""
    grams = queries.select("query").distinct().select("query", F.explode(kgrams(F.col("query"), k)).alias("gram"))
    return grams.join(index, "gram").groupBy("query", "term").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= min_overlap)


def rare_grams(texts: DataFrame, column: str, counts: DataFrame, k: int, max_edits: int) -> DataFrame:
    """(column, size, gram): the ``k * max_edits + 1`` rarest grams of each text, and its length.

    ``counts`` has the number of terms of each gram; grams that it lacks are the rarest.
    """
    cut = texts.select(column).distinct().select(column, F.length(column).alias("size"), F.explode(kgrams(F.col(column), k)).alias("gram"))
    found = cut.join(counts, "gram", "left").groupBy(column, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("terms", F.lit(0)).alias("terms"), "gram"))).alias("grams"))
    return found.select(column, "size", F.explode(F.slice("grams", 1, k * max_edits + 1)).alias("g")).select(column, "size", "g.gram")


def near_pairs(queries: DataFrame, vocabulary: DataFrame, *, k: int = 3, max_edits: int = MAX_EDITS) -> DataFrame:
    """(query, term, overlap, distance): terms within ``max_edits`` that share a gram.

    One edit changes at most k grams, so of a pair's grams each side lacks at most
    ``k * max_edits``; in one order of all grams, rarest first, the first
    ``k * max_edits + 1`` of both then have one in common.  Only these are joined, and only
    at lengths that differ by ``max_edits`` at most: frequent grams such as ``$a`` come last
    and are joined for the shortest names alone.  Nothing is lost against joining all grams.

    Queries are in lower case, or have letters whose lower case is one letter too.
    """
    terms = vocabulary.select(F.lower("term").alias("low"), "term").distinct()
    counts = terms.select("low").distinct().select(F.explode(kgrams(F.col("low"), k)).alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"))
    asked = rare_grams(queries, "query", counts, k, max_edits)
    held = rare_grams(terms, "low", counts, k, max_edits)
    lengths = F.sequence(F.greatest(F.col("size") - max_edits, F.lit(0)), F.col("size") + max_edits)
    met = asked.select("query", "gram", F.explode(lengths).alias("size")).join(held, ["gram", "size"]).select("query", "low").distinct()
    near = met.withColumn("distance", F.levenshtein("query", "low", max_edits)).filter("distance >= 0")
    overlap = F.size(F.array_intersect(kgrams(F.col("query"), k), kgrams(F.col("low"), k)))
    return near.join(terms, "low").select("query", "term", overlap.cast("long").alias("overlap"), "distance")


def nearest(near: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(query, term, distance, rank): least distance, then most overlap, then by term."""
    best = W.partitionBy("query").orderBy("distance", F.desc("overlap"), "term")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query", "term", "distance", "rank")


def edit_matches(candidates: DataFrame, *, max_edits: int = MAX_EDITS, limit: int = MAX_CANDIDATES) -> DataFrame:
    """``nearest`` among candidates (query, term, overlap)."""
    return nearest(candidates.withColumn("distance", F.levenshtein("query", F.lower("term"), max_edits)).filter("distance >= 0"), limit)


def sound_matches(queries: DataFrame, vocabulary: DataFrame, *, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(query, term, rank): terms of equal phonetic code, in vocabulary order.

    The rank depends on the code alone: the first terms of each code are kept before the join.
    """
    v = vocabulary.select("ord", "term", sound_code(F.col("term")).alias("code"))
    first = v.withColumn("rank", F.row_number().over(W.partitionBy("code").orderBy("ord", "term"))).filter(F.col("rank") <= limit)
    return queries.select("query", sound_code(F.col("query")).alias("code")).join(first, "code").select("query", "term", "rank")


def resolve(queries: DataFrame, vocabulary: DataFrame, *, k: int = 3, max_edits: int = MAX_EDITS, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Cascade: exact, then grams and edit distance, then phonetic code.

    Later stages only count for queries that no earlier stage resolved.  Returns the original
    query, term, stage, distance (null for phonetic matches) and rank.
    """
    asked = queries.select("query").distinct().select(F.col("query").alias("asked"), normalised(F.col("query")).alias("query"))
    forms = asked.select("query").distinct()
    exact = forms.join(vocabulary.select("ord", "term", F.lower("term").alias("query")), "query")
    exact = exact.select("query", "term", F.lit("exact").alias("stage"), F.lit(0).alias("distance"), F.row_number().over(W.partitionBy("query").orderBy("ord", "term")).alias("rank"))
    open1 = forms.join(exact.select("query").distinct(), "query", "left_anti")
    near = nearest(near_pairs(open1, vocabulary, k=k, max_edits=max_edits), limit)
    near = near.select("query", "term", F.lit("edit_distance").alias("stage"), "distance", "rank")
    sound = sound_matches(open1, vocabulary, limit=limit).select("query", "term", F.lit("soundex").alias("stage"), F.lit(None).cast("int").alias("distance"), "rank")
    # both stages in one go: phonetic matches only stay where the nearer ones are missing
    late = near.unionByName(sound).withColumn("_near", F.max(F.col("stage") == "edit_distance").over(W.partitionBy("query")))
    late = late.filter((F.col("stage") == "edit_distance") | ~F.col("_near")).drop("_near")
    found = exact.unionByName(late)
    return asked.join(found, "query").select(F.col("asked").alias("query"), "term", "stage", "distance", "rank")


def wildcard_parts(pattern: Column) -> tuple[Column, Column]:
    """Whether a pattern asks for a prefix, and its stem; the stem is null if malformed.

    A pattern has exactly one ``*``, as its first or last character, and more than that.
    """
    p = normalised(pattern)
    stars = F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit("")))
    ok = (stars == 1) & (F.length(p) > 1) & (p.startswith("*") | p.endswith("*"))
    return p.endswith("*"), F.when(ok, F.trim(F.replace(p, F.lit("*"), F.lit(""))))


def wildcard_matches(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pattern, ord, term): terms with a token, or whole, that the pattern fits.

    The tokens' prefixes and suffixes of the lengths that patterns ask for are joined by
    equality, so that no pattern is held against every term.
    """
    prefix, stem = wildcard_parts(F.col("pattern"))
    asked = patterns.select("pattern").distinct().select("pattern", prefix.alias("is_prefix"), stem.alias("stem")).filter("stem is not null and stem <> ''")
    asked = asked.withColumn("size", F.length("stem"))
    # at most two rows, of at most as many lengths as the longest pattern has
    sizes = asked.groupBy("is_prefix").agg(F.collect_set("size").alias("sizes"))
    word = vocabulary.select("ord", "term", F.explode(F.array_distinct(F.split(F.lower("term"), r"\s+"))).alias("token"))
    sided = word.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_prefix")).join(F.broadcast(sizes), "is_prefix")
    cut = sided.select("ord", "term", "token", "is_prefix", F.explode(F.filter("sizes", lambda n: n <= F.length("token"))).alias("size"))
    part = F.when(F.col("is_prefix"), F.substring("token", F.lit(1), F.col("size"))).otherwise(F.substring("token", -F.col("size"), F.col("size")))
    keyed = cut.select("ord", "term", "is_prefix", part.alias("stem")).distinct()
    return asked.join(keyed, ["is_prefix", "stem"]).select("pattern", "ord", "term").distinct()

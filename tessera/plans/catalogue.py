"""Driver queries of the engine's own operators and their SQL twins.

The driver's tables carry no chemistry, so they take roles: the vocabulary is the distinct
part names; sources are the suppliers of a part, with thresholds from their line items;
readings are the events, with user_id as zone and part; transactions are the part types of
an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.functions.text import DOMAIN_TOKEN, PROTECTED, STOP_WORDS, SUFFIXES, domain_tokens, jaccard, shingle_hashes, shingles, sound_code, stem, tokens
from tessera.operators import chat, crawl, evidence, metrics, mining, ranked, retrieval, search, severity, similar, verdict
from tessera.operators.stored import StoredIndex
from tessera.sources import tables, topics
from tessera.sources.committed import CommittedTable
from tessera.sources.shared import shared_dir, temporary, written
from tessera.sources.tables import table
from tessera.streaming import monitor, stateful

METRICS = ["click", "error", "purchase", "signup", "view"]
TIERS = [*evidence.AUTHORITY, "Other"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f
    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- retrieval

def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("term")).filter("term is not null").distinct()


def _vocabulary(spark, d):
    return retrieval.ordered(_names(spark, d))


def _misspelt(spark, d):
    v = _names(spark, d)
    half = (F.length("term") / 2).cast("int")
    return v.select(F.concat(F.substring("term", F.lit(1), half - 1), F.substring("term", half + 1, F.length("term"))).alias("query"), "term")


def _asked(spark, d):
    """Exact with other case and spaces, one letter less, and doubled vowels."""
    v = _names(spark, d)
    exact = v.select(F.concat(F.lit("  "), F.upper("term"), F.lit(" ")).alias("query"), "term", F.lit("exact").alias("category"))
    typo = _misspelt(spark, d).select("query", "term", F.lit("misspelled").alias("category"))
    sound = v.select(F.regexp_replace("term", "([aeiou])", "$1e$1e").alias("query"), "term", F.lit("phonetic").alias("category"))
    return exact.unionByName(typo).unionByName(sound)


_VOC = "voc AS (SELECT CAST(row_number() OVER (ORDER BY term) AS INT) AS ord, term FROM (SELECT DISTINCT p_name AS term FROM part WHERE p_name IS NOT NULL))"
_TYPO = "typo AS (SELECT substr(term, 1, CAST(floor(length(term) / 2.0) AS INT) - 1) || substr(term, CAST(floor(length(term) / 2.0) AS INT) + 1) AS query, term FROM voc)"


def _grams(source: str, column: str) -> str:
    return f"SELECT DISTINCT {column}, substr('$' || lower({column}) || '$', CAST(i AS INT), 3) AS gram FROM {source}, LATERAL (SELECT unnest(range(1, greatest(length({column}), 1) + 1)) AS i)"


def _sound_sql(column: str) -> str:
    letters = f"regexp_replace(lower({column}), '[^\\p{{L}}]', '', 'g')"
    codes = f"regexp_replace(translate({letters}, 'bfpvcgjkqsxzdtlmnr', '111122222222334556'), '[^0-9]', '0', 'g')"
    for digit in "0123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE substr(upper(substr({letters}, 1, 1)) || replace(substr({codes}, 2), '0', '') || '000', 1, 4) END"


_CAND = f"gi AS ({_grams('voc', 'term')}), cand AS (SELECT query, term, count(*) AS overlap FROM ({_grams('forms', 'query')}) q JOIN gi USING (gram) GROUP BY 1, 2)"
_CASCADE = f"""
{_VOC}, {_TYPO},
asked AS (SELECT '  ' || upper(term) || ' ' AS asked, term AS want, 'exact' AS category FROM voc
  UNION ALL SELECT query, term, 'misspelled' FROM typo
  UNION ALL SELECT regexp_replace(term, '([aeiou])', '\\1e\\1e', 'g'), term, 'phonetic' FROM voc),
norm AS (SELECT DISTINCT asked, lower(trim(asked)) AS query FROM asked),
forms0 AS (SELECT DISTINCT query FROM norm),
ex AS (SELECT query, term, 'exact' AS stage, 0 AS distance, row_number() OVER (PARTITION BY query ORDER BY ord, term) AS rank FROM forms0 JOIN voc ON lower(term) = query),
forms AS (SELECT query FROM forms0 WHERE query NOT IN (SELECT query FROM ex)),
{_CAND},
near AS (SELECT query, term, 'edit_distance' AS stage, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, overlap DESC, term) AS rank FROM
  (SELECT query, term, overlap, levenshtein(query, lower(term)) AS distance FROM cand) WHERE distance <= 2) WHERE rank <= 5),
snd AS (SELECT query, term, 'soundex' AS stage, NULL AS distance, rank FROM (SELECT f.query, v.term, row_number() OVER (PARTITION BY f.query ORDER BY v.ord, v.term) AS rank
  FROM forms f JOIN voc v ON {_sound_sql('f.query')} = {_sound_sql('v.term')} WHERE f.query NOT IN (SELECT query FROM near)) WHERE rank <= 5),
res AS (SELECT asked AS query, term, stage, CAST(distance AS INT) AS distance, CAST(rank AS INT) AS rank FROM norm JOIN (SELECT * FROM ex UNION ALL SELECT * FROM near UNION ALL SELECT * FROM snd) USING (query))
"""


@query(f"WITH {_VOC} {_grams('voc', 'term')}")
def kgram_index(spark, d):
    return retrieval.kgram_index(_names(spark, d))


@query(f"WITH {_VOC}, {_TYPO}, forms AS (SELECT DISTINCT query FROM typo), {_CAND} SELECT query, term, overlap FROM cand WHERE overlap >= 2")
def kgram_candidates(spark, d):
    return retrieval.kgram_candidates(_misspelt(spark, d), retrieval.kgram_index(_names(spark, d)), min_overlap=2)


@query(f"""WITH {_VOC}, {_TYPO}, forms AS (SELECT DISTINCT query FROM typo), {_CAND}
SELECT query, term, CAST(distance AS INT) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, overlap DESC, term) AS rank FROM
(SELECT query, term, overlap, levenshtein(query, lower(term)) AS distance FROM cand) WHERE distance <= 2) WHERE rank <= 5""")
def edit_distance_match(spark, d):
    return retrieval.nearest(retrieval.near_pairs(_misspelt(spark, d), _names(spark, d)))


@query(f"WITH {_CASCADE} SELECT * FROM res")
def tolerant_cascade(spark, d):
    return retrieval.resolve(_asked(spark, d), _vocabulary(spark, d))


@query(f"SELECT s_suppkey, {_sound_sql('s_name')} AS code FROM supplier UNION ALL SELECT p_partkey + 1000000000, {_sound_sql('p_name')} FROM part")
def soundex_codes(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", sound_code(F.col("s_name")).alias("code"))
    return s.unionByName(table(spark, d, "part").select((F.col("p_partkey") + 1000000000).alias("s_suppkey"), sound_code(F.col("p_name")).alias("code")))


@query(f"SELECT {_sound_sql('p_name')} AS code, count(*) AS n_parts, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def soundex_blocks(spark, d):
    return table(spark, d, "part").groupBy(sound_code(F.col("p_name")).alias("code")).agg(F.count("*").alias("n_parts"), F.count_distinct("p_name").alias("n_names"))


def _patterns(spark, d, prefix):
    token = _names(spark, d).select(F.explode(F.split(F.lower("term"), r"\s+")).alias("t")).distinct()
    return token.select((F.concat(F.substring("t", 1, 3), F.lit("*")) if prefix else F.concat(F.lit("*"), F.substring("t", -3, 3))).alias("pattern")).distinct()


def _wild_sql(make: str, test: str) -> str:
    return f"""WITH {_VOC}, tok AS (SELECT ord, term, unnest(regexp_split_to_array(lower(term), '\\s+')) AS t FROM voc),
pat AS (SELECT DISTINCT {make} AS pattern FROM tok) SELECT DISTINCT pattern, ord, term FROM pat JOIN tok ON {test}"""


@query(_wild_sql("substr(t, 1, 3) || '*'", "starts_with(t, replace(pattern, '*', ''))"))
def wildcard_prefix(spark, d):
    return retrieval.wildcard_matches(_patterns(spark, d, True), _vocabulary(spark, d))


@query(_wild_sql("'*' || right(t, 3)", "ends_with(t, replace(pattern, '*', ''))"))
def wildcard_suffix(spark, d):
    return retrieval.wildcard_matches(_patterns(spark, d, False), _vocabulary(spark, d))


def _judged(spark, d):
    found = retrieval.resolve(_asked(spark, d), _vocabulary(spark, d)).filter("rank = 1")
    return _asked(spark, d).join(found.select("query", F.col("term").alias("top"), "stage"), "query", "left")


_EVAL = """, ev AS (SELECT category, want, top, stage, CASE WHEN top = want THEN 1.0 ELSE 0.0 END AS ok FROM asked LEFT JOIN (SELECT query, term AS top, stage FROM res WHERE rank = 1) r ON asked.asked = r.query)"""


@query(f"""WITH {_CASCADE} {_EVAL}, tk AS (SELECT DISTINCT substr(t, 1, 3) AS stem, term FROM (SELECT term, unnest(regexp_split_to_array(lower(term), '\\s+')) AS t FROM voc)),
wl AS (SELECT stem, count(*) AS np, count(*) FILTER (WHERE length(term) % 3 <> 0) AS ne FROM tk GROUP BY 1)
SELECT category, count(*) AS n_queries, round(avg(ok), 9) AS pass_rate, round(avg(ok), 9) AS precision, round(avg(ok), 9) AS recall, round(avg(ok), 9) AS f1 FROM ev GROUP BY 1
UNION ALL SELECT 'wildcard', count(*), round(avg(CASE WHEN np = ne THEN 1.0 ELSE 0.0 END), 9), round(avg(ne / np), 9), round(avg(CASE WHEN ne > 0 THEN 1.0 ELSE 0.0 END), 9), round(avg(2.0 * ne / (np + ne)), 9) FROM wl""")
def retrieval_metrics(spark, d):
    """A wildcard's expected set lacks the terms whose length three divides."""
    none = F.array().cast("array<string>")
    some = F.when(F.col("top").isNotNull(), F.array("top")).otherwise(none)
    names = _judged(spark, d).select("category", some.alias("predicted"), F.array("term").alias("expected"))
    found = retrieval.wildcard_matches(_patterns(spark, d, True), _vocabulary(spark, d)).groupBy("pattern").agg(F.collect_set("term").alias("predicted"))
    word = _names(spark, d).select("term", F.explode(F.split(F.lower("term"), r"\s+")).alias("t")).select("term", F.concat(F.substring("t", 1, 3), F.lit("*")).alias("pattern"))
    want = word.filter(F.length("term") % 3 != 0).groupBy("pattern").agg(F.collect_set("term").alias("expected"))
    wild = found.join(want, "pattern", "left").select(F.lit("wildcard").alias("category"), "predicted", F.coalesce("expected", none).alias("expected"))
    out = metrics.evaluate_sets(names.unionByName(wild))
    return out.select("category", "n_queries", *[F.round(c, 9).alias(c) for c in ("pass_rate", "precision", "recall", "f1")])


@query(f"WITH {_CASCADE} {_EVAL} SELECT category, sum(CASE WHEN top = want THEN 1 ELSE 0 END)::BIGINT AS n_right, count(*) AS n FROM ev GROUP BY 1")
def top1_accuracy(spark, d):
    return _judged(spark, d).groupBy("category").agg(F.count_if(F.col("top") == F.col("term")).alias("n_right"), F.count("*").alias("n"))


@query(f"""WITH {_CASCADE} {_EVAL} SELECT category, count(*) FILTER (WHERE stage = 'exact') AS n_exact, count(*) FILTER (WHERE stage = 'edit_distance') AS n_edit_distance,
count(*) FILTER (WHERE stage = 'soundex') AS n_soundex, count(*) FILTER (WHERE stage IS NULL) AS n_none FROM ev GROUP BY 1""")
def resolution_stages(spark, d):
    return metrics.stage_table(_judged(spark, d))


# ---------------------------------------------------------------- evidence

def _case(column, values):
    out = None
    for i, v in enumerate(values):
        out = F.when(column == i, v) if out is None else out.when(column == i, v)
    return out


def _sources(spark, d, parts=None):
    """One threshold for each part and supplier, from their line items; of ``parts`` (l_partkey) alone if given."""
    li = table(spark, d, "lineitem").filter("l_quantity <> 0")
    if parts is not None:
        li = li.join(parts, "l_partkey", "left_semi")
    agg = li.groupBy("l_partkey", "l_suppkey").agg(
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("m"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(F.concat(F.lit("H"), "l_returnflag"), F.concat(F.lit("H"), "l_linestatus")))))).alias("h"))
    s = table(spark, d, "supplier")
    j = agg.join(s, agg["l_suppkey"] == s["s_suppkey"])
    key = F.col("s_suppkey")
    base = j.select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("chemical"), key.alias("ord"), _case(key % 5, METRICS).alias("metric_name"),
        (F.floor("m") / F.lit(1000.0)).alias("value"), F.when(key % 11 == 0, "F").otherwise("C").alias("unit"), F.when(key % 3 == 0, "min").otherwise("max").alias("direction"),
        F.concat(F.lit("DOC-"), key.cast("string")).alias("sds_id"), F.col("s_name").alias("supplier_name"), F.lit("Section 7").alias("section_number"),
        evidence.authority(_case(F.col("s_nationkey") % 5, TIERS)).alias("authority_score"),
        F.when(key % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("h")).alias("hazard_statements"))
    return base.withColumn("citation", evidence.citation(*[F.col(c) for c in ("chemical", "sds_id", "supplier_name", "section_number", "metric_name", "value", "unit")]))


def _read_sources(spark, d):
    """Thresholds of the chemicals that readings name: no verdict needs others."""
    named = table(spark, d, "events").select(F.col("user_id").alias("l_partkey")).distinct()
    # they feed several aggregates, so they are written once
    return written(_sources(spark, d, named), "sources")


def _noted(spark, d):
    """What authority and notes need of the thresholds."""
    return _sources(spark, d).select("chemical", "metric_name", "ord", "supplier_name", "value", "unit", "authority_score")


def _readings(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("part-"), F.col("user_id").cast("string")).alias("chemical"), F.concat(F.lit("Z"), F.col("user_id").cast("string")).alias("zone_id"), F.col("event_type").alias("metric_name"), F.col("value").alias("current_value"), F.lit("C").alias("unit"))


def _sql_case(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_SCORE = "CASE s_nationkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.4 END::DOUBLE"
_SRC = f"""src AS (SELECT chemical, ord, metric_name, value, unit, direction, 'DOC-' || ord AS sds_id, supplier_name, authority_score, hazards,
 '[DOC-' || ord || '] Section 7 - ' || supplier_name || ': ' || chemical || ' ' || metric_name || ' threshold = ' || CAST(value AS VARCHAR) || ' ' || unit AS citation FROM (
SELECT 'part-' || l_partkey AS chemical, s_suppkey AS ord, {_sql_case('s_suppkey % 5', METRICS)} AS metric_name, floor(m) / 1000.0::DOUBLE AS value,
 CASE WHEN s_suppkey % 11 = 0 THEN 'F' ELSE 'C' END AS unit, CASE WHEN s_suppkey % 3 = 0 THEN 'min' ELSE 'max' END AS direction, s_name AS supplier_name, {_SCORE} AS authority_score,
 CASE WHEN s_suppkey % 13 = 0 THEN [] ELSE h END AS hazards
FROM (SELECT l_partkey, l_suppkey, max(l_extendedprice / l_quantity) AS m, list_sort(list_distinct(flatten(list(['H' || l_returnflag, 'H' || l_linestatus])))) AS h FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2)
JOIN supplier ON l_suppkey = s_suppkey))"""
_PAIRS = """prs AS (SELECT a.chemical, a.metric_name, a.ord AS i, b.ord AS j, a.supplier_name AS left_supplier, b.supplier_name AS right_supplier,
 len(list_intersect(a.hazards, b.hazards)) / (len(a.hazards) + len(b.hazards) - len(list_intersect(a.hazards, b.hazards)))::DOUBLE AS similarity
 FROM src a JOIN src b ON a.chemical = b.chemical AND a.metric_name = b.metric_name AND a.ord < b.ord WHERE len(a.hazards) > 0 AND len(b.hazards) > 0),
haz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chemical, metric_name ORDER BY i, j) AS rn FROM prs WHERE similarity < 0.6) WHERE rn = 1)"""


def _rec_sql(tolerance: str = "5.0") -> str:
    return f"""tops AS (SELECT *, max(authority_score) OVER (PARTITION BY chemical, metric_name) AS mx FROM src),
rec AS (SELECT chemical, metric_name, count(*) AS n_sources, count(*) FILTER (WHERE authority_score = mx) AS n_top,
 CASE WHEN count(*) FILTER (WHERE authority_score = mx) > 1 AND max(abs(value)) FILTER (WHERE authority_score = mx) > 0
  THEN (max(value) FILTER (WHERE authority_score = mx) - min(value) FILTER (WHERE authority_score = mx)) / max(abs(value)) FILTER (WHERE authority_score = mx) * 100.0 ELSE 0.0 END AS spread_percent,
 count(DISTINCT CASE WHEN authority_score = mx THEN unit END) > 1 AS mixed_units,
 min(CASE WHEN authority_score = mx THEN ord END) AS pord FROM tops GROUP BY 1, 2),
rec2 AS (SELECT rec.*, n_top > 1 AND spread_percent > {tolerance} AS conflict, s.value AS pvalue, s.unit AS punit, s.direction AS pdirection, s.supplier_name AS psupplier
 FROM rec JOIN src s ON s.chemical = rec.chemical AND s.metric_name = rec.metric_name AND s.ord = rec.pord)"""


_VERDICT = f"""{_SRC}, {_PAIRS}, {_rec_sql()},
rd AS (SELECT event_id, 'part-' || user_id AS chemical, 'Z' || user_id AS zone_id, event_type AS metric_name, value AS current_value, 'C' AS unit FROM events),
vd0 AS (SELECT rd.*, CASE WHEN rd.chemical NOT IN (SELECT chemical FROM src) THEN 'no_thresholds' WHEN n_sources IS NULL THEN 'no_metric' WHEN haz.rn IS NOT NULL THEN 'hazard_conflict'
  WHEN conflict THEN 'numeric_conflict' WHEN punit <> rd.unit THEN 'unit_mismatch' WHEN current_value IS NULL OR isnan(current_value) THEN 'no_value' ELSE 'compared' END AS cause, pvalue, pdirection
 FROM rd LEFT JOIN rec2 ON rd.chemical = rec2.chemical AND rd.metric_name = rec2.metric_name LEFT JOIN haz ON rd.chemical = haz.chemical AND rd.metric_name = haz.metric_name),
vd AS (SELECT *, CASE WHEN cause <> 'compared' THEN 'UNKNOWN' WHEN (pdirection = 'max' AND current_value >= pvalue) OR (pdirection = 'min' AND current_value <= pvalue) THEN 'WARNING' ELSE 'SAFE' END AS state FROM vd0)"""


@query(f"""WITH d AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS s FROM documents),
p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS prev_id, s, lag(s) OVER (PARTITION BY lang ORDER BY doc_id) AS ps FROM d)
SELECT doc_id, prev_id, CASE WHEN len(s) + len(ps) = 0 THEN 0.0 ELSE len(list_intersect(s, ps)) / (len(s) + len(ps) - len(list_intersect(s, ps)))::DOUBLE END AS similarity FROM p WHERE prev_id IS NOT NULL""")
def jaccard_pairs(spark, d):
    """Each document with the one before it in its language."""
    ids = table(spark, d, "documents").select("doc_id", "text", "lang")
    pairs = search.previous_of(ids, "lang", "doc_id").withColumnRenamed("previous", "prev_id")
    sets = ids.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("s"))
    prev = sets.select(F.col("doc_id").alias("prev_id"), F.col("s").alias("ps"))
    return pairs.join(sets, "doc_id").join(prev, "prev_id").select("doc_id", "prev_id", jaccard(F.col("s"), F.col("ps")).alias("similarity"))


@query("""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))) AS s FROM documents),
c AS (SELECT min(doc_id) AS id, s, count(*) AS copies FROM d WHERE len(s) > 0 GROUP BY s), t AS (SELECT id, unnest(s) AS t FROM c),
m AS (SELECT a.id AS i, b.id AS j, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT i AS left_id, j AS right_id, x.copies AS left_copies, y.copies AS right_copies, round(shared / (len(x.s) + len(y.s) - shared), 9) AS similarity
FROM m JOIN c x ON x.id = i JOIN c y ON y.id = j WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)""")
def set_similarity_join(spark, d):
    """Pairs of documents whose sets of words are alike by 0.8 and more."""
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("items"))
    return similar.similar_sets(sets)


@query(f"WITH {_SRC}, {_PAIRS} SELECT chemical, metric_name, i AS left_ord, j AS right_ord, left_supplier, right_supplier, similarity FROM haz")
def hazard_conflicts(spark, d):
    return evidence.hazard_conflicts(_sources(spark, d).select("chemical", "metric_name", "ord", "supplier_name", "hazard_statements"))


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 0.95::DOUBLE ELSE {_SCORE} END AS authority_score FROM supplier""")
def authority_scores(spark, d):
    custom = F.when(F.col("s_suppkey") % 10 == 0, F.lit(0.95))
    return table(spark, d, "supplier").select("s_suppkey", evidence.authority(_case(F.col("s_nationkey") % 5, TIERS), custom).alias("authority_score"))


@query(f"WITH {_SRC} SELECT chemical, ord, citation FROM src")
def citations(spark, d):
    return _sources(spark, d).select("chemical", "ord", "citation")


@query(f"""WITH {_SRC}, {_rec_sql()} SELECT chemical, metric_name, n_sources, n_top, spread_percent, conflict, mixed_units,
CASE WHEN NOT conflict THEN pord END AS primary_ord, CASE WHEN NOT conflict THEN pvalue END AS primary_value FROM rec2""")
def authoritative_threshold(spark, d):
    r = evidence.reconcile(_noted(spark, d))
    return r.select("chemical", "metric_name", "n_sources", "n_top", "spread_percent", "conflict", "mixed_units", F.col("primary.ord").alias("primary_ord"), F.col("primary.value").alias("primary_value"))


@query(f"""WITH {_SRC}, {_rec_sql()} SELECT t.chemical, t.metric_name, string_agg(t.supplier_name || '=' || CAST(t.value AS VARCHAR) || t.unit, ', ' ORDER BY t.ord) AS conflict_sources
FROM tops t JOIN rec2 r ON t.chemical = r.chemical AND t.metric_name = r.metric_name WHERE r.conflict AND t.authority_score = t.mx GROUP BY 1, 2""")
def conflict_sources(spark, d):
    src = _noted(spark, d)
    return evidence.conflict_summary(evidence.audit_notes(src, evidence.reconcile(src)))


@query(f"""WITH {_SRC}, {_rec_sql()} SELECT t.chemical, t.metric_name, t.ord, CASE WHEN r.conflict THEN 'Conflict: ' || t.supplier_name || '=' || CAST(t.value AS VARCHAR) || t.unit
ELSE CASE WHEN t.ord = r.pord THEN 'Selected primary authority ' ELSE 'Superseded secondary source ' END || chr(39) || t.supplier_name || chr(39) || ' (score=' || CAST(t.authority_score AS VARCHAR) || ')' END AS note
FROM tops t JOIN rec2 r ON t.chemical = r.chemical AND t.metric_name = r.metric_name WHERE NOT r.conflict OR t.authority_score = t.mx""")
def source_notes(spark, d):
    src = _noted(spark, d)
    return evidence.audit_notes(src, evidence.reconcile(src))


@query(f"WITH {_VERDICT} SELECT event_id, state, cause, CASE WHEN cause = 'compared' THEN pvalue END AS threshold_value FROM vd")
def safety_verdict(spark, d):
    return _verdicts(spark, d).select("event_id", "state", "cause", "threshold_value")


def _verdicts(spark, d):
    return verdict.evaluate(_readings(spark, d), _read_sources(spark, d))


def _alerts(spark, d):
    warnings = _verdicts(spark, d).filter(F.col("state") == verdict.WARNING).select("event_id", "zone_id", "chemical", "state")
    return verdict.alerts(warnings).select("event_id", "zone_id", "chemical", "alert_no", "alert_id", "status")


_ALERTS = f"{_VERDICT}, al AS (SELECT event_id, zone_id, chemical, row_number() OVER (ORDER BY event_id) AS alert_no FROM vd WHERE state = 'WARNING'), al2 AS (SELECT *, 'ALT_' || CASE WHEN alert_no < 10000 THEN lpad(CAST(alert_no AS VARCHAR), 4, '0') ELSE CAST(alert_no AS VARCHAR) END AS alert_id FROM al)"


@query(f"WITH {_ALERTS} SELECT event_id, zone_id, chemical, alert_no, alert_id, 'PENDING_SIGN_OFF' AS status FROM al2")
def alert_queue(spark, d):
    return _alerts(spark, d)


@query(f"WITH {_ALERTS} SELECT alert_id, CASE WHEN alert_no % 6 = 0 THEN 'REJECTED' WHEN alert_no % 3 = 0 THEN 'APPROVED' ELSE 'PENDING_SIGN_OFF' END AS status, CASE WHEN alert_no % 6 = 0 THEN 'second' WHEN alert_no % 3 = 0 THEN 'first' END AS signed_by FROM al2")
def alert_signoff(spark, d):
    """Every third alert is approved; every sixth is rejected by a later decision."""
    a = written(_alerts(spark, d), "alerts")
    first = a.filter("alert_no % 3 = 0").select("alert_id", F.lit(True).alias("approved"), F.lit("first").alias("signed_by"), F.lit("").alias("notes"), F.lit(1).alias("signed_at"))
    second = a.filter("alert_no % 6 = 0").select("alert_id", F.lit(False), F.lit("second"), F.lit(""), F.lit(2))
    return verdict.sign_off(a, first.union(second))[0].select("alert_id", "status", "signed_by")


@query(f"WITH {_SRC} SELECT n.chemical, metric_name AS parameter, value, unit, sds_id AS source_doc_id, citation AS version, 'UNKNOWN' AS state FROM (SELECT DISTINCT 'part-' || user_id AS chemical FROM events) n LEFT JOIN src ON src.chemical = n.chemical")
def evidence_query(spark, d):
    return verdict.evidence(_readings(spark, d).select("chemical"), _sources(spark, d))


@query(f"WITH {_SRC} SELECT chemical, metric_name, min(CASE WHEN direction = 'max' THEN value END) AS control_ceiling, max(CASE WHEN direction = 'min' THEN value END) AS control_floor, count(*) AS n_sources FROM src GROUP BY 1, 2")
def conservative_threshold(spark, d):
    return evidence.conservative(_sources(spark, d))


@query("""WITH v AS (SELECT l_partkey, l_suppkey, l_shipdate, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, price DESC) AS rn, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_versions,
max(price) OVER (PARTITION BY l_partkey, l_suppkey) AS hi, min(price) OVER (PARTITION BY l_partkey, l_suppkey) AS lo FROM v)
SELECT l_partkey, l_suppkey, l_shipdate, price, n_versions, (hi - lo) / hi * 100.0 > 5.0 AS version_conflict FROM r WHERE rn = 1""")
def version_preference(spark, d):
    v = table(spark, d, "lineitem").filter("l_quantity <> 0").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return evidence.current_versions(v, ["l_partkey", "l_suppkey"], "l_shipdate", "price", ["l_orderkey", "l_linenumber", "price"])


_TYPES = [r[0] for r in evidence.ROUTES]


@query(f"""SELECT event_id, {_sql_case('event_id % 6', _TYPES)} AS question_type, CASE WHEN event_id % 3 <> 0 OR event_id % 6 = 5 THEN {_sql_case('event_id % 6', [r[1] for r in evidence.ROUTES])}
ELSE {_sql_case('event_id % 6', [r[2] or '' for r in evidence.ROUTES])} END AS source FROM events""")
def authority_routing(spark, d):
    """Every third question finds its preferred source missing and takes the second."""
    e = table(spark, d, "events").select("event_id", _case(F.col("event_id") % 6, _TYPES).alias("question_type"))
    r = evidence.route(e, spark)
    return r.select("event_id", "question_type", F.when(F.col("event_id") % 3 != 0, F.col("preferred")).otherwise(F.coalesce("fallback", "preferred")).alias("source"))


# ---------------------------------------------------------------- mining, chat, metrics

def _baskets(spark, d):
    li, part = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_type")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("items"))


_ITEMSETS = """t AS (SELECT DISTINCT l_orderkey AS o, p_type AS x FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT o) AS n FROM t),
sets AS (SELECT [x] AS items, count(*) AS freq FROM t GROUP BY 1
 UNION ALL SELECT [a.x, b.x], count(*) FROM t a JOIN t b ON a.o = b.o AND a.x < b.x GROUP BY 1
 UNION ALL SELECT [a.x, b.x, c.x], count(*) FROM t a JOIN t b ON a.o = b.o AND a.x < b.x JOIN t c ON a.o = c.o AND b.x < c.x GROUP BY 1
 UNION ALL SELECT [a.x, b.x, c.x, e.x], count(*) FROM t a JOIN t b ON a.o = b.o AND a.x < b.x JOIN t c ON a.o = c.o AND b.x < c.x JOIN t e ON a.o = e.o AND c.x < e.x GROUP BY 1),
fi AS (SELECT items, freq, n FROM sets, n WHERE freq >= 0.1 * n)"""
_RULES = f"""{_ITEMSETS}, sp AS (SELECT f.items, f.freq, f.n, a.items AS ante, a.freq AS fa, c.items AS cons, c.freq AS fc FROM fi f JOIN fi a ON list_has_all(f.items, a.items) AND len(a.items) < len(f.items)
 JOIN fi c ON list_has_all(f.items, c.items) AND len(c.items) = len(f.items) - len(a.items) AND NOT list_has_any(a.items, c.items)),
ru AS (SELECT array_to_string(ante, ',') AS antecedents, array_to_string(cons, ',') AS consequents, round(freq / n, 4) AS support, round(freq / fa, 4) AS confidence, round((n * freq) / (fa * fc), 4) AS lift,
 array_to_string(list_sort(list_concat(ante, cons)), ',') AS k FROM sp WHERE n * freq * 100 >= fa * fc * 80)"""


def _joined(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("antecedents", "consequents")})


@query(f"WITH {_ITEMSETS} SELECT array_to_string(items, ',') AS items, freq, n FROM fi")
def frequent_itemsets(spark, d):
    return mining.frequent_itemsets(_baskets(spark, d), 0.1).withColumn("items", F.array_join("items", ","))


@query(f"WITH {_RULES} SELECT antecedents, consequents, support, confidence, lift FROM ru")
def association_rules(spark, d):
    return _joined(mining.association_rules(mining.frequent_itemsets(_baskets(spark, d), 0.1), 0.8))


_TABLE = [(["ECONOMY", "SMALL"], "REACTIVE"), (["LARGE", "STANDARD"], "TOXIC GAS")]


@query(f"WITH {_RULES} SELECT antecedents, consequents, lift, CASE k WHEN 'ECONOMY,SMALL' THEN 'REACTIVE' WHEN 'LARGE,STANDARD' THEN 'TOXIC GAS' ELSE '{mining.COMPATIBLE}' END AS incompatibility_status FROM ru")
def rule_lookup(spark, d):
    rules = mining.association_rules(mining.frequent_itemsets(_baskets(spark, d), 0.1), 0.8)
    return _joined(mining.lookup(rules, _TABLE)).select("antecedents", "consequents", "lift", "incompatibility_status")


def _sql_answer(question: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({question}, '{p}') THEN '{a}' || trim(regexp_extract({question}, '{p}', 1)) || '{b}'" for p, (a, b) in chat.RULES) + " END"


@query(f"""WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'What is the Flash  point of ' || p_name || '?' WHEN 1 THEN 'Is ' || p_name || ' flammable?' WHEN 2 THEN 'max storage temp for ' || p_name ELSE 'Tell me about ' || p_name END AS question FROM part)
SELECT p_partkey, {_sql_answer('question')} AS answer FROM q""")
def chat_fast_path(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    q = (F.when(k == 0, F.concat(F.lit("What is the Flash  point of "), name, F.lit("?"))).when(k == 1, F.concat(F.lit("Is "), name, F.lit(" flammable?")))
         .when(k == 2, F.concat(F.lit("max storage temp for "), name)).otherwise(F.concat(F.lit("Tell me about "), name)))
    return table(spark, d, "part").select("p_partkey", chat.fast_answer(q).alias("answer"))


def _labelled(spark, d):
    lab = table(spark, d, "labels").filter("quality is not null")
    return lab.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") >= 900).cast("int").alias("predicted"))


_LAB = "lb AS (SELECT quality AS truth, CASE WHEN n_chars >= 900 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {_LAB}, c AS (SELECT k, count(*) FILTER (WHERE truth = k AND predicted = k) AS tp, count(*) FILTER (WHERE predicted = k) AS pp, count(*) FILTER (WHERE truth = k) AS ap FROM lb, (SELECT unnest([0, 1]) AS k) GROUP BY k),
e AS (SELECT CAST(k AS VARCHAR) AS class, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision, CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS recall, CASE WHEN pp + ap > 0 THEN (2 * tp) / (pp + ap) ELSE 0.0 END AS f1, ap AS support FROM c)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (SELECT * FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM e
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM e)""")
def classification_report(spark, d):
    r = metrics.classification_report(_labelled(spark, d), [0, 1])
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH {_VERDICT}, nv AS (SELECT state AS truth, CASE WHEN pvalue IS NULL THEN 'UNKNOWN' WHEN (pdirection = 'max' AND current_value >= pvalue) OR (pdirection = 'min' AND current_value <= pvalue) THEN 'WARNING' ELSE 'SAFE' END AS predicted FROM vd)
SELECT truth, count(*) FILTER (WHERE predicted = 'SAFE') AS pred_safe, count(*) FILTER (WHERE predicted = 'WARNING') AS pred_warning, count(*) FILTER (WHERE predicted = 'UNKNOWN') AS pred_unknown FROM nv GROUP BY 1""")
def confusion_matrix(spark, d):
    """Verdicts against those of a judge that takes the first top source and asks no more."""
    r, src = _readings(spark, d), _read_sources(spark, d)
    first = evidence.reconcile(src, tolerance=float("inf")).select("chemical", "metric_name", F.col("primary.value").alias("pv"), F.col("primary.direction").alias("pd"))
    j = verdict.evaluate(r, src).join(first, ["chemical", "metric_name"], "left")
    naive = F.when(F.col("pv").isNull(), "UNKNOWN").when(verdict.unsafe(F.col("current_value"), F.col("pv"), F.col("pd")), "WARNING").otherwise("SAFE")
    return metrics.confusion_matrix(j.select(F.col("state").alias("truth"), naive.alias("predicted")))


@query(f"""WITH {_SRC}, {_rec_sql()}, w AS (SELECT conflict AS p, n_top > 1 AND spread_percent > 20.0 AS t FROM rec2)
SELECT count(*) FILTER (WHERE t AND p) AS true_conflicts, count(*) FILTER (WHERE NOT t AND p) AS false_conflicts, count(*) FILTER (WHERE t AND NOT p) AS missed_conflicts FROM w""")
def conflict_counts(spark, d):
    r = evidence.reconcile(_noted(spark, d))
    return metrics.conflict_counts(r.select(F.col("conflict").alias("predicted"), ((F.col("n_top") > 1) & (F.col("spread_percent") > 20.0)).alias("truth")))


# ---------------------------------------------------------------- search

_TOK = "tok AS (SELECT doc_id, t AS term, i - 1 AS pos FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents)))"


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"WITH {_TOK} SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2")
def inverted_index(spark, d):
    return search.inverted_index(_documents(spark, d))


@query(f"WITH {_TOK} SELECT term, doc_id, CAST(pos AS INT) AS pos FROM tok")
def positional_index(spark, d):
    return search.positional_index(_documents(spark, d))


def _postings_sql(term: str) -> str:
    return f"SELECT doc_id FROM tok WHERE term = '{term}'"


@query(f"WITH {_TOK} {_postings_sql('the')} INTERSECT {_postings_sql('clown')}")
def boolean_and(spark, d):
    return search.boolean_and(search.inverted_index(_documents(spark, d)), ["the", "clown"])


@query(f"WITH {_TOK} {_postings_sql('idiot')} UNION {_postings_sql('clown')}")
def boolean_or(spark, d):
    return search.boolean_or(search.inverted_index(_documents(spark, d)), ["idiot", "clown"])


@query(f"WITH {_TOK} {_postings_sql('clown')} EXCEPT {_postings_sql('idiot')}")
def boolean_not(spark, d):
    return search.boolean_not(search.inverted_index(_documents(spark, d)), "clown", "idiot")


@query(f"WITH {_TOK} SELECT a.doc_id, count(*) AS occurrences FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def phrase_query(spark, d):
    return search.phrase_query(search.positional_index(_documents(spark, d)), "of the")


@query(f"""WITH {_TOK}, l AS (SELECT a.doc_id, a.pos AS start, b.pos AS stop FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'),
r AS (SELECT doc_id, pos AS start, pos AS stop FROM tok WHERE term = 'with')
SELECT l.doc_id, min(CASE WHEN l.start < r.start THEN r.start - l.stop ELSE l.start - r.stop END) AS distance FROM l JOIN r ON l.doc_id = r.doc_id
WHERE CASE WHEN l.start < r.start THEN r.start - l.stop ELSE l.start - r.stop END BETWEEN 1 AND 10 GROUP BY 1""")
def proximity_query(spark, d):
    left, within, right = search.parse_proximity("of the /10 with")
    p = search.proximity_query(search.positional_index(_documents(spark, d)), left, right, within)
    return p.select("doc_id", F.col("distance").cast("long").alias("distance"))


@query(_SQL["phrase_query"])
def stored_phrase(spark, d):
    return StoredIndex.build(_documents(spark, d), temporary(spark, "stored")).phrase("of the")


@query(_SQL["proximity_query"])
def stored_proximity(spark, d):
    left, within, right = search.parse_proximity("of the /10 with")
    p = StoredIndex.build(_documents(spark, d), temporary(spark, "stored")).proximity(left, right, within)
    return p.select("doc_id", F.col("distance").cast("long").alias("distance"))


_TFIDF = f"""{_TOK}, ix AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM ix, nd GROUP BY term, n),
wt AS (SELECT term, doc_id, tf * idf AS w FROM ix JOIN idf USING (term)), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, count(*) AS dt FROM wt GROUP BY 1),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY 1, 2),
qw0 AS (SELECT item_id, term, idf, tf * idf AS qw FROM qt JOIN idf USING (term)), qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM qw0 GROUP BY 1)"""


def _ranked_sql(least_idf: str, least_jaccard: str, k: int) -> str:
    return f"""{_TFIDF}, qw AS (SELECT * FROM qw0 WHERE idf >= {least_idf}), kt AS (SELECT item_id, count(*) AS n FROM qw GROUP BY 1),
dt AS (SELECT item_id, doc_id, sum(qw * w) AS dot, count(*) AS sh FROM qw JOIN wt USING (term) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, round(dot / (norm * qnorm), 8) AS score FROM dt JOIN nm USING (doc_id) JOIN qn USING (item_id) JOIN kt USING (item_id) WHERE sh / (n + nm.dt - sh) >= {least_jaccard}),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


@query(f"WITH {_ranked_sql('0', '0', 5)} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM rk")
def tfidf_cosine(spark, d):
    return search.tfidf_search(_documents(spark, d), table(spark, d, "benchmark"), k=5)


@query(f"WITH {_ranked_sql('4.0', '0.01', 5)} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM rk")
def index_elimination(spark, d):
    return search.tfidf_search(_documents(spark, d), table(spark, d, "benchmark"), k=5, least_idf=4.0, least_jaccard=0.01)


@query(f"WITH {_ranked_sql('0', '0', 5)} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM rk")
def block_bound_search(spark, d):
    return ranked.tfidf_search(_documents(spark, d), table(spark, d, "benchmark"), k=5)


@query(f"WITH {_ranked_sql('4.0', '0.01', 5)} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM rk")
def block_bound_elimination(spark, d):
    return ranked.tfidf_search(_documents(spark, d), table(spark, d, "benchmark"), k=5, least_idf=4.0, least_jaccard=0.01)


def _retrieved(spark, d):
    docs, items = _documents(spark, d), table(spark, d, "benchmark").select("item_id", "text")
    ranked = search.tfidf_search(docs, items, k=10)
    # relevant to an item are all documents with its first three words in a row
    head = items.select("item_id", F.array_join(F.slice(tokens(F.col("text")), 1, 3), " ").alias("s"))
    relevant = docs.select("doc_id", F.explode(shingles(tokens(F.col("text")), 3)).alias("s")).join(head, "s").select("item_id", "doc_id")
    m = metrics.ranked_metrics(ranked, relevant)
    return items.join(m, "item_id", "left").select("item_id", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("precision_at", "recall_at", "average_precision")])


_RANKED = f"""{_ranked_sql('0', '0', 10)}, it AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM benchmark),
rl AS (SELECT DISTINCT it.item_id, a.doc_id FROM it JOIN tok a ON a.term = w[1] JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = w[2] JOIN tok c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 AND c.term = w[3]),
nr AS (SELECT item_id, count(*) AS n FROM rl GROUP BY 1),
ht AS (SELECT rk.*, CASE WHEN rl.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM rk LEFT JOIN rl ON rl.item_id = rk.item_id AND rl.doc_id = rk.doc_id),
sn AS (SELECT *, sum(hit) OVER (PARTITION BY item_id ORDER BY rank) AS seen FROM ht),
mt AS (SELECT item_id, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5.0 AS precision_at, coalesce(sum(hit) / any_value(n), 0) AS recall_at,
 coalesce(sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) / any_value(n), 0) AS average_precision FROM sn LEFT JOIN nr USING (item_id) GROUP BY 1)"""


@query(f"WITH {_RANKED} SELECT item_id, coalesce(round(precision_at, 9), 0)::DOUBLE AS precision_at FROM benchmark LEFT JOIN mt USING (item_id)")
def precision_at_5(spark, d):
    return _retrieved(spark, d).select("item_id", "precision_at")


@query(f"WITH {_RANKED} SELECT item_id, coalesce(round(recall_at, 9), 0)::DOUBLE AS recall_at FROM benchmark LEFT JOIN mt USING (item_id)")
def recall_at_10(spark, d):
    return _retrieved(spark, d).select("item_id", "recall_at")


@query(f"WITH {_RANKED} SELECT round(avg(coalesce(average_precision, 0)), 7) AS mean_avg_precision, count(*) AS n_items FROM benchmark LEFT JOIN mt USING (item_id)")
def mean_avg_precision(spark, d):
    return _retrieved(spark, d).agg(F.round(F.avg("average_precision"), 7).alias("mean_avg_precision"), F.count("*").alias("n_items"))


@query(f"""WITH {_TOK}, ln AS (SELECT doc_id, max(pos) AS last FROM tok GROUP BY 1),
sh AS (SELECT DISTINCT a.doc_id, a.term || ' ' || b.term || ' ' || c.term AS s FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
 UNION SELECT doc_id, string_agg(term, ' ' ORDER BY pos) FROM tok JOIN ln USING (doc_id) WHERE last < 2 GROUP BY 1),
pr AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS prev_id FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), bo AS (SELECT pr.doc_id, count(*) AS b FROM pr JOIN sh x ON x.doc_id = pr.doc_id JOIN sh y ON y.doc_id = pr.prev_id AND x.s = y.s GROUP BY 1)
SELECT pr.doc_id AS right_id, pr.prev_id AS left_id, coalesce(l.n, 0) - coalesce(b, 0) AS n_only_left, coalesce(r.n, 0) - coalesce(b, 0) AS n_only_right FROM pr LEFT JOIN n r ON r.doc_id = pr.doc_id LEFT JOIN n l ON l.doc_id = pr.prev_id LEFT JOIN bo ON bo.doc_id = pr.doc_id WHERE prev_id IS NOT NULL""")
def shingle_difference(spark, d):
    """Each document against the one before it in its language."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    ids = search.previous_of(docs.select("doc_id", "lang"), "lang", "doc_id").select(F.col("doc_id").alias("right_id"), F.col("previous").alias("left_id"))
    sets = docs.select("doc_id", shingle_hashes(tokens(F.col("text")), 3).alias("s"))
    left, right = sets.select(F.col("doc_id").alias("left_id"), F.col("s").alias("a")), sets.select(F.col("doc_id").alias("right_id"), F.col("s").alias("b"))
    both = ids.join(left, "left_id").join(right, "right_id")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("right_id", "left_id", (F.size("a") - shared).cast("long").alias("n_only_left"), (F.size("b") - shared).cast("long").alias("n_only_right"))


# ---------------------------------------------------------------- extraction, frontier, telemetry

@query(r"""SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,10}')) AS value FROM documents
UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b')) FROM documents""")
def identifier_extraction(spark, d):
    return tables.identifiers(_documents(spark, d), ["email", "phone"])


def _stem_sql(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{x}') AND length({t}) >= {len(x) + 3} THEN left({t}, length({t}) - {len(x)})" for x in SUFFIXES)
    words = ", ".join(f"'{w}'" for w in PROTECTED)
    return f"CASE WHEN {t} IN ({words}) OR regexp_matches({t}, '^[0-9]|-[0-9]') THEN {t} {cases} ELSE {t} END"


@query(f"""SELECT {_stem_sql('t')} AS stem, count(*) AS n, count(DISTINCT t) AS n_forms FROM (SELECT lower(unnest(regexp_extract_all(body, '{DOMAIN_TOKEN}'))) AS t FROM
(SELECT text AS body FROM documents UNION ALL SELECT 'sodium chlorate and chlorides of ' || lower(p_name) || ', ' || p_type || 'ings' FROM part)) WHERE t NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY 1""")
def selective_stems(spark, d):
    """Stems of the documents and of a line for each part; protected words such as chlorate stay apart."""
    line = F.concat(F.lit("sodium chlorate and chlorides of "), F.lower("p_name"), F.lit(", "), "p_type", F.lit("ings"))
    body = table(spark, d, "documents").select(F.col("text").alias("body")).union(table(spark, d, "part").select(line))
    word = body.select(F.explode(domain_tokens(F.col("body"))).alias("t")).filter(~F.col("t").isin(STOP_WORDS))
    return word.groupBy(stem(F.col("t")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("n_forms"))


@query("SELECT doc_id, CAST(i - 1 AS INT) AS section, CAST(length(l) AS INT) AS n_chars FROM (SELECT doc_id, unnest(s) AS l, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def section_split(spark, d):
    return tables.line_sections(_documents(spark, d))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
u AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '/') THEN base || href END, '#.*$', '') AS url FROM l),
n AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, url FROM u WHERE url IS NOT NULL AND url <> '')
SELECT head || regexp_replace(substr(url, length(head) + 1), '/+$', '') AS url, count(*) AS n_links, min(page_id) AS first_page FROM n WHERE regexp_matches(head, 'example\.(org|net)$') GROUP BY 1""")
def link_frontier(spark, d):
    return tables.link_frontier(table(spark, d, "pages"), r"example\.(org|net)$")


#: Made-up robots rules (host, allow, path) and delays of the pages' hosts.
_ROBOTS = [("*", False, "/en/1"), ("*", True, "/en/1*9"), ("example.net", False, "/"), ("example.net", True, "/*/2"), ("example.net", False, "/de/2$"), ("example.net", True, "/fr")]
_DELAYS = [("example.net", 2.5)]


@query(f"""WITH f AS ({_SQL["link_frontier"]}), h AS (SELECT url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS p0 FROM f),
p AS (SELECT url, host, CASE WHEN starts_with(p0, '/') THEN p0 ELSE '/' || p0 END AS path FROM h),
a AS (SELECT url, host, CASE WHEN host = 'example.net' THEN CASE WHEN path = '/de/2' THEN false WHEN regexp_matches(path, '^/.*/2') THEN true WHEN starts_with(path, '/fr') THEN true ELSE false END
 ELSE CASE WHEN regexp_matches(path, '^/en/1.*9') THEN true WHEN starts_with(path, '/en/1') THEN false ELSE true END END AS allowed FROM p)
SELECT url, host, CAST(row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS BIGINT) AS turn, (row_number() OVER (PARTITION BY host ORDER BY url) - 1) * CASE WHEN host = 'example.net' THEN 2.5::DOUBLE ELSE 1.0 END AS at_seconds FROM a WHERE allowed""")
def crawl_schedule(spark, d):
    """Links that the rules allow, each host's one after the other."""
    rules = spark.createDataFrame(_ROBOTS, "host string, allow boolean, path string")
    delays = spark.createDataFrame(_DELAYS, "host string, seconds double")
    open_urls = crawl.allowed(link_frontier(spark, d).select("url"), rules).filter("allowed")
    return crawl.schedule(open_urls, delays)


@query("""SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN value IS NULL OR isnan(value) THEN 'no_value' WHEN value < 0.5 OR value > 80 THEN 'out_of_range' WHEN json_extract(props, '$.k') IS NULL THEN 'bad_props' ELSE 'ok' END AS reason FROM events""")
def telemetry_validation(spark, d):
    return monitor.validation(table(spark, d, "events"), 0.5, 80.0)


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, d):
    return monitor.rate_limited(table(spark, d, "events"), 1)


@query("""SELECT user_id, event_id AS last_event, event_type AS last_type, value AS last_value, n_events, value > 50.0 AS excursion FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) WHERE rn = 1""")
def zone_state(spark, d):
    return monitor.zone_state(table(spark, d, "events"), 50.0)


@query("""SELECT event_id, user_id, event_type, value, bound FROM events JOIN (VALUES ('click', 60.0::DOUBLE, 'max'), ('error', 30.0, 'max'), ('view', 1.0, 'min')) l(event_type, bound, direction) USING (event_type) WHERE CASE WHEN direction = 'max' THEN value >= bound ELSE value <= bound END""")
def excursions(spark, d):
    limits = spark.createDataFrame([("click", 60.0, "max"), ("error", 30.0, "max"), ("view", 1.0, "min")], "event_type string, bound double, direction string")
    return monitor.excursions(table(spark, d, "events"), F.broadcast(limits))  # three fixed rows


@query(f"WITH {_ALERTS} SELECT zone_id, 'PENDING_SIGN_OFF' AS status, count(*) AS n_alerts FROM al2 GROUP BY 1")
def alert_compliance(spark, d):
    return monitor.compliance(_alerts(spark, d))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2")
def streaming_window_counts(spark, d):
    """A file stream run to its end; complete mode, so the last window is there too."""
    stream = monitor.window_counts(monitor.event_stream(spark, f"{d}/events.parque[t]"))
    return monitor.run_available(stream, shared_dir(spark))


def _event_log(spark, d):
    """A new log with all events, and where it lies."""
    path = temporary(spark, "topics")
    log = topics.topic_log(spark, path)
    topics.publish(log, monitor.as_messages(table(spark, d, "events")), 0)
    return log, path


def _clocked(spark, d):
    """Events off the topics, with a last message past all watermarks."""
    log, path = _event_log(spark, d)
    topics.publish(log, monitor.clock(spark, "2200-01-01 00:00:00"), 1)
    return monitor.as_events(topics.stream_topics(spark, path))


def _ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _streamed(stream, label):
    spark = stream.sparkSession
    out = CommittedTable(spark, temporary(spark, label), _ddl(stream))
    monitor.run_to_end(stream, out, temporary(spark, f"{label}-checkpoint"))
    return out.read()


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def streaming_rate_limit(spark, d):
    """Timers close each device's windows; the state is that of open windows alone."""
    return _streamed(stateful.rate_limited(_clocked(spark, d), 1), "rate-limit")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS silent_since FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM (SELECT DISTINCT user_id, ts FROM events))
WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 DAY""")
def silence_alarms(spark, d):
    """Devices without an event for over a day, by timers."""
    return _streamed(stateful.silent(_clocked(spark, d), gap_seconds=86_400), "silence")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2")
def topic_window_counts(spark, d):
    """Events of odd and of even ids come in two runs of one stream: the second goes on from offsets."""
    path = temporary(spark, "topics")
    log, events = topics.topic_log(spark, path), table(spark, d, "events")
    out = CommittedTable(spark, temporary(spark, "received"), topics.MESSAGE)
    checkpoint = temporary(spark, "received-checkpoint")
    for batch in (0, 1):
        topics.publish(log, monitor.as_messages(events.filter(F.col("event_id") % 2 == batch)), batch)
        monitor.run_to_end(topics.stream_topics(spark, path, "events/+"), out, checkpoint)
    return monitor.window_counts(monitor.as_events(out.read()))


@query(f"WITH {_ALERTS} SELECT alert_id, event_id, zone_id FROM al2")
def committed_alerts(spark, d):
    """Alerts of a batch that is tried twice: the second try adds nothing."""
    rows = written(_alerts(spark, d).select("alert_id", "event_id", "zone_id"), "alerts")
    audit = CommittedTable(spark, temporary(spark, "audit"), _ddl(rows))
    for _ in range(2):
        audit.append(rows, 0)
    return audit.read()


@query("""SELECT p_partkey, CAST(p_size % 5 AS INT) AS nfpa_health, CAST(p_partkey % 5 AS INT) AS nfpa_flammability, CAST(p_size % 4 AS INT) AS nfpa_instability, CAST(p_size % 9 AS INT) AS ghs_count,
CASE WHEN p_size % 5 <= 1 THEN 'LOW' WHEN p_size % 5 <= 2 THEN 'MEDIUM' WHEN p_size % 5 <= 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 1.0::DOUBLE AS confidence FROM part""")
def severity_predictions(spark, d):
    """Severity of every part from features made of its columns; SQL has the fitted tree as a CASE."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).cast("int").alias("nfpa_health"), (F.col("p_partkey") % 5).cast("int").alias("nfpa_flammability"), (F.col("p_size") % 4).cast("int").alias("nfpa_instability"), (F.col("p_size") % 9).cast("int").alias("ghs_count"))
    return severity.predict(severity.fit(severity.baseline(spark)), p)

# ---------------------------------------------------------------- data sheets, inventory, windows

_CAS = ["108-88-3", "67-64-1", "108-88-4"]  # the last one's check digit is wrong


def _sheets(spark, d):
    """A short data sheet for each part, of numbered sections."""
    p = table(spark, d, "part")
    code = F.concat(F.lit("H"), (200 + F.col("p_size") % 100).cast("string"))
    text = F.concat(F.lit("Section 1: Identification\n"), F.col("p_name"), F.lit(" CAS "), _case(F.col("p_partkey") % 3, _CAS),
                    F.lit("\nSECTION 2: Hazards\n"), code, F.lit(" and P210\n  section 8: Limits\n"), (F.col("p_size") % 90 + 1).cast("string"), F.lit(" ppm\n"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"), code.alias("code"), _case(F.col("p_partkey") % 3, _CAS).alias("cas"))


@query(f"""SELECT p_partkey AS doc_id, 1 AS section, 'Identification' || chr(10) || p_name || ' CAS ' || {_sql_case('p_partkey % 3', _CAS)} AS body FROM part
UNION ALL SELECT p_partkey, 2, 'Hazards' || chr(10) || 'H' || (200 + p_size % 100) || ' and P210' FROM part UNION ALL SELECT p_partkey, 8, 'Limits' || chr(10) || (p_size % 90 + 1) || ' ppm' FROM part""")
def sheet_sections(spark, d):
    return tables.sections(_sheets(spark, d))


@query(f"""SELECT p_partkey AS doc_id, 'cas' AS kind, {_sql_case('p_partkey % 3', _CAS)} AS value FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey, 'hazard', 'H' || (200 + p_size % 100) FROM part
UNION ALL SELECT p_partkey, 'hazard', 'P210' FROM part UNION ALL SELECT p_partkey, 'limit', (p_size % 90 + 1) || ' ppm' FROM part""")
def sheet_identifiers(spark, d):
    return tables.identifiers(_sheets(spark, d), ["cas", "hazard", "limit"])


@query("""SELECT 'cas' AS kind, 1.0::DOUBLE AS precision, round(count(*) FILTER (WHERE p_partkey % 3 < 2) / count(*), 9) AS recall, round(2 * count(*) FILTER (WHERE p_partkey % 3 < 2) / (count(*) + count(*) FILTER (WHERE p_partkey % 3 < 2)), 9) AS f1 FROM part
UNION ALL SELECT 'hazard', 0.5, 1.0, round(2 * count(*) / (2 * count(*) + count(*)), 9) FROM part""")
def extraction_metrics(spark, d):
    """CAS numbers with a wrong check digit are expected and not found; P210 is found and not expected."""
    sheets = _sheets(spark, d)
    found = tables.identifiers(sheets, ["cas", "hazard"]).groupBy("doc_id", "kind").agg(F.collect_set("value").alias("predicted"))
    want = sheets.select("doc_id", F.explode(F.create_map(F.lit("cas"), F.array("cas"), F.lit("hazard"), F.array("code"))).alias("kind", "expected"))
    rows = want.join(found, ["doc_id", "kind"], "left").select("kind", F.coalesce("predicted", F.array().cast("array<string>")).alias("predicted"), "expected")
    return metrics.extraction_scores(rows).select("kind", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_SRC}, lim AS (SELECT chemical, metric_name, min(CASE WHEN direction = 'max' THEN value END) AS control_ceiling, max(CASE WHEN direction = 'min' THEN value END) AS control_floor FROM src GROUP BY 1, 2),
inv AS (SELECT DISTINCT 'Z' || user_id AS zone_id, 'part-' || (user_id % 40 + 1) AS chemical FROM events)
SELECT event_id, zone_id, chemical, metric_name, current_value, control_ceiling, control_floor FROM (SELECT event_id, 'Z' || user_id AS zone_id, event_type AS metric_name, value AS current_value FROM events) JOIN inv USING (zone_id) JOIN lim USING (chemical, metric_name)
WHERE coalesce(current_value >= control_ceiling, false) OR coalesce(current_value <= control_floor, false)""")
def zone_excursions(spark, d):
    """Readings against the limits of what each zone stores."""
    stored = table(spark, d, "events").select(F.concat(F.lit("Z"), F.col("user_id").cast("string")).alias("zone_id"), F.concat(F.lit("part-"), (F.col("user_id") % 40 + 1).cast("string")).alias("chemical"))
    limits = evidence.conservative(_sources(spark, d)).drop("n_sources")
    return monitor.zone_excursions(_readings(spark, d), stored, limits)


@query(f"WITH {_ALERTS} SELECT al2.zone_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_alert FROM al2 JOIN events USING (event_id) GROUP BY 1")
def last_alerts(spark, d):
    a = monitor.last_alerts(_alerts(spark, d), table(spark, d, "events"))
    return a.select("zone_id", F.date_format("last_alert", "yyyy-MM-dd HH:mm:ss").alias("last_alert"))


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM
(SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) GROUP BY 1, 2""")
def sliding_window_counts(spark, d):
    return monitor.window_counts(table(spark, d, "events"), "1 hour", slide="30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    return monitor.session_counts(table(spark, d, "events"), "6 hours")


@query(_SQL["zone_state"])
def streaming_zone_state(spark, d):
    return monitor.run_available(monitor.zone_state(monitor.event_stream(spark, f"{d}/events.parque[t]"), 50.0), shared_dir(spark))


@query(_SQL["excursions"])
def streaming_excursions(spark, d):
    limits = spark.createDataFrame([("click", 60.0, "max"), ("error", 30.0, "max"), ("view", 1.0, "min")], "event_type string, bound double, direction string")
    found = monitor.excursions(monitor.event_stream(spark, f"{d}/events.parque[t]"), F.broadcast(limits))  # three fixed rows
    return monitor.run_available(found, shared_dir(spark), "append").select("event_id", "user_id", "event_type", "value", "bound")

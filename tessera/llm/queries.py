"""Driver queries of the pipeline operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import codes, decontam, fim, langid, packing, quality, setjoin, simhash, spm, substring, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark, sf_dir):
    """Documents of ``documents`` that hold items of ``benchmark``: one row a pair."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), piece_model())


def op4_url_filter(spark, sf_dir):
    found = url_filter.judge_urls(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark, sf_dir):
    return spm.piece_digests(_table(spark, sf_dir, "documents"), piece_model())


def op6_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), piece_model())


def op7_quality(spark, sf_dir):
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring(spark, sf_dir):
    return substring.repeat_digests(_table(spark, sf_dir, "documents"))


def op9_langid(spark, sf_dir):
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def op11_vector_codes(spark, sf_dir):
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark, sf_dir):
    return setjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return fim.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_decontamination, op2_toxicity, op3_token_counts, op4_url_filter, op5_sentencepiece,
           op6_packing, op7_quality, op8_substring, op9_langid, op10_simhash, op11_vector_codes, op12_jaccard_join, op13_fill_in_middle]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Words, windows and their least document; the words that windows of smaller ones cover go.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT win, min(doc_id) AS first FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN least USING (win) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


#: Units, cut places and forms; the text is rebuilt by cutting the output at its marks.
FIM_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
b AS (SELECT *, regexp_split_to_array(output, '<P>|<S>|<M>') AS part FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
 sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN part[2] || part[4] || part[3] ELSE part[3] || part[4] || part[2] END) AS restored_sha256
FROM b
"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Integer Lloyd rounds: nearest entries by a minimum over all, then floors of means."""
    def nearest(r: int) -> str:
        d = "list_inner_product(p, p) - 2 * list_inner_product(p, c) + list_inner_product(c, c)"
        return f"a{r} AS MATERIALIZED (SELECT vec_id, label, j, any_value(p) AS p, min(({d})::BIGINT * {entries} + e) AS m FROM part JOIN b{r} USING (j) GROUP BY 1, 2, 3)"

    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT j, e, list(x ORDER BY i) AS c FROM
 (SELECT j, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT j, m % {entries} AS e, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.j = b.j AND n.e = b.e)""")
    steps.append(nearest(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, j, v[j * (len(v) // {parts}) + 1:(j + 1) * (len(v) // {parts})] AS p FROM kept, (SELECT unnest(range({parts})) AS j)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT j, e, p AS c FROM part JOIN seed USING (vec_id)),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY j) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1, 2),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


def url_sql(rounds: int = 40) -> str:
    """Rules, host edges and both walks, one round after the other."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r.text), r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    host = lambda url: f"translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    walk = ["r0 AS MATERIALIZED (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS rank FROM (SELECT 't' AS kind, host, trusted AS w FROM seeds UNION ALL SELECT 'd', host, blocked FROM seeds) WHERE w > 0)"]
    for i in range(rounds):
        walk.append(f"""r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT r.kind, s.dst AS host, r.rank * s.share * 0.85::DOUBLE AS rank FROM r{i} r JOIN step s ON s.kind = r.kind AND s.src = r.host
 UNION ALL SELECT kind, host, rank * 0.15::DOUBLE FROM r0) GROUP BY 1, 2)""")
    return f"""
WITH pg AS MATERIALIZED (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN {host('url')} ELSE '' END AS host,
 CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
jd AS MATERIALIZED (SELECT page_id, host, path, {case([r.text for r in rules])} AS rule, {case([r.verdict for r in rules])} AS ruled FROM pg),
seeds AS MATERIALIZED (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END)::DOUBLE AS trusted, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS blocked FROM jd WHERE host <> '' GROUP BY 1),
urls AS (SELECT host AS src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS url FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS u FROM pg WHERE html IS NOT NULL AND host <> '')),
links AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT src, {host('url')} AS dst FROM urls) WHERE dst <> '' AND dst <> src GROUP BY 1, 2),
hosts AS (SELECT DISTINCT host FROM (SELECT host FROM pg UNION ALL SELECT dst FROM links) WHERE host <> ''),
parts AS (SELECT string_split(host, '.') AS p FROM hosts),
up AS (SELECT DISTINCT low, up FROM (SELECT array_to_string(p[i:], '.') AS low, array_to_string(p[i + 1:], '.') AS up FROM (SELECT p, unnest(range(1, len(p))) AS i FROM parts)) WHERE low <> '' AND up <> ''),
edge AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT low, up, 1.0 FROM up UNION ALL SELECT up, low, 1.0 FROM up) GROUP BY 1, 2),
ways AS (SELECT 't' AS kind, src, dst, weight FROM edge UNION ALL SELECT 'd', dst, src, weight FROM edge),
step AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM ways),
{", ".join(walk)},
hv AS (SELECT host, sum(CASE WHEN kind = 't' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'd' THEN rank ELSE 0 END) AS distrust FROM r{rounds} GROUP BY 1)
SELECT page_id, jd.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM jd LEFT JOIN hv ON hv.host = jd.host
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins of the queries that SQL can express on whole tables.

    The others use tokenizers, fitted models, hash functions or components that DuckDB
    lacks; the tests hold them against brute force, libraries and held-out labels.
    """
    return {"op4_url_filter": url_sql(), "op8_substring": SUBSTRING_SQL, "op11_vector_codes": codes_sql(), "op13_fill_in_middle": FIM_SQL}

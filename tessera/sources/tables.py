"""Sources and sinks: typed readers, small fixed tables, extraction, frontier, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import PATTERNS, SECTION_HEADING, cas_valid

QUERY_SET = "query_id string, query_text string, category string, expected_chemicals string, notes string"
READING = "zone_id string, temperature_celsius double, humidity_percent double, timestamp timestamp, device_id string, gas_ppm double, container_id string"
#: Accepted ranges of a reading.
RANGES = {"temperature_celsius": (-40.0, 80.0), "humidity_percent": (0.0, 100.0)}

# The vocabulary, in order.
VOCABULARY = [
    "toluene", "acetone", "methanol", "ethanol", "isopropyl alcohol", "sodium hypochlorite",
    "hydrochloric acid", "sulfuric acid", "nitric acid", "sodium hydroxide", "ammonia",
    "formaldehyde", "hydrogen peroxide", "xylene", "ethyl acetate", "potassium permanganate",
    "sodium chlorate", "ferric chloride",
]
THRESHOLD = ("chemical string, ord int, metric_name string, value double, unit string, direction string, sds_id string, "
             "supplier_name string, section_number string, authority_score double, citation string, hazard_statements array<string>")
# Placeholder thresholds.
THRESHOLDS = [
    ("toluene", 0, "max_storage_temperature", 25.0, "C", "max", "SDS_TOL_001", "ABC Chemicals", "Section 7", 1.0, "ABC Chemicals SDS Rev 2026-02 §7, p.5", None),
    ("toluene", 1, "flash_point", 4.4, "C", "min", "SDS_TOL_001", "ABC Chemicals", "Section 9", 1.0, "ABC Chemicals SDS Rev 2026-02 §9, p.7", None),
    ("ethanol", 0, "max_storage_temperature", 30.0, "C", "max", "SDS_ETH_002", "Sigma Aldrich", "Section 7", 1.0, "Sigma Aldrich SDS Rev 2025-10 §7", None),
    ("acetone", 0, "max_storage_temperature", 20.0, "C", "max", "SDS_ACE_003", "Merck", "Section 7", 1.0, "Merck SDS Rev 2026-01 §7", None),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_query_set(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """Benchmark queries from a CSV file with a header, of the given categories."""
    rows = spark.read.schema(QUERY_SET).option("header", True).csv(path)
    return rows.filter(F.col("category").isin(categories)) if categories else rows


def vocabulary(spark: SparkSession, terms: list[str] = VOCABULARY) -> DataFrame:
    return spark.createDataFrame(list(enumerate(terms)), "ord int, term string")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, THRESHOLD)


def catalog_columns(spark: SparkSession) -> dict[str, list[str]]:
    """Columns of every table and view of the current database."""
    return {t.name: [c.name for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables()}


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a table of alerts or audit records."""
    df.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_jdbc_parts(spark: SparkSession, url: str, name: str, column: str, *, parts: int = 8, where: str | None = None, **options) -> DataFrame:
    """A table read in ``parts`` ranges of a whole-number column, each a query of its own.

    The database itself finds the least and the greatest value; rows without one come with
    the first range.  ``where`` is part of every query.  Names are taken as they are written.
    """
    source = f"(SELECT * FROM {name} WHERE {where})" if where else name
    bounds = f'(SELECT MIN("{column}") AS lo, MAX("{column}") AS hi FROM {source} span) part_bounds'
    row = read_jdbc(spark, url, bounds, **options).toDF("lo", "hi").first()
    if row["lo"] is None:
        return read_jdbc(spark, url, f"{source} part_rows", **options)
    return read_jdbc(spark, url, f"{source} part_rows", partitionColumn=column, lowerBound=str(row["lo"]), upperBound=str(row["hi"] + 1), numPartitions=str(parts), **options)


def write_report(metrics: DataFrame, path: str, title: str = "Entity resolution") -> str:
    """Markdown table of the per-category metrics, one row a category."""
    rows = metrics.orderBy("category").toLocalIterator()
    lines = [f"# {title}", "", "| Category | Queries | Pass rate | Precision | Recall | F1 |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['category']} | {r['n_queries']} | {r['pass_rate']:.0%} | {r['precision']:.2f} | {r['recall']:.2f} | {r['f1']:.2f} |" for r in rows]
    text = "\n".join(lines) + "\n"
    with open(path, "w") as f:
        f.write(text)
    return text


def validated(readings: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> tuple[DataFrame, DataFrame]:
    """Readings within all ranges, and the others (null and NaN among them) to set aside."""
    ok = F.lit(True)
    for c, (lo, hi) in ranges.items():
        ok = ok & F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    return readings.filter(ok), readings.filter(~ok)


def identifiers(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, kind, value) of every identifier found; CAS numbers pass their check digit."""
    def of_kind(k: str):
        return F.transform(F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))

    parts = [of_kind(k) for k in kinds]
    found = docs.select("doc_id", F.explode(F.concat(*parts)).alias("x")).select("doc_id", "x.kind", "x.value")
    return found.filter((F.col("kind") != "cas") | cas_valid(F.col("value")))


def sections(docs: DataFrame, heading: str = SECTION_HEADING) -> DataFrame:
    """(doc_id, section, body) of the numbered sections of each text.

    Headings get a mark in front, then the text is cut at the marks.
    """
    mark = "\u0001"
    marked = F.regexp_replace("text", f"({heading})", mark + "$0")
    part = docs.select("doc_id", F.explode(F.split(marked, mark)).alias("part"))
    number = F.regexp_extract("part", heading, 1)
    return part.withColumn("n", number).filter("n <> ''").select("doc_id", F.col("n").cast("int").alias("section"), F.regexp_replace(F.regexp_replace("part", heading, ""), r"^\s+|\s+$", "").alias("body"))


def line_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, n_chars) of each line of a text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line")).select("doc_id", "section", F.length("line").alias("n_chars"))


def normal_url(url: Column) -> Column:
    """Without fragment, with scheme and host in lower case and no slash at the end."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), "/+$", "")
    return F.concat(head, rest)


def link_frontier(pages: DataFrame, allow: str = ".") -> DataFrame:
    """(url, n_links, first_page): distinct link targets whose host matches ``allow``.

    Relative links take the page's scheme and host.
    """
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    links = pages.select("page_id", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    whole = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href"))
    found = links.select("page_id", normal_url(whole).alias("url")).filter("url is not null and url <> ''")
    host = F.regexp_extract("url", "://([^/?]*)", 1)
    return found.filter(host.rlike(allow)).groupBy("url").agg(F.count("*").alias("n_links"), F.min("page_id").alias("first_page"))

"""Which urls of a frontier may be fetched, and when: robots rules and turns for each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.numbering import numbered

#: The host of rules that hold where a host has none of its own.
ANY = "*"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query; ``/`` without either."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def rule_regex(pattern: Column) -> Column:
    """Regex of a rule's path: ``*`` is any text, ``$`` at the end is the end."""
    quoted = F.regexp_replace(pattern, r"([\\.+?()\[\]{}^|])", r"\\$1")
    anchored = F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("(?s)^"), anchored)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url, and others) with host and ``allowed``.

    ``rules`` has host, allow (boolean) and path.  A host with rules of its own leaves those
    of ``*`` aside.  The longest path that fits decides, and allows on a tie; without one the
    url is allowed.  Rules meet urls by host, so a host's rules are held against its own urls.
    """
    base = urls.withColumn("host", host_of(F.col("url"))).withColumn("_path", path_of(F.col("url")))
    ruled = rules.filter(F.col("path") != "").select(F.lower("host").alias("_rules"), "allow", F.length("path").alias("_size"), rule_regex(F.col("path")).alias("_regex"))
    own = ruled.select("_rules").distinct().withColumn("_own", F.lit(True))
    keyed = base.join(own, base["host"] == own["_rules"], "left").drop("_rules").withColumn("_key", F.when(F.col("_own"), F.col("host")).otherwise(ANY)).drop("_own")
    # a row a host: as many rules as its file has
    packed = ruled.groupBy("_rules").agg(F.collect_list(F.struct("_size", "allow", "_regex")).alias("_all"))
    met = keyed.join(packed, keyed["_key"] == packed["_rules"], "left")
    fits = F.filter(F.coalesce("_all", F.array().cast("array<struct<_size:int,allow:boolean,_regex:string>>")), lambda r: F.regexp_like(F.col("_path"), r["_regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["_size"], r["allow"])))
    return met.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).select(*urls.columns, "host", "allowed")


def schedule(urls: DataFrame, delays: DataFrame, *, default: float = 1.0) -> DataFrame:
    """(url, host, turn, at_seconds) of ``urls`` (url, host): one at a time of each host.

    Turns follow the urls' order.  They are numbers among all urls less the host's first
    number, so a host with a third of all urls is still spread over many tasks.  ``delays``
    has host and seconds between two fetches.
    """
    numbers = numbered(urls.select("host", "url"), ["host", "url"], "_no")
    first = numbers.groupBy("host").agg(F.min("_no").alias("_first"))
    turns = numbers.join(first, "host").withColumn("turn", F.col("_no") - F.col("_first"))
    own = delays.select(F.lower("host").alias("host"), "seconds")
    return turns.join(own, "host", "left").select("url", "host", "turn", (F.col("turn") * F.coalesce("seconds", F.lit(default))).alias("at_seconds"))

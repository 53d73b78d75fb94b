"""Operator 4: lines that many pages of one site share go. Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import fresh, named, table, written

#: A drop table up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def boilerplate_lines(pages: DataFrame, *, text: str, host: str, ratio: float = 0.1, min_holding: int = 2) -> DataFrame:
    """(host, digests): for each host the MD5 digests of lines that more than `ratio` of its pages contain, and min_holding pages at least.

    A line is compared trimmed and counts once a page. The second condition keeps the lines of a site's only page, all of
    whose lines stand on all of its pages; it holds at hosts of every size. A host has at most (mean lines a page) /
    ratio such lines, so the arrays stay short. A null host counts as the empty one.
    """
    at = F.coalesce(named(host), F.lit("")).alias("host")
    totals = pages.groupBy(at).agg(F.count("*").alias("pages"))
    digests = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _digest))
    holding = pages.select(at, F.explode(digests).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("holding"))
    many = holding.filter(F.col("holding") >= min_holding)
    return (
        many.join(totals, "host")
        .filter(F.col("holding") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("digest")).alias("digests"))
    )


def drop_site_lines(
    pages: DataFrame, *, text: str = "text", host: str = "host", ratio: float = 0.1, min_holding: int = 2, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """pages with `text` rid of its host's boilerplate lines, and new columns n_lines and n_dropped.

    Blank lines stay. A null text stays null with no lines. Other columns pass through; a column that is named n_lines
    or n_dropped already is replaced. Repeated rows count as pages of their own. Texts are taken whole at any length. An
    empty table gives an empty table.
    """
    drop = written(boilerplate_lines(pages, text=text, host=host, ratio=ratio, min_holding=min_holding), "lines")
    size = drop.agg(F.sum(F.length("host") + 32 + 24 * F.size("digests"))).first()[0] or 0
    own = fresh(pages)
    at, site, gone, left = (own + x for x in ("at", "site", "gone", "left"))
    drop = drop.select(F.col("host").alias(site), F.col("digests").alias(gone))
    side = F.broadcast(drop) if size <= broadcast_bytes else drop.hint("merge")
    joined = pages.withColumn(at, F.coalesce(named(host), F.lit(""))).join(side, F.col(at) == F.col(site), "left")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(gone), _digest(x)))
    rest = joined.withColumn(left, F.when(F.col(gone).isNull(), lines).otherwise(kept)).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    rest = rest.withColumn("n_lines", F.when(named(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    rest = rest.withColumn("n_dropped", F.when(named(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size(left)))
    return rest.withColumn(text, F.array_join(left, "\n")).drop(at, site, gone, left)


def _lines(text: str):
    return F.split(named(text), "\n", -1)


def _digest(line):
    return F.unhex(F.md5(F.trim(line).cast("binary")))


#: What makes lines of a page: no scripts and styles, each other tag ends a line.
PLAIN = [("(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n"), ("(?s)<[^>]*>", "\n"), ("[\\n\\r\\t ]*\\n[\\n\\r\\t ]*", "\n")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    for pattern, to in PLAIN:
        html = F.regexp_replace(html, pattern, to)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), html.alias("text"))
    return drop_site_lines(pages).select("page_id", "host", F.col("text").alias("kept_text"), "n_lines", "n_dropped")


_SQL_HTML = "html"
for _p, _t in PLAIN:
    _SQL_HTML = f"regexp_replace({_SQL_HTML}, '{_p}', chr(10), 'g')"

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, host, coalesce(host, '') AS site, lines FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, string_split({_SQL_HTML}, chr(10)) AS lines FROM pages)),
t AS (SELECT site, count(*) AS pages FROM p GROUP BY site),
h AS (SELECT site, line, count(*) AS holding FROM (SELECT site, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM p)
      WHERE line <> '' GROUP BY site, line),
d AS (SELECT h.site, list(line) AS dropped FROM h JOIN t ON h.site = t.site WHERE holding >= 2 AND holding > 0.1 * pages GROUP BY h.site),
k AS (SELECT page_id, host, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(dropped, trim(x))) END AS kept
      FROM p LEFT JOIN d ON p.site = d.site)
SELECT page_id, host, array_to_string(kept, chr(10)) AS kept_text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM k
"""

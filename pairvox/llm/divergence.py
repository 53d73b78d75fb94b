"""Operator 13: how far the sources of a language diverge from each other and from it, with terms as digests until the end."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairvox.llm.common import arrow_runs, give_back, named, table, written

#: Bytes of text that are taken up at once; distinct terms that a task counts before it hands them on; entries of a cell; sources of a block; terms of a source in its report.
RUN_BYTES, FLUSH_TERMS, CELL_ENTRIES, BLOCK, TOP_TERMS = 4 << 20, 250_000, 200_000, 256, 200
#: Probabilities are whole numbers of billionths.
UNIT = 1_000_000_000

#: The bytes of terms, capitals as small letters; all others separate terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

ENTRIES = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) for some rows each: occurrences and documents. A null term stands for the group itself, with or without terms.

    Null texts, languages and sources count as empty. The counts of a group and term are to be added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in arrow_runs(batches, lambda b: pa.compute.binary_length(b.column(0)), RUN_BYTES):
            for text, *group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()
                if (found := groups.get(tuple(group))) is None:
                    found = groups[tuple(group)] = Counter(), Counter()
                n, docs = found
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held >= FLUSH_TERMS:
                    yield from _flush(groups)
                    groups, held = {}, 0
        yield from _flush(groups)
        groups.clear()
        give_back()

    rows = docs.select(*(F.coalesce(named(c), F.lit("")) for c in (text, lang, source)))
    return rows.mapInArrow(run, ENTRIES)


def _flush(groups: dict) -> Iterator[pa.RecordBatch]:
    """One batch a group; its null term first."""
    for (lang, source), (n, docs) in groups.items():
        size = len(n) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang]).take(pa.array(np.zeros(size, np.int32))),
                pa.array([source]).take(pa.array(np.zeros(size, np.int32))),
                pa.array([None, *n.keys()], pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def kept_terms(entries: DataFrame, digest: Column, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Terms that a language keeps, in least_docs of its documents or more, and texts by digest.

    The first is (lang, source, digest, split, n, lang_n, leads): occurrences there and in the language, `leads` in one
    row of each language and term. Only digests are shuffled for the counts: they are added up by language, source and
    digest, then over the sources of a language. Of digests that are left, the smallest and the largest term are looked
    up, (digest, low, collided); where the two differ, terms have collided, and these are counted again by the terms
    themselves, which `split` holds then (else it is empty).
    """
    terms = entries.filter("term IS NOT NULL").withColumn("digest", digest)
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]

    def kept(*term: str) -> DataFrame:
        counts = apart if "split" in term else terms
        over = Window.partitionBy("lang", *term)
        counts = counts.groupBy("lang", "source", *term).agg(*sums)
        counts = counts.withColumns({"lang_n": F.sum("n").over(over), "lang_docs": F.sum("docs").over(over), "leads": F.min("source").over(over) == F.col("source")})
        return counts.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "digest", F.col("split") if "split" in term else F.lit("").alias("split"), "n", "lang_n", "leads")

    whole = written(kept("digest"), "kept-digests")
    wanted = whole.select("digest").distinct()
    met = terms.select("digest", "term").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    met = written(met.select("digest", "low", (F.col("low") != F.col("high")).alias("collided")), "digest-terms")
    split = met.filter("collided").select("digest")
    if split.isEmpty():
        return whole, met
    apart = terms.join(split, "digest", "left_semi").withColumn("split", F.col("term"))
    return written(whole.join(split, "digest", "left_anti").select(whole.columns).union(kept("digest", "split")), "kept-terms"), met


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), in decimals where 64 bits would not hold the product."""
    narrow = F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + v)
    wide = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, narrow).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence_audit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", digest: Column | None = None, least_docs: int = 3, top: int = TOP_TERMS, cell: int = CELL_ENTRIES, block: int = BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part `pair`: each other source of the language and the divergence from it, summed over all kept terms. Part `term`:
    kept terms that are more frequent in the source than in its language, the first `top` by what they add. Values are
    whole numbers, equal ones stand in the order of their items' bytes.

    1. Tasks count terms as they read; what they found is written once, and shuffled as `digest` (64-bit by default).
    2. Terms of too few documents go; digests of several terms are split (`kept_terms`).
    3. Values of terms need a join with the sources' totals only. How often each value occurs gives the value of the
       last rank, and only terms up to it get their text back. No group is sorted in one task as a whole.
    4. Pairs of sources come from cells: a share of the terms and two blocks of sources, so a cell is bounded. Counts that a
       cell doesn't hold are 0; terms that none of its sources has are added at the end, as all of them add the same.

    Null texts, languages and sources count as empty; repeated rows are documents of their own; texts are read whole,
    however long. A source without terms has rows of part `pair` if the language has another source. An empty table gives none.
    Only these columns are read, so others can't clash. The language of all documents may be one: keys are terms within it.
    """
    entries = written(term_counts(docs, text=text, lang=lang, source=source), "term-counts")
    kept, met = kept_terms(entries, F.xxhash64("term") if digest is None else digest, least_docs)
    group = ["lang", "source"]
    groups = entries.filter("term IS NULL").select(*group).distinct()
    of_group = kept.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("entries"), F.count_if("leads").alias("v"))
    sizes = groups.join(of_group, group, "left")
    own = Window.partitionBy("lang")
    sizes = sizes.select(
        *group,
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(own), F.lit(0)).alias("lang_total"),
        F.coalesce(F.sum("v").over(own), F.lit(0)).alias("v"),
        F.coalesce(F.sum("entries").over(own), F.lit(0)).alias("entries"),
        (F.row_number().over(own.orderBy("source")) - 1).alias("place"),
        F.count("*").over(own).alias("sources"),
    )
    sizes = written(sizes, "source-sizes")
    return _pairs(kept, sizes, cell, block).union(_terms(kept, sizes, met, top))


def _terms(kept: DataFrame, sizes: DataFrame, met: DataFrame, top: int) -> DataFrame:
    group = ["lang", "source"]
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    scored = kept.join(sizes.select(*group, "total", "lang_total", "v"), group).select(*group, "digest", "split", p.alias("p"), q.alias("q"))
    scored = scored.filter("p > q").select(*group, "digest", "split", excess(F.col("p"), F.col("q")).alias("value"))
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    steps = scored.groupBy(*group, "value").agg(F.count("*").alias("k")).withColumn("step", F.row_number().over(falling)).filter(F.col("step") <= top)
    before = F.sum("k").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    last = steps.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).groupBy(*group).agg(F.min("value").alias("least"))
    found = scored.join(last, group).filter("value >= least").join(met.select("digest", "low"), "digest")
    found = found.select(*group, F.lit("term").alias("part"), F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")).alias("item"), "value")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def _pairs(kept: DataFrame, sizes: DataFrame, cell: int, block: int) -> DataFrame:
    blocks = F.floor((F.col("sources") - 1) / block)
    placed = sizes.select("lang", "source", "place", "total", "v", F.floor(F.col("place") / block).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("other"), F.expr(f"entries div {cell} + 1").alias("shares"))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    key = ["lang", "i", "j", "share"]
    sides = placed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select(*(F.col(c).alias(c) for c in (*key, "place", "total", "v")))
    counts = kept.join(placed.select("lang", "source", "place", "i", "j", "shares"), ["lang", "source"])
    counts = counts.withColumn("share", F.pmod(F.xxhash64("digest", "split"), F.col("shares"))).select(*key, "place", "digest", "split", "n")
    run = lambda left, right: _cell(left, right, block)
    sums = counts.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(run, "lang string, a int, b int, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    a = sizes.select("lang", "source", F.col("place").alias("a"), F.col("total").alias("total_a"), "v")
    b = sizes.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("total").alias("total_b"))
    pairs = a.join(b, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    nowhere = excess(share(F.lit(0).cast("long"), F.col("total_a"), F.col("v")), share(F.lit(0).cast("long"), F.col("total_b"), F.col("v")))
    value = F.coalesce("value", F.lit(0)) + F.when(F.col("v") > 0, (F.col("v") - F.coalesce("seen", F.lit(0))) * nowhere).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _cell(counts: pd.DataFrame, sides: pd.DataFrame, block: int) -> pd.DataFrame:
    """For pairs of sources of two blocks, what the terms of a cell add, and how many terms these are."""
    out = pd.DataFrame({"lang": pd.Series(dtype=object), "a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32), "value": np.zeros(0, np.int64), "seen": np.zeros(0, np.int64)})
    if len(counts):
        sides = sides.sort_values("place")
        places = sides["place"].to_numpy(np.int64)
        below = (sides["total"] + sides["v"]).to_numpy(np.int64)
        i, j = counts["i"].iloc[0], counts["j"].iloc[0]
        term, names = pd.factorize(counts["digest"])
        if (counts["split"] != "").any():
            term, names = pd.factorize(pd.MultiIndex.from_arrays([counts["digest"], counts["split"]]))
        column, n = np.searchsorted(places, counts["place"].to_numpy(np.int64)), counts["n"].to_numpy(np.int64)
        order = np.argsort(term, kind="stable")
        term, column, n = term[order], column[order], n[order]
        sums = np.zeros((len(places), len(places)), np.int64)
        step = max(1, (1 << 20) // len(places))
        for first in range(0, len(names), step):
            low, high = np.searchsorted(term, [first, first + step])
            held = np.zeros((len(places), min(step, len(names) - first)), np.int64)
            held[column[low:high], term[low:high] - first] = n[low:high]
            if held.max() >= 9_000_000_000:
                held = held.astype(object)  # whole numbers of any size
            p = (1 + UNIT * (held + 1) // below[:, None]).astype(np.int64)
            for k in range(len(places)):
                sums[k] += ((p[k] - p) ** 2 // p).sum(axis=1)
        of = places // block
        k, m = np.nonzero((of[:, None] != of) if i != j else ~np.eye(len(places), dtype=bool))
        out = pd.DataFrame({"lang": np.full(len(k), counts["lang"].iloc[0], object), "a": places[k].astype(np.int32), "b": places[m].astype(np.int32), "value": sums[k, m], "seen": np.full(len(k), len(names))})
    give_back()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


#: Terms as strings, every source against every kept term, whole numbers of any size.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY 1),
c AS (SELECT t.lang, source, t.term, count(*)::HUGEINT AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
g AS (SELECT lang, source FROM d GROUP BY 1, 2),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v) AS p, 1 + 1000000000 * (k.lang_n + 1) // (l.total + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""

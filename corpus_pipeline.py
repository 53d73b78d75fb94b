"""A cleaning pipeline over `documents`: quality, site lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from pairvox.llm.common import named, table, written


#: Columns that stages read. Others, whatever they are named, go through each stage under neutral names.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with neutral names for columns that no stage reads, so that an operator's own columns can't replace them."""
    return docs.toDF(*(c if c in READ else f"other {i}" for i, c in enumerate(docs.columns)))


def _back(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their names."""
    return changed.select(*(named(c) for c in _aside(docs).columns)).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Null and empty texts are scored like others, repeated rows alike; without labels all stay."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(_aside(docs), model)
    return _back(scored.filter(F.col("score") >= quality.REJECT_BELOW), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than a tenth of one source's documents, and three or more, share; sources of any size.

    A null text stays null, a null source is one of its own, repeated rows count as documents of their own.
    """
    return _sized(line_dedup.drop_site_lines(_aside(docs), text="text", host="source", min_holding=3), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near copies (five words, similarity 0.8); documents without words or id stay."""
    components = jaccard_join.jaccard_components(docs, width=5, percent=80)
    gone = components.filter("doc_id <> component_id").select("doc_id").distinct()
    return _back(_aside(docs).join(gone, "doc_id", "left_anti"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that stand in a smaller document already. A character goes with any of its bytes; a document that nothing is left of goes."""
    left = suffix_dedup.remove_repeats(_aside(docs))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    kept = left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return _sized(kept.withColumn("text", text), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids; a null or empty text is one id, repeated rows are documents of their own."""
    import public_tokenizers

    return packing.pack(docs, path=public_tokenizers.path("byte_bpe_50k.json"))


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return _back(changed, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier, the suffix arrays and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

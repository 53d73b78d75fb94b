"""Extra columns whose names an operator or a stage uses itself: they pass through, keep their values, and change no result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairvox.llm import bpe, divergence, itq_dedup, jaccard_join, line_dedup, packing, pieces, prefix_trie, quality, sharding, suffix_dedup, transport_stream

public_tokenizers = pytest.importorskip("public_tokenizers")

NAMES = ["_at", "_kept", "_host", "_drop", "_site", "__at", "_source", "_body", "_text", "_id", "_key", "_hash", "_bucket", "score", "kept", "n_bytes", "n_lines", "digest", "id", "key", "part", "term", "one", "_of", "_base", "a.b"]
D = "/root/testdata/sf0.001"
TOKENS = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def widened(df):
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def rows(df, columns):
    return sorted(df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).toDF(*(f"c{i}" for i in range(len(columns)))).collect(), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet").filter("doc_id < 60").cache()


OPERATORS = {
    "shards": lambda d: sharding.interleave_shards(d),
    "stream": lambda d: transport_stream.demux(transport_stream.mux(d.withColumn("payload", transport_stream.padded_payload()))).drop("payload", "text"),
    "repeats": lambda d: suffix_dedup.remove_repeats(d),
    "lines": lambda d: line_dedup.drop_site_lines(d, host="source"),
    "pack": lambda d: packing.pack(d, path=public_tokenizers.path("byte_bpe_50k.json")),
    "ids": lambda d: bpe.encode_ids(d, **TOKENS),
    "jaccard": lambda d: jaccard_join.jaccard_components(d),
    "quality": lambda d: quality.score_quality(d, None),
    "pieces": lambda d: pieces.encode_pieces(d, path=public_tokenizers.path("piece_bpe_32k.model")),
    "divergence": lambda d: divergence.divergence_audit(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(docs, name):
    plain, wide = OPERATORS[name](docs), OPERATORS[name](widened(docs))
    own = [c for c in plain.columns if c in wide.columns]
    assert own == plain.columns and rows(wide, own) == rows(plain, own)
    through = [n for n in NAMES if n in wide.columns and n not in plain.columns]
    if name in ("lines", "quality"):
        assert through == [n for n in NAMES if n not in plain.columns]
    for n in through:
        assert {r[0] for r in rows(wide, [n])} == {f"own {n}"}


def test_vectors_and_conversations(spark):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    assert rows(itq_dedup.near_vectors(widened(vectors)), ["vec_id", "n_links", "component_id"]) == rows(itq_dedup.near_vectors(vectors), ["vec_id", "n_links", "component_id"])
    talks = spark.read.parquet(f"{D}/conversations.parquet")
    plain, wide = (prefix_trie.prefix_trie(prefix_trie.spoken(t)) for t in (talks, widened(talks)))
    assert rows(wide, plain.columns) == rows(plain, plain.columns)


@pytest.mark.parametrize("stage", range(4))
def test_stage(spark, docs, stage):
    name, run = corpus_pipeline.STAGES[stage]
    plain, wide = run(spark, docs, D), run(spark, widened(docs), D)
    assert wide.columns == [*docs.columns, *NAMES] and plain.columns == docs.columns
    assert rows(wide, docs.columns) == rows(plain, docs.columns)
    assert {tuple(r) for r in rows(wide, NAMES)} == {tuple(f"own {n}" for n in NAMES)}

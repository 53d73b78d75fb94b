"""SentencePiece encoding and decoding against the library."""

import hashlib
import random
from array import array

import pytest

from pairvox.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(12)
PARTS = [*" ▁\n\tabéöß日本語😀\x00\x7f.,;-'　", "<s>", "</s>", "<unk>", "<0x0A>", "the", " and", "ing", " er", "  ", "12", "».", "...", "naïve", "é"]
TEXTS = [None, "", " ", "  a b ", "▁", "\n", "a" * 3000, "日本語" * 2000, " " * 999, "\U0010ffff"] + ["".join(RNG.choices(PARTS, k=RNG.randrange(1, 80))) for _ in range(1500)]
TEXTS += ["".join(RNG.choices(PARTS, k=60_000)), "x" * 200_000 + " y"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_texts_as_the_library(spark, library):
    rows = [(i, t, "a", "b", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "a", "b", 1), (7, TEXTS[7], "a", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, `key` int").repartition(3)
    read = pieces.decode_pieces(pieces.encode_pieces(docs, path=PATH), path=PATH)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in read.collect()), key=str)
    want = sorted(((r[0], ids := library.encode(r[1] or "", add_eos=True), library.decode(ids)) for r in rows), key=str)
    assert got == want


def test_no_end_and_odd_names(spark, library):
    docs = spark.createDataFrame([("k", "a b", 1)], "`a.b` string, `the text` string, ids int")
    row = pieces.encode_pieces(docs, path=PATH, end=False, key="a.b", text="the text").first()
    assert row["a.b"] == "k" and list(row["ids"]) == library.encode("a b")
    back = pieces.decode_pieces(spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>"), path=PATH).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(1, ""), (None, "")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode_pieces(pieces.encode_pieces(docs, path=PATH), path=PATH).count() == 0


def test_cache_generations_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 50)
    cache = pieces._Cache(pieces.PieceEncoder(library))
    texts = [t or "" for t in TEXTS[:300]]
    got = [array("i", x).tolist() for k in range(0, 300, 10) for x in cache.encode(texts[k : k + 10])]
    assert got == library.encode(texts)


def test_a_wrong_merge_is_an_error(library):
    encoder = pieces.PieceEncoder(library)
    encoder.rank = [-r for r in encoder.rank]
    with pytest.raises(ValueError, match="another way"):
        pieces._Cache(encoder).encode(["the interesting considerations of unhappiness, characteristically misunderstood"])


class WithoutWalls:
    """A model that drops repeated spaces, so segments can't be checked together."""

    def __init__(self, inner):
        self.inner = inner

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def normalize(self, text):
        return self.inner.normalize(" ".join(text.split(" ")).strip())

    def encode(self, text):
        return self.inner.encode(" ".join(text.split(" ")).strip())


def test_texts_are_checked_whole_where_segments_cannot(library):
    encoder = pieces.PieceEncoder(WithoutWalls(library))
    assert not encoder.walls
    assert array("i", pieces._Cache(encoder).encode([" a b "])[0]).tolist() == library.encode("a b")


def test_query(spark, library):
    out = {r.doc_id: r for r in pieces.query(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert out.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode(t or "", add_eos=True)
        assert out[k].n_tokens == len(ids) and out[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

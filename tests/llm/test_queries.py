"""The registered queries themselves on a small odd folder: nulls, empties, repeats, a long text; against plain Python, and against their DuckDB twins."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pairvox.llm import queries, transport_stream

public_tokenizers = pytest.importorskip("public_tokenizers")

RNG = random.Random(21)
WORDS = ["alpha", "béta", "GAMMA", "mit license", "MIT License", "don't", "x1", "日本", "Apache License", "rest", "\tand", "general public license"]


def texts():
    out = [None, "", " ", "one", "One two three", "é" * 70, "z" * 130] + [" ".join(RNG.choices(WORDS, k=RNG.randrange(2, 90))) for _ in range(60)]
    out += out[20:30] + [t + " changed end" for t in out[30:40]] + [f"lead {i} " + out[41] for i in range(5)]
    return [*out, " ".join(RNG.choices([*WORDS, *(f"w{i}" for i in range(5000))], k=20_000))]


TEXTS = texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(3 * i, t, RNG.choice(["en", "de", None]), RNG.choice(["a", "a", "b", None]), len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3 * i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(3)
    v = [rng.standard_normal(16) for _ in range(40)]
    vectors = [(i, [float(y) for y in x], i % 3) for i, x in enumerate(v)] + [(100 + i, [float(y) for y in v[i] * 2], i % 3) for i in range(6)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float(y) for y in v[1]], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    pages = [(i, f"https://site{i % 4}.org/p{i}", f"<p>menu</p><p>own {i}</p>{'<p>rare</p>' if i < 2 else ''}") for i in range(30)] + [(90, "no address", "x"), (91, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def none(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def rows_of(spark, folder, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


BYTES = {3 * i: (t or "").encode() for i, t in enumerate(TEXTS)}


def parse_stream(media):
    """Elementary bytes of the one private stream, read packet by packet from the standard's field layout."""
    pes, program_map, media_pid, points = [], None, None, []
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        head, = struct.unpack(">I", p[:4])
        assert head >> 24 == 0x47
        begins, pid, adaptation, has_payload = head >> 22 & 1, head >> 8 & 0x1FFF, head >> 5 & 1, head >> 4 & 1
        start, flags = 4, 0
        if adaptation:
            flags = p[5] if p[4] else 0
            start = 5 + p[4]
        body = p[start:] if has_payload else b""
        if pid == 0 and begins:
            section = body[1 + body[0] :]
            program_map = struct.unpack(">H", section[10:12])[0] & 0x1FFF
        elif pid == program_map and begins:
            section = body[1 + body[0] :]
            skip = struct.unpack(">H", section[10:12])[0] & 0xFFF
            media_pid = struct.unpack(">H", section[13 + skip : 15 + skip])[0] & 0x1FFF
        elif pid == media_pid:
            if begins:
                pes.append(b"")
                points.append(flags >> 6 & 1)
            pes[-1] += body
    out = []
    for x in pes:
        length, extra = struct.unpack(">H", x[4:6])[0], x[8]
        out.append(x[9 + extra : 6 + length])
    return b"".join(out), points


def test_transport_streams(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    media = {r.doc_id: bytes(r.media) for r in transport_stream.mux(docs.select("doc_id", transport_stream.padded_payload().alias("payload"))).collect()}
    got = rows_of(spark, folder, "op2_transport_stream")
    for i, b in BYTES.items():
        payload = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        read, points = parse_stream(media[i])
        assert read == payload and points == [int(k % 4 == 0) for k in range(len(points))] and len(points) == -(-len(payload) // 8192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())


def test_licence_base(spark, folder):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, r in rows_of(spark, folder, "op5_license_scan").items():
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in BYTES[i].decode())
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for k in range(len(w)) for p, label in phrases.items() if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_packing_law(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = queries.QUERIES["op6_minimum_slack_packing"](spark, folder).collect()
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for i, b in BYTES.items():
        ids = np.array([*library.encode(b.decode(), add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_window) <= -(-sum(r.length for r in pieces) // 1024) * 1.1 + 1


def test_bpe_digests(spark, folder):
    import tiktoken

    from pairvox.llm.bpe import BytePairEncoder

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BytePairEncoder.from_file(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    for i, r in rows_of(spark, folder, "op8_rank_queue_bpe").items():
        ids = np.array(peer.encode_ordinary(BYTES[i].decode()), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(BYTES[i]).hexdigest())


def test_quality_rows(spark, folder, none):
    got = rows_of(spark, folder, "op10_cotrained_quality")
    assert set(got) == set(BYTES) and all(0 <= x <= 1 for r in got.values() for x in (r.text_score, r.page_score, r.score))
    assert all(r.kept == (r.score >= 0.1) for r in got.values())


def test_twins_on_odd_rows(spark, folder):
    con = duckdb.connect()
    con.execute("SET memory_limit = '6GB'")
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, folder)
        got = con.execute(sql)
        columns = [c[0] for c in got.description]
        order = [df.columns.index(c) for c in columns]
        assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=str) == sorted(got.fetchall(), key=str), name


def test_empty_tables(spark, none):
    for name, query in queries.QUERIES.items():
        assert query(spark, none).count() == 0, name
    assert corpus_pipeline.run(spark, none).count() == 0


def test_pipeline_with_repeated_and_null_ids(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.filter("doc_id IN (60, 63)").union(docs.filter("doc_id = 66").selectExpr("cast(null AS long) AS doc_id", "text", "lang", "source", "n_chars"))
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        counts.append(docs.count())
    n = len(TEXTS) + 3
    assert counts[0] == counts[1] == n and n > counts[2] >= counts[3] > 0  # no labels: all documents stay
    assert docs.filter("doc_id IS NULL").count() >= 1

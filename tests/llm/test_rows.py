"""Operators that work row by row or by counts: sharding, transport streams, line dedup, licences, packing, BPE."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairvox.llm import bpe, license_scan, line_dedup, packing, sharding, transport_stream

public_tokenizers = pytest.importorskip("public_tokenizers")

RNG = random.Random(5)
WORDS = ["the", "MIT License", "don't", "été", "über", "12345", "!!", "...", "\n", "  ", "\t", "naïve", "日本語", "x" * 40, "aaaaaaa", "Apache License", "general public license", " ", "'s", "😀", "<|endoftext|>"]
TEXTS = [None, "", " ", "a", "a ", " a", "\n", "a\n b", "a  b", "é" * 63, "x" * 64, "Th\x1cis \x85 odd"] + [" ".join(RNG.choices(WORDS, k=RNG.randrange(1, 60))) for _ in range(60)] + [" ".join(RNG.choices(WORDS, k=4000))]
ROWS = [(i, t, ["s0", "s0", "s1", None][i % 4], "extra") for i, t in enumerate(TEXTS)] + [(3, "a", "s0", "extra"), (3, "a", "s0", "extra")]
SCHEMA = "doc_id long, text string, source string, length string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def payload(t):
    b = (t or "").encode()
    return b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))


def test_shards_follow_fractional_ranks(docs, none, spark):
    out = sharding.interleave_shards(docs, n_shards=5, rows_per_bucket=7).collect()
    n = len(ROWS)
    assert sorted(r.position for r in out) == list(range(n))
    assert all(r.size == len((t or "").encode()) + 1 for r in out for t in [dict((x[0], x[1]) for x in ROWS)[r.doc_id]])
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    ordered = sorted(out, key=lambda r: r.position)
    keys = [((2 * r.stratum_rank - 1) / r.stratum_rows, r.stratum) for r in ordered]
    assert keys == sorted(keys)
    for s in {r.stratum for r in out}:
        assert sorted(r.stratum_rank for r in out if r.stratum == s) == list(range(1, sum(r.stratum == s for r in out) + 1))
        per_shard = [sum(r.stratum == s and r.shard == k for r in out) for k in range(5)]
        assert max(per_shard) - min(per_shard) <= 2
    for s in {r.stratum for r in out}:  # ranks follow the seeded hash
        own = [hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest() for r in sorted((r for r in out if r.stratum == s), key=lambda r: r.stratum_rank)]
        assert own == sorted(own)
    assert sharding.interleave_shards(none).count() == 0


def test_streams_hold_their_payload(docs, none):
    for t in [*TEXTS, "y" * 70_000]:
        p = payload(t)
        media = transport_stream.write_stream(p)
        read = transport_stream.read_stream(media)
        assert read[0] == p and read[1:4] == (1, 6, 0x101) and read[5:8] == (0, 0, 0) and len(media) % 188 == 0
        assert [x[1] for x in read[-1]] == list(range(0, len(p), 8192)) and [x[2] for x in read[-1]] == [k % 4 == 0 for k in range(len(read[-1]))]
        assert [x[0] for x in read[-1]] == [3600 * k for k in range(len(read[-1]))]
    media = bytearray(transport_stream.write_stream(b"z" * 5000))
    lost = transport_stream.read_stream(bytes(media[: 188 * 4] + media[188 * 5 :]))
    assert lost[7] == 1  # a packet is missing
    media[188 * 0 + 9] ^= 1
    assert transport_stream.read_stream(bytes(media))[6] == 1  # a section is damaged
    assert transport_stream.section_crc(b"123456789") == 0x0376E6E7
    wrap = transport_stream.read_stream(transport_stream._unit_packets(b"", 0, True, 0)[0])
    assert wrap[0] == b""
    df = docs.select("doc_id", "length", transport_stream.padded_payload().alias("payload"))
    rows = transport_stream.demux(transport_stream.mux(df)).collect()
    assert sorted((r.doc_id, bytes(r.payload), r.length) for r in rows) == sorted((i, payload(t), "extra") for i, t, _, _ in ROWS)
    assert transport_stream.demux(transport_stream.mux(none.select("doc_id", transport_stream.padded_payload().alias("payload")))).count() == 0


def test_timestamps_of_all_widths():
    for t in (0, 1, 3600, 2**15, 2**30 + 12345, 2**33 - 1):
        h = bytes(9) + transport_stream._timestamp(2, t)
        assert (h[9] & 0x0E) << 29 | h[10] << 22 | (h[11] & 0xFE) << 14 | h[12] << 7 | h[13] >> 1 == t
        assert h[9] & 1 and h[11] & 1 and h[13] & 1 and h[9] >> 4 == 2


def test_site_lines(spark):
    rows = [(i, ["h", "h", None, "rare"][i % 4], "\n".join(["menu", f"own {i}", "", " menu ", "menu", f"some {i % 3}"]), "x") for i in range(80)]
    rows = [r for r in rows if r[1] != "rare" or r[0] < 40] + [(90, "h", None, "x"), (91, "h", "", "x"), (91, "h", "", "x"), (92, None, "menu", "x")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines string")
    for limit in (line_dedup.BROADCAST_BYTES, 0):
        got = {(r.page_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_site_lines(df, ratio=0.5, broadcast_bytes=limit).collect()}
        want = set()
        for i, host, text, _ in rows:
            own = [r for r in rows if (r[1] or "") == (host or "")]
            lines = text.split("\n") if text is not None else []
            hold = lambda x: sum(x.strip(" ") in [y.strip(" ") for y in (r[2] or "").split("\n")] for r in own if r[2] is not None)
            kept = [x for x in lines if not x.strip(" ") or hold(x) < 2 or hold(x) <= 0.5 * len(own)]
            want.add((i, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept)))
        assert got == want
    assert line_dedup.drop_site_lines(df.limit(0)).count() == 0


def test_site_lines_of_small_sites_and_long_texts(spark):
    long = "\n".join(f"line {i} " + "x" * 80 for i in range(40_000))
    rows = [(1, "two", f"footer\nown 1\n{long}"), (2, "two", "footer\nown 2"), (3, "one", "footer\nown 3"), (4, "one", None)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r.page_id: (r.text, r.n_dropped) for r in line_dedup.drop_site_lines(df).collect()}
    assert got == {1: (f"own 1\n{long}", 1), 2: ("own 2", 1), 3: ("footer\nown 3", 0), 4: (None, 0)}


def test_licence_places_and_statistics(docs, none):
    automaton = license_scan.LicenceAutomaton(license_scan.PHRASES, license_scan.TEMPLATES)
    full = [t for t, _ in automaton.texts]
    factors = {tuple(t[i:j]) for t in full for i in range(len(t)) for j in range(i + 1, min(len(t), i + 25) + 1)}
    vocabulary = sorted(automaton.ids)
    templates = [t for _, t in license_scan.TEMPLATES]
    texts = [*TEXTS, "Mit license mit LICENSE", *templates, "x " + templates[0][40:200] + " y"]
    texts += [" ".join(RNG.choices([w.decode() for w in vocabulary] + ["zzz"], k=80)) for _ in range(30)]
    texts += [" ".join(RNG.choice(templates)[RNG.randrange(60) :][: RNG.randrange(120)] for _ in range(6)) for _ in range(30)]
    for t in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]
        assert words == license_scan.words_of(t)
        places, matches = automaton.scan(words)
        want = sorted((i, k) for k, (p, _) in enumerate(automaton.phrases) for i in range(len(words)) if words[i : i + len(p)] == p)
        assert sorted(places) == want
        stats = [max((n for n in range(1, min(25, i + 1) + 1) if tuple(words[i + 1 - n : i + 1]) in factors), default=0) for i in range(len(words))]
        right = [(i, n) for i, n in enumerate(stats) if n > 1 and (i + 1 == len(words) or stats[i + 1] <= n)]
        assert [(i, n) for i, n, _ in matches if n < 25] == [x for x in right if x[1] < 25]
    for label, t in license_scan.TEMPLATES:
        row = license_scan.scan_text(automaton, f"before {t} after")
        assert label in row[5].split(",") and row[6] >= 0.99
    rows = license_scan.scan_licences(docs).collect()
    assert len(rows) == len(ROWS) and license_scan.scan_licences(none).count() == 0


def brute_chains(templates, words):
    """Best cover of each template by trying all chains of the longest common strings that end at a word."""
    out = []
    for t in templates:
        factors = {tuple(x[i:j]) for x in templates for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        stats = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in factors), default=0) for i in range(len(words))]
        ends = [(i, n) for i, n in enumerate(stats) if n > 1 and (i + 1 == len(words) or stats[i + 1] <= n)]
        own = [(i, e, n) for i, n in ends for e in range(n - 1, len(t)) if n >= min(4, len(t)) and words[i + 1 - n : i + 1] == t[e + 1 - n : e + 1]]

        def best(k, own=own):
            i, e, n = own[k]
            ways = [best(j) + min(n, i - own[j][0], e - own[j][1]) for j in range(k) if own[j][0] < i and own[j][1] < e and own[j][0] >= i - n - 8]
            return max([n, *ways])

        out.append(min(1.0, max((best(k) for k in range(len(own))), default=0) / len(t)))
    return out


def test_licence_chains_equal_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        templates = [rng.choices("abcdef", k=rng.randrange(5, 25)) for _ in range(2)]
        automaton = license_scan.LicenceAutomaton({}, [(f"l{i}", " ".join(t)) for i, t in enumerate(templates)])
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            words += [*t[a : a + rng.randrange(3, 14)], *("z" * rng.choice([0, 1, 3, 9]))]
        row = license_scan.scan_text(automaton, " ".join(words))
        covers = brute_chains([[w.encode() for w in t] for t in templates], [w.encode() for w in words])
        assert abs(row[6] - max(covers)) < 1e-12
        assert set(filter(None, row[5].split(","))) == {f"l{i}" for i, c in enumerate(covers) if c >= 0.5}
        assert all(0 <= x["first"] <= x["last"] < row[0] for x in row[7])


def test_licence_text_with_a_late_quote_in_the_middle(spark):
    automaton = license_scan.LicenceAutomaton(license_scan.PHRASES, license_scan.TEMPLATES)
    for label, t in license_scan.TEMPLATES[:13]:
        w = [x.decode() for x in license_scan.words_of(t)]
        half = len(w) // 2
        row = license_scan.scan_text(automaton, " ".join([*w[:half], *w[-5:], *w[half:]]))
        assert label in row[5].split(",") and row[6] >= 0.95, label
        later = license_scan.scan_text(automaton, " ".join(w[len(w) // 4 :]))  # without its opening
        assert label in later[5].split(",") and later[6] >= 0.7, label
    long = "word " * 400_000 + license_scan.TEMPLATES[0][1] + " MIT License" + " word" * 400_000
    rows = license_scan.scan_licences(spark.createDataFrame([(1, long, "clash"), (None, "", "clash")], "doc_id long, text string, labels string")).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].labels == "mit,mit-text" and got[1].n_base == 1 and got[1].score == 1.0 and got[None].n_words == 0 and got[None].score == 0


def brute_bpe(ranks, piece):
    parts = [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if not best:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_equals_tiktoken(docs, none):
    import tiktoken

    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        encoder = bpe.BytePairEncoder.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)
        peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
        for t in TEXTS:
            ids = [i for own in encoder.merge([w.encode() for w in encoder.words.findall(t or "")]) for i in own]
            assert ids == peer.encode_ordinary(t or "") and encoder.decode(ids) == (t or "").encode()
        pieces = [bytes(RNG.choices(b"abcaaaerint \xc3\xa9", k=RNG.randrange(1, 60))) for _ in range(300)]
        assert encoder.merge(pieces) == [brute_bpe(encoder.ranks, p) for p in pieces]
    rows = bpe.encode_ids(docs, path=public_tokenizers.path(name), pattern=public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((i, peer.encode_ordinary(t or "")) for i, t, _, _ in ROWS)
    assert len(encoder.merge([b"ab" * 20_000])[0]) > 1 and encoder.merge([]) == []
    assert bpe.encode_ids(none, path=public_tokenizers.path(name), pattern=public_tokenizers.PATTERN).count() == 0


def test_rank_queue_orders():
    for n in (1, 50, 3000):
        q, entries = bpe.RankQueue(), [(RNG.randrange(200_000), RNG.randrange(1000)) for _ in range(n)]
        for e in entries:
            q.push(*e)
        got = []
        while (r := q.lowest()) >= 0:
            got += [(r, place) for place in q.take(r)]
        assert got == sorted(entries) and not (q.top or q.low or q.mid)


def test_chunked_tokenizer_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, peer = packing.ChunkedTokenizer(path), Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + ["one\n", "one two\n", "two", "x<|endoftext|>y<|endoftext|>", "'s it 's", "it's  'll"]
    for _ in range(2):
        got = own.run(texts)
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == peer.encode(t, add_special_tokens=False).ids, t


def test_slack_windows_are_closest():
    for _ in range(40):
        cap = RNG.randrange(5, 40)
        counts = {RNG.randrange(1, cap + 1): RNG.randrange(1, 6) for _ in range(RNG.randrange(1, 7))}
        left = dict(counts)
        for chosen, times in packing.minimum_slack(counts, cap):
            total = sum(n * k for n, k in chosen.items())
            assert total <= cap and times >= 1 and max(chosen) == max(n for n, c in left.items() if c)
            seed = max(chosen)
            sums = {seed}
            for n, c in left.items():
                for _ in range(c - (n == seed)):
                    sums |= {s + n for s in sums if s + n <= cap}
            assert total == max(sums)
            for n, k in chosen.items():
                left[n] -= k * times
                assert left[n] >= 0
        assert not any(left.values())


def test_pieces_fill_windows(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    peer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path=path, capacity=64).collect()
    texts = {i: t for i, t, _, _ in ROWS}
    per_doc, per_sequence = {}, {}
    for r in rows:
        ids = np.array([*peer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, cuts in per_doc.items():
        times = sum(x[0] == i for x in ROWS)
        assert sorted(cuts) == sorted((s, n) for s, n in set(cuts) for _ in range(times))
    for parts in per_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r.length for r in rows)
    assert total / (64 * len(per_sequence)) > 0.97
    assert sorted(per_sequence) == list(range(len(per_sequence)))
    assert packing.pack(none, path=path).count() == 0


def test_digest_queries_name_their_columns(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = transport_stream.query(spark, str(tmp_path)).collect()
    for r in rows:
        p = payload(dict((x[0], x[1]) for x in ROWS)[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(transport_stream.write_stream(p)).hexdigest()
    by_text = {}
    for r in sharding.query(spark, str(tmp_path)).collect():
        assert r.text_crc32 == zlib.crc32((dict((x[0], x[1]) for x in ROWS)[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None
        by_text[r.text_crc32] = r


def test_bpe_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 9, b"abc": 3, b"aba": 5, b"bc": 7, b"ca": 8, b"cab": 2, b"abab": 1}
    encoder = bpe.BytePairEncoder(ranks, r"\S+")
    pieces = [bytes(RNG.choices(b"abc", k=RNG.randrange(1, 30))) for _ in range(500)]
    assert encoder.merge(pieces) == [brute_bpe(ranks, p) for p in pieces]

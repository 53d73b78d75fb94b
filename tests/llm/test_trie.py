"""The prefix trie against a plain version in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairvox.llm import prefix_trie as trie

RNG = random.Random(11)
SCHEMA = "conv_id long, turn long, role string, text string, turns int, `a.b` int, depth int, key string"


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(t[3], t[4]) for t in sorted(x)] for c, x in convs.items()}


def plain(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = {}
    for path, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        leaves = sum(out[p][5] for p in kids) or 1
        saved = sum(out[p][6] for p in kids) + ((len(members) - 1) * words(path[-1][1]) if path else 0)
        parent = min(nodes[path[:-1]]) if path else None
        out[path] = (min(members), len(path), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def some_rows():
    rows = []
    for c in range(-5, 120):
        if c % 7 == 3:
            continue
        for k in range(RNG.choice([0, 1, 2, 2, 5, 9])):
            rows.append((c, RNG.choice([k, k, k, None]), RNG.choice(["user", "user", None]), RNG.choice(["hi there", "hi there", " ", None, "a\x0bb ü", f"t{c % 4}"]), 1, 1, 1, "k"))
    rows += [(c, 0, "user", "hi there", 1, 1, 1, "k") for c in range(1000, 1300)] + [(c, k, "u", "same same", 1, 1, 1, "k") for c in (500, 501, 502) for k in range(60)]
    rows += [(None, 1, "user", "lost", None, None, None, None), rows[0], rows[5], (700, None, None, None, None, None, None, None)]
    RNG.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize(("chunk_rows", "few"), [(50_000, 500_000), (9, 40), (60, 300)])
def test_as_the_plain_version(spark, chunk_rows, few):
    rows = some_rows()
    convs = trie.spoken(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert result(trie.prefix_trie(convs, chunk_rows=chunk_rows, few=few)) == plain(ordered(rows))


def test_heads_of_another(spark):
    rows = some_rows()
    convs = trie.with_heads_of(trie.spoken(spark.createDataFrame(rows, SCHEMA)), F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    own = ordered(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert result(trie.prefix_trie(convs, chunk_rows=20, few=100)) == plain(want)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.spoken(none)).count() == 0
    convs = trie.with_heads_of(trie.spoken(spark.createDataFrame([(5, 0, "u", "x", 1, 1, 1, "")], SCHEMA)), F.lit(9), F.lit(2))
    assert result(trie.prefix_trie(convs)) == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]


def test_extents_by_halving():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 65):
        lcp = rng.integers(0, 4, n - 1)
        row, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5), indexing="ij"))
        first, last = trie.extents(lcp, row, depth)
        for i, d, a, b in zip(row, depth, first, last, strict=True):
            x = y = i
            while x > 0 and lcp[x - 1] >= d:
                x -= 1
            while y < n - 1 and lcp[y] >= d:
                y += 1
            assert (a, b) == (x, y)


def test_pieces_are_hashed_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"a", b"b"]), pa.array([1, 3, 2]), pa.array(["1,2", "3", "2"])], ["id", "conv_id", "ends"])
    more = pa.RecordBatch.from_arrays([pa.array([b"b"]), pa.array([9]), pa.array(["9"])], ["id", "conv_id", "ends"])
    got = {x["id"]: x["ends"] for b in trie._hashed(iter([batch, more])) for x in b.to_pylist()}
    assert got == {b"a": hashlib.sha256(b"1,2,3").hexdigest(), b"b": hashlib.sha256(b"2,9").hexdigest()}

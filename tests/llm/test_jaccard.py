"""The grouped prefix join against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from pairvox.llm import jaccard_join
from pairvox.llm.common import connected_components
from pairvox.llm.hashing import Substrings, word_hashes
from pairvox.llm.repeated import packed_list, planes, unplanes

RNG = random.Random(11)


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus():
    words = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x y"]
    rows, texts = [], []
    for _ in range(12):
        base = RNG.choices(words, k=RNG.randrange(20, 120))
        for _ in range(RNG.randrange(1, 16)):
            t = list(base)
            for _ in range(RNG.randrange(4)):
                t[RNG.randrange(len(t))] = RNG.choice(words)
            texts.append(RNG.choice([" ", "\n", "  "]).join(t))
    passage = " ".join(RNG.choices(words, k=60))
    texts += [f"{passage} {' '.join(RNG.choices(words, k=RNG.randrange(0, 12)))}" for _ in range(25)]
    texts += [None, "", " ", "\n\t", "one", "One", "one two", "ONE two", "one two three", "a b c d", "A B C D", "a b c d e"] + texts[:6] + [t.upper() for t in texts[6:9]]
    RNG.shuffle(texts)
    rows = list(enumerate(texts))
    return rows


@pytest.mark.parametrize("block", [1200, 7])
def test_components_equal_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    for width, percent in ((4, 85), (5, 80), (2, 60)):
        got = sorted(map(tuple, jaccard_join.jaccard_components(df, width=width, percent=percent, block=block).collect()))
        assert got == brute(rows, width, percent)


def test_negative_ids(spark):
    rows = [(i - 90, t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, width=4, percent=85).collect())) == brute(rows, 4, 85)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "a b c d e f")]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, None, None), (2, 0, 2), (3, 2, 1)], key=str)


def test_hashes_and_planes():
    data = np.frombuffer(b"abcabc xyz abc", np.uint8)
    h = Substrings(data)
    assert h.of(np.array([0, 3, 11]), np.array([3, 6, 14])).tolist() == [int(h.every(3)[0])] * 3
    assert len(set(h.every(3).tolist())) == len({bytes(data[i : i + 3]) for i in range(len(data) - 2)})
    for kind in (np.int64, np.uint32):
        x = np.array([0, 1, 2**31, 77], kind)
        assert unplanes(planes(x), kind).tolist() == x.tolist()


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_connected_components(spark, few):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1090)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent if any(root(y) == root(x) for y in parent if y != x)}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = connected_components(df, few=few).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(df.limit(0), few=few).count() == 0


def test_filters_and_links_save_verification(monkeypatch):
    """A family of near copies and many documents that share no prefix token with it: few of a block's pairs are verified."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 50, 200))
    sets = [np.sort(np.unique(np.append(np.delete(base, rng.integers(200)), rng.integers(0, 1 << 50)))) for _ in range(300)]
    sets += [np.sort(rng.integers(0, 1 << 50, 200)) for _ in range(300)]
    pdf = pd.DataFrame({"rep": range(600), "gid": range(600), "n": [len(x) for x in sets], "keys": [packed_list(x) for x in sets]})
    verified, shared = [], jaccard_join._shared
    monkeypatch.setattr(jaccard_join, "_shared", lambda side, rows, marked: verified.append(len(rows)) or shared(side, rows, marked))
    edges = jaccard_join._links(pdf, pdf, 85, True)
    assert len(edges) == 299 and max(max(e) for e in edges) < 300
    assert sum(verified) < 2 * 300 < 600 * 599 // 2


def test_words_of_a_regular_structure_do_not_meet(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]  # the Thue-Morse sequence: polynomials modulo 2^64 can't tell it from its reverse
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    rows = [(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs, width=4, percent=85).collect())
    assert got == [(i, 1, i) for i, _ in rows]


def test_word_hashes_depend_on_the_word_alone():
    words = [RNG.choice(["", "x"]) * RNG.randrange(300) + "".join(RNG.choices("abc\x80é", k=RNG.randrange(1, 200))) for _ in range(500)]
    hashes = {}
    for order in (words, words[::-1], sorted(words)):
        data = np.frombuffer(" ".join([*order, ""]).encode(), np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.append(0, ends[:-1] + 1)
        for w, h in zip(order, word_hashes(data, starts, ends).tolist(), strict=True):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)

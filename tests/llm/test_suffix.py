"""Suffix-array dedup against brute force."""

import random

import pytest

from pairvox.llm import suffix_dedup

RNG = random.Random(3)


def test_suffix_arrays():
    for n in list(range(1, 40)) + [200, 1000]:
        for top in (1, 2, 3, 50):
            t = [RNG.randrange(1, top + 1) for _ in range(n)]
            assert suffix_dedup.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])
    assert suffix_dedup.suffix_array([]) == []
    for t in ([1, 2] * 300, [2, 1] * 300, [1] * 500, list(range(400, 0, -1)), list(range(1, 400))):
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_order_of_contexts():
    strings = [bytes(RNG.choices(b"ab\0", k=RNG.randrange(0, 50))) for _ in range(400)] + [b"", b"a", b"a\0", b"a\0\0", b"x" * 16, b"x" * 32, b"x" * 32 + b"\0"]
    place, common, _ = suffix_dedup._sorted_contexts(strings)
    order = sorted(set(strings))
    assert [order[p] for p in place] == strings
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        assert c == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def brute(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), bytes(gone).count(b"\0\1") + gone.startswith(b"\1"), kept))
    return sorted(out)


def corpus():
    words = [f"{a}{b}" for a in ("wo", "ré", "x", "lon") for b in range(60)] + ["\0", "\n", "日本"]
    base = [" ".join(RNG.choices(words, k=RNG.randrange(10, 150))) for _ in range(25)]
    texts = list(base)
    for _ in range(50):
        a, b = RNG.choice(base), RNG.choice(base)
        t = list(a[RNG.randrange(len(a)) :][: RNG.randrange(300)] + " ".join(RNG.choices(words, k=5)) + b[: RNG.randrange(200)])
        for _ in range(RNG.randrange(3)):
            if t:
                t[RNG.randrange(len(t))] = RNG.choice("xyzé")
        texts.append("".join(t))
    passage = " ".join(RNG.choices(words, k=30))
    texts += [f"{' '.join(RNG.choices(words, k=8))} {passage} {' '.join(RNG.choices(words, k=8))}" for _ in range(30)]
    texts += base[:6] + base[:3] + [None, "", "short", "a" * 49, "a" * 50, "a" * 130, "a" * 3000, "ab" * 400, "ab" * 700 + "b", "é" * 25, "é" * 26, "x" + "é" * 25]
    RNG.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_removed_bytes_equal_brute_force(spark, hot, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "kept", 7) for i, t in rows], "doc_id long, text string, kept string, at int").repartition(4)
    for length in (50, 20):
        got = suffix_dedup.remove_repeats(df, length=length, hot_rows=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, length)
        assert {r["at"] for r in got} == {7}


def test_negative_ids(spark):
    rows = [(i - 60, t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix_dedup.remove_repeats(df, length=50).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 50)


def test_pieces_of_long_texts(monkeypatch):
    text = [bytes(RNG.choices(b"abcd", k=5000)), b"", bytes(RNG.choices(b"abcd", k=700))]
    a = sorted((int(r), int(s + i), int(p)) for row, start, n, place, _ in suffix_dedup.windows(text, 50) for r, s, k, p in zip(row, start, n, place, strict=True) for i in range(k))
    monkeypatch.setattr(suffix_dedup, "_PIECE", 300)
    b = sorted((int(r), int(s + i), int(p)) for row, start, n, place, _ in suffix_dedup.windows(text, 50) for r, s, k, p in zip(row, start, n, place, strict=True) for i in range(k))
    assert a == b and len(a) == 5000 - 49 + 700 - 49


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "0123456789" * 3 + "abcdefghij" * 3
    rows = [(1, long), (1, long), (None, long), (2, None), (3, long + "!")]
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0, 0), (None, 0, 0), (2, 0, 0), (3, 60, 1)}

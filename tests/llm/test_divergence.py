"""The divergence of sources against a plain version in Python."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairvox.llm import divergence

RNG = random.Random(13)
WORDS = ["the", "The", "été", "ÉTÉ", "a", "b", "x1y", "naïve", "日本", "zz", "rare"]
SCHEMA = "doc_id long, text string, lang string, source string, term string, digest long, `a.b` int"


def some_rows():
    rows = []
    for i in range(160):
        lang, source = RNG.choice(["en", "en", "de", None, ""]), RNG.choice(["s0", "s0", "s0", "s1", "ä", None])
        text = RNG.choice([None, "", " -- ", " ".join(RNG.choices(WORDS, k=RNG.randrange(1, 30))), " ".join(f"w{RNG.choice('abcdefgh')}{RNG.choice('ijkl')}" for _ in range(20))])
        rows.append((i, text, lang, source, "x", 1, 1))
    rows += [(500, "the " * 5000, "en", "long", "x", 1, 1)] * 2 + [(None, None, "only", "alone", None, None, None), (1, None, "none", "p", None, None, None), (2, "once", "none", "q", None, None, None)]
    return rows


def plain(rows, least_docs=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = terms(text)
        docs[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for g in count:
            if g[0] == lang:
                whole.update({t: count[g][t] for t in kept})

        def ps(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q = ps(whole)
        sources = {g[1]: ps(count[g]) for g in count if g[0] == lang}
        f = lambda a, b: (a - b) ** 2 // b
        for s, p in sources.items():
            pair = [(sum(f(p[t], r[t]) for t in kept), o) for o, r in sources.items() if o != s]
            own = [(f(p[t], q[t]), t) for t in kept if count[lang, s][t] and p[t] > q[t]]
            for part, items in (("pair", pair), ("term", own)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, k) for k, (v, t) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit(docs, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence_audit(docs, **options).collect())


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_as_the_plain_version(docs, rows):
    assert audit(docs) == plain(rows)


def test_collisions_small_cells_blocks_and_tops(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    got = audit(docs, digest=F.pmod(F.xxhash64("term"), F.lit(7)), cell=9, block=2, top=4, least_docs=2)
    assert got == plain(rows, least_docs=2, top=4)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)) == []


def test_no_term_is_kept(spark):
    rows = [(1, "a b", "x", "s", None, None, None), (2, "c", "x", "t", None, None, None)]
    assert audit(spark.createDataFrame(rows, SCHEMA)) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_large_counts_stay_exact(spark):
    n, total, v = 9_000_000_000_000, 30_000_000_000_001, 7
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + v)
    counts = pd.DataFrame({"lang": "x", "i": 0, "j": 0, "share": 0, "place": [0, 1, 1], "digest": [5, 5, 6], "split": "", "n": [n, 3, 4]})
    sides = pd.DataFrame({"place": [0, 1], "total": [n, 7], "v": [2, 2]})
    got = {(r.a, r.b): (r.value, r.seen) for r in divergence._cell(counts, sides, 256).itertuples()}
    p = [[1 + 1_000_000_000 * (c + 1) // (t + 2) for c in own] for own, t in (((n, 0), n), ((3, 4), 7))]
    assert got == {(a, b): (sum((x - y) ** 2 // y for x, y in zip(p[a], p[b], strict=True)), 2) for a, b in ((0, 1), (1, 0))}

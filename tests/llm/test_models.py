"""Vectors against brute force, the classifier on held-out rows."""

import random

import numpy as np
import pytest

from pairvox.llm import itq_dedup, quality

RNG = np.random.default_rng(4)


def brute(rows, least):
    ok = [label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = {i: 0 for i in range(len(rows))}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    found = set()
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2]:
                x, y = np.asarray(rows[a][1], float), np.asarray(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    found.add((b, a))
                    p, q = sorted((root(a), root(b)), key=lambda i: rows[i][0])
                    parent[q] = p
    return links, [rows[root(i)][0] for i in range(len(rows))], found


def vectors():
    out, k = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = RNG.standard_normal(64)
            for _ in range(RNG.integers(1, 14)):
                v = (centre + 0.11 * RNG.standard_normal(64)).astype(np.float32)
                out += [(k, v.tolist(), label)] + [(k + 1 + j, v.tolist(), label) for j in range(RNG.integers(0, 3))]
                k = out[-1][0] + 1
    one = out[0][1]
    out += [(k, None, 0), (k + 1, [0.0] * 64, 0), (k + 2, [float("nan"), *one[1:]], 0), (k + 3, [None, *one[1:]], 0), (k + 4, one, None), (k + 5, [float("inf"), *one[1:]], 0)]
    out.append((k + 6, [2 * x for x in one], 0))
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("block", [1500, 5])
def test_links_of_vectors(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<float>, label int, rep string, count int").repartition(3)
    got = {r.vec_id: r for r in itq_dedup.near_vectors(df, block=block).collect()}
    links, components, _ = brute(rows, 0.98)
    assert len(got) == len(rows)
    total = sum(links.values())
    assert sum(r.n_links for r in got.values()) >= 0.95 * total and all(got[r[0]].n_links <= links[i] for i, r in enumerate(rows))
    right = sum(got[r[0]].component_id == components[i] for i, r in enumerate(rows))
    assert right >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def planted(n, cosine, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 64)))
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), k % 3), (2 * k + 1, (cosine * x + np.sqrt(1 - cosine**2) * y).tolist(), k % 3)]
    return rows


@pytest.mark.parametrize("cosine", [0.9801, 0.985, 0.99])
def test_recall_of_planted_pairs(spark, cosine):
    df = spark.createDataFrame(planted(1500, cosine), "vec_id long, embedding array<double>, label int")
    assert sum(r.n_links for r in itq_dedup.near_vectors(df).collect()) >= 0.995 * 3000


def test_vectors_of_any_dimension_and_size(spark):
    rows = [(i, v, 0) for i, v, _ in planted(40, 0.99)]
    rows += [(1000 + i, v[:10], 0) for i, v, _ in planted(30, 1.0)] + [(2000 + i, [1e200 * x for x in v], 1) for i, v, _ in planted(20, 0.99)] + [(3000 + i, [1e-250 * x for x in v], 2) for i, v, _ in planted(20, 0.99)]
    got = {r.vec_id: r for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, components, _ = brute([(i, [x * (1e-200 if 2000 <= i < 3000 else 1e250 if i >= 3000 else 1) for x in v], (label, len(v))) for i, v, label in rows], 0.98)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {r[0]: (links[k], components[k]) for k, r in enumerate(rows)}


def test_links_do_not_depend_on_the_size(spark, monkeypatch):
    rows = planted(1500, 0.981)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    first, counts = type(df).first, []

    def many(self):
        row = first(self)
        if self.columns != ["d", "count"]:
            return row
        counts.append(row["count"])
        return {"d": row["d"], "count": 5_000_000}

    small = sorted(tuple(r) for r in itq_dedup.near_vectors(df).collect())
    monkeypatch.setattr(type(df), "first", many)
    assert sorted(tuple(r) for r in itq_dedup.near_vectors(df).collect()) == small and counts == [3000]
    assert sum(r[1] for r in small) >= 0.97 * 3000


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert itq_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in itq_dedup.near_vectors(spark.createDataFrame([(5, None, 1)], schema)).collect()] == [(5, 0, 5, True)]
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0, 0.0], 1)]
    got = sorted((tuple(r) for r in itq_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, None, None, None), (2, 0, 2, True), (3, 0, 3, True)], key=str)


def test_rotation_balances_bits():
    x = RNG.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = itq_dedup.fit_rotation(x, bits=64, seed=1)
    share = ((x - mean) @ p >= 0).mean(axis=0)
    assert share.min() > 0.4 and share.max() < 0.6
    assert np.allclose(p.T @ p, np.eye(64), atol=1e-8)
    assert itq_dedup.fit_rotation(x[:, :8], bits=64, seed=1)[1].shape == (8, 64)


def test_quality_on_rows_it_has_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    model = quality.fit_quality(docs, seen)
    scored = quality.score_quality(docs, model, columns=["doc_id"])
    got = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "score", "text_score", "page_score").toPandas()
    for column in ("score", "text_score"):
        assert (((got[column] >= 0.5) == (got.quality == 1)).mean()) > 0.95, column
    rank, good = got.page_score.rank(), got.quality == 1  # the record alone says little here, but more than chance
    assert (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum() > 0.6
    good = got[got.quality == 1]
    assert (good.score >= quality.REJECT_BELOW).mean() > 0.99
    assert (got[got.quality == 0].score < quality.REJECT_BELOW).mean() > 0.9


def test_quality_equals_a_plain_reimplementation(spark):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(30)], [f"B%{i}!" for i in range(30)]
    rows = []
    for i in range(700):
        y = i % 2
        t = " ".join(rng.choices(good if y else bad, k=rng.randrange(5, 40)))
        rows.append((i, t, rng.choice(["en", "de", None]), f"s{y if rng.random() < 0.95 else 1 - y}", len(t)))
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 60)] + [(None, *rows[5][1:]), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(7, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels, labelled_rows=60)
    h = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    o = {r.doc_id: (r.a, r.b) for r in docs.selectExpr("doc_id", "xxhash64(3, doc_id) AS a", "pmod(xxhash64(5, doc_id), 10) AS b").collect()}
    clean = {i: i % 2 for i in range(200) if i != 7}
    view = lambda r: (quality.text_view((r[1] or "").encode()), quality.page_view((r[1] or "").encode(), r[3], r[2], r[4]))
    chosen = [i for y in (1, 0) for i in sorted((i for i in clean if clean[i] == y), key=lambda i: o[i][0])[:60]]
    chosen.sort(key=lambda i: o[i][0])
    first = {i: min((h[r[1]], *(x.tobytes() for x in view(r)), k) for k, r in enumerate(rows) if r[0] == i)[-1] for i in chosen}
    stacked = [np.stack(x) for x in zip(*(view(rows[first[i]]) for i in chosen), strict=True)]
    pool = [r for r in rows if r[0] not in clean]

    def give(models, taken):
        out = []
        for v in (0, 1):
            for label in (0, 1):
                best = {}
                for r in pool:
                    p = float(quality._sigmoid(models[v].logits(view(r)[v][None]))[0])
                    sure = p if label else 1 - p
                    if sure >= quality.CONFIDENCE and h[r[1]] not in taken[1 - v]:
                        best[h[r[1]]] = max(sure, best.get(h[r[1]], 0))
                for x in sorted(best, key=lambda x: (-best[x], x))[: quality.HANDED_ON]:
                    r = min((r for r in pool if h[r[1]] == x), key=lambda r: (r[0] is not None, r[0] or 0))
                    out.append((v, label, x, *view(r)))
        given.append(len(out))
        return out

    given = []
    want = quality.co_train(stacked, np.array([clean[i] for i in chosen]), np.array([o[i][1] < 3 for i in chosen]), give)
    got = {(r.doc_id, r.text): (r.text_score, r.page_score, r.score) for r in quality.score_quality(docs, model).collect()}
    assert sum(given) > 200
    for r in rows:
        assert np.allclose(got[r[0], r[1]], want.scores(*(x[None] for x in view(r)))[0], atol=1e-4)


def test_views_are_separate_and_take_long_texts():
    body = ("some words of a text " * 150_000).encode()
    assert quality.text_view(body).shape == (quality.TEXT_DIMS,) and quality.page_view(body, "s", "en", 5).shape == (quality.PAGE_DIMS,)
    whole = np.frombuffer(body, np.uint8)
    counts = np.bincount(quality._MIX[0][whole[:-2]] + quality._MIX[1][whole[1:-1]] + quality._MIX[2][whole[2:]] & quality.TRIGRAMS - 1, minlength=quality.TRIGRAMS)
    assert (quality.text_view(body)[: quality.TRIGRAMS] == quality._bytes(np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), 1020)).all()
    assert (quality.page_view(b"aaa bbb", "s", "en", 7) == quality.page_view(b"!!? ???", "s", "en", 7)).all()  # content is not in the page view
    assert quality.text_view(b"").sum() == 0


def test_quality_without_labels_and_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some text here", "en", None, 14, "x"), (2, "", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(docs, none) is None
    rows = quality.score_quality(docs, None).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {1.0} and "text" in rows[0].asDict()
    assert quality.score_quality(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(i, f"good words of all kinds {i}" if i % 2 else "BAD!! " * 20, "en", "s", 5, "x") for i in range(80)], docs.schema)
    model = quality.fit_quality(docs.union(more), labels)
    out = {r.doc_id: r.score for r in quality.score_quality(docs.union(more), model).collect()}
    assert out[61] > 0.5 > out[62]


@pytest.mark.parametrize("common", [0.9, 0.95])
def test_recall_where_vectors_share_a_direction(spark, common):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(common) * unit(rng.standard_normal(64)) + np.sqrt(1 - common) * unit(rng.standard_normal((1500, 64))))
    noise = rng.standard_normal(x.shape)
    noise = unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    y = 0.9802 * x + np.sqrt(1 - 0.9802**2) * noise
    both = np.concatenate([x, y])
    truth = int((both @ both.T >= 0.98).sum()) - len(both)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in itq_dedup.near_vectors(df).collect())
    assert truth >= 3000 and 0.99 * truth <= found <= truth


def test_too_few_bits_are_an_error():
    rng = np.random.default_rng(6)
    x = itq_dedup._unit(itq_dedup._unit(rng.standard_normal((1, 32))) * 40 + itq_dedup._unit(rng.standard_normal((500, 32))))
    with pytest.raises(ValueError, match="planted pairs"):
        itq_dedup.enough_rotations(x, (7,), min_cosine=0.98, bits=32, width=32)

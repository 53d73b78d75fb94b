"""The stages of the pipeline, each against a brute-force version on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pairvox.llm import quality
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_suffix import brute as brute_repeats

public_tokenizers = pytest.importorskip("public_tokenizers")

RNG = random.Random(8)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    words = [f"{a}{b}" for a in ("wo", "ré", "xu", "lon") for b in range(200)]
    base = [" ".join(RNG.choices(words, k=RNG.randrange(30, 90))) for _ in range(60)]
    texts = []
    for t in base:
        texts.append(f"shared line of the site\n{t}")
        if RNG.random() < 0.4:
            w = t.split()
            w[3] = "changed"
            texts.append(f"shared line of the site\n{' '.join(w)}")
        if RNG.random() < 0.3:
            texts.append(t[:120] + " " + " ".join(RNG.choices(words, k=40)))
    texts += [f"{' '.join(RNG.choices(words, k=40))} {x}" for x in ("é" * 40, "é" * 30 + "è" * 5)]  # a cut within a character
    texts += [" ".join(["BUY!!", "NOW!!"] * 25)] * 3 + [" ".join(["THE%%%", "BEST###"] * RNG.randrange(20, 40)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("!!" not in t and "%" not in t), 0) for i, t in enumerate(texts) if i % 3 != 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        texts = [(i, r.text) for i, r in sorted(before.items())]
        if k == 0:
            model = quality.fit_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            b = [(t or "").encode() for _, t in texts]
            s = model.scores(np.stack([quality.text_view(x) for x in b]), np.stack([quality.page_view(x, before[i].source, before[i].lang, before[i].n_chars) for x, (i, _) in zip(b, texts, strict=True)]))[:, 2]
            assert set(after) == {i for (i, _), x in zip(texts, s, strict=True) if x >= quality.REJECT_BELOW}
            assert all("!!" not in (r.text or "") and "%" not in (r.text or "") for r in rows) and sum(r.text is not None for r in rows) > 80
        elif k == 1:
            assert set(after) == set(before)
            for i, r in after.items():
                want = before[i].text and "\n".join(x for x in before[i].text.split("\n") if x != "shared line of the site")
                assert r.text == want and (r.text is None or r.n_chars == len(r.text))
        elif k == 2:
            assert set(after) == {i for i, _, c in brute_components(texts, 5, 80) if i == c} and len(after) < len(before)
        elif k == 3:
            want = {i: kept.decode("utf-8", "ignore") for i, n, gone, _, kept in brute_repeats(texts, 50) if not n or gone < n}
            assert {i: r.text or "" for i, r in after.items()} == want and any(want[i] != (before[i].text or "") for i in want)
        else:
            assert {r.doc_id for r in rows} == set(before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, rows))


def test_lines_of_small_sources(spark):
    rows = [(i, f"footer\nown {i}\n{'pair' if i < 2 else 'x'}", "small") for i in range(4)] + [(10, "footer\nown", "one")]
    rows += [(100 + i, "\n".join(["menu"] * (i < 3) + ["rare"] * (i < 2) + [f"own {i}"]), "twenty") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if (x, s) not in (("footer", "small"), ("menu", "twenty"))) for i, t, s in rows}

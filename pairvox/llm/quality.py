"""Operator 10: a quality classifier by co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, named, table, written
from pairvox.llm.repeated import runs

#: Labelled rows of each class that the fit sees, at most; rounds of exchange; pseudo-labels of each class a view hands on in a round.
LABELLED_ROWS, ROUNDS, HANDED_ON = 1500, 3, 150
#: A pseudo-label is handed on from this calibrated confidence; a document is rejected below this score.
CONFIDENCE, REJECT_BELOW = 0.98, 0.1

#: Hashed trigrams and counted facts of the content; layout facts, length steps and hashed names of the record.
TRIGRAMS, CONTENT, LAYOUT, STEPS, SOURCES, LANGS = 1024, 8, 5, 16, 32, 16
TEXT_DIMS, PAGE_DIMS = TRIGRAMS + CONTENT, LAYOUT + STEPS + SOURCES + LANGS

#: Second-level groups of the candidates of a round: none of them holds more than a share of the tasks' lists.
_SPREAD = 64
_PIECE = 1 << 20

_MIX = np.random.Generator(np.random.PCG64(99)).integers(1, 2**31, (3, 256), dtype=np.int64)
_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white space, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def _bytes(x: np.ndarray, scale: int = 255) -> np.ndarray:
    return np.clip(np.rint(np.asarray(x) * scale), 0, 255).astype(np.uint8)


def text_view(body: bytes) -> np.ndarray:
    """Content: hashed byte trigrams of the whole text (roots of counts, scaled to length 1), kinds of characters, repeated and long words; a byte each."""
    counts, kinds = np.zeros(TRIGRAMS, np.int64), np.zeros(6, np.int64)
    words, distinct = 0, set()
    for at in range(0, len(body), _PIECE):
        b = np.frombuffer(body, np.uint8, min(_PIECE + 2, len(body) - at), at)
        if len(b) > 2:
            counts += np.bincount(_MIX[0][b[:-2]] + _MIX[1][b[1:-1]] + _MIX[2][b[2:]] & TRIGRAMS - 1, minlength=TRIGRAMS)
        kinds += np.bincount(_KIND[b[:_PIECE]], minlength=6)
        own = body[at : at + _PIECE].split()
        words += len(own)
        distinct.update(own)
    roots = np.sqrt(counts)
    facts = [*kinds / max(1, len(body)), len(distinct) / max(1, words), min(1.0, len(body) / max(1, words) / 20)]
    return np.append(_bytes(roots / max(1.0, float(np.linalg.norm(roots))), 1020), _bytes(facts))


def page_view(body: bytes, source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """The record and its layout: source, language, stated length, bytes, number and length of lines, repeated and empty lines; a byte each."""
    x = np.zeros(PAGE_DIMS, np.uint8)
    lines = body.split(b"\n")
    x[:LAYOUT] = _bytes([np.log1p(len(body)) / 20, np.log1p(len(lines)) / 15, np.log1p(len(body) / len(lines)) / 15, len(set(lines)) / len(lines), sum(not s.strip() for s in lines) / len(lines)])
    if n_chars is not None and n_chars == n_chars:
        x[LAYOUT + min(STEPS - 1, int(np.log2(1 + max(0.0, min(n_chars, 1e15)))))] = 255
    x[LAYOUT + STEPS + zlib.crc32((source or "").encode()) % SOURCES] = 255
    x[LAYOUT + STEPS + SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 255
    return x


@dataclass
class Logistic:
    """Logistic regression with scaled features and classes of equal weight, fitted by accelerated gradient steps."""

    penalty: float = 1e-3
    steps: int = 300
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        z = np.ones((len(x), x.shape[1] + 1), np.float32)
        z[:, :-1] = x
        mean, scale = z[:, :-1].mean(axis=0, dtype=np.float64), z[:, :-1].std(axis=0, dtype=np.float64) + 0.25
        z[:, :-1] -= mean.astype(np.float32)
        z[:, :-1] /= scale.astype(np.float32)
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
        look = np.ones(z.shape[1], np.float32)
        for _ in range(30):  # the largest eigenvalue of the weighted Gram matrix, by powers
            look = z.T @ (share * (z @ look))
            size = float(np.linalg.norm(look))
            look /= max(size, 1e-30)
        step = np.float32(1 / (0.25 * 1.2 * size + self.penalty))
        w = look = np.zeros(z.shape[1], np.float32)
        for k in range(self.steps):
            slope = z.T @ (share * (_sigmoid(z @ look) - y).astype(np.float32)) + np.float32(self.penalty) * np.append(look[:-1], np.float32(0))
            w, last = look - step * slope, w
            look = w + np.float32(k / (k + 3)) * (w - last)
        self.weights = (w[:-1] / scale).astype(np.float32)
        self.bias = float(w[-1] - mean @ (w[:-1] / scale))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.weights + np.float32(self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class View:
    """A view's model and its calibration on rows that the model hasn't seen."""

    model: Logistic
    calibration: Logistic

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
        model = Logistic().fit(x, y)
        return cls(model, Logistic(penalty=1e-3).fit(_clipped(model.logits(held_x)), held_y))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.logits(_clipped(self.model.logits(x)))


def _clipped(logits: np.ndarray) -> np.ndarray:
    return np.clip(logits, -20, 20).reshape(len(logits), -1)


@dataclass
class CoTrained:
    """Both calibrated views and the way they are combined."""

    views: list[View]
    both: Logistic

    def scores(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Columns: text view, page view, both; each a calibrated probability of good quality."""
        logits = [v.logits(x) for v, x in zip(self.views, (text, page), strict=True)]
        return _sigmoid(np.stack([*logits, self.both.logits(_clipped(np.stack(logits, axis=1)))], axis=1).astype(np.float64))


#: What a round hands on: for each pseudo-label the view that gives it, the label, the text's hash, and both views of the document.
Given = list[tuple[int, int, int, np.ndarray, np.ndarray]]


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, give: Callable[[list[View], list[set[int]]], Given], rounds: int = ROUNDS) -> CoTrained | None:
    """Fits both views. y: 1 or 0; held: rows kept for calibration. None if a class has no rows in either part.

    In each round `give(models, taken)` names the unlabelled texts that each view is surest of (taken: hashes that a
    view has labels for already); the other view learns them.
    """
    fit = np.flatnonzero(~held)
    if len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    x, target, taken, kept = [v[fit] for v in views], [y[fit], y[fit]], [set(), set()], [v[held] for v in views]
    models = [View.fit(a, t, k, y[held]) for a, t, k in zip(x, target, kept, strict=True)]
    for _ in range(rounds):
        new = give(models, taken)
        for other in (0, 1):
            own = {h: (label, pair) for view, label, h, *pair in new if view != other}
            if own:
                taken[other] |= set(own)
                x[other] = np.vstack([x[other], *(pair[other][None] for _, pair in own.values())])
                target[other] = np.append(target[other], [label for label, _ in own.values()])
                models[other] = View.fit(x[other], target[other], kept[other], y[held])
        if not new:
            break
    both = np.stack([m.logits(k) for m, k in zip(models, kept, strict=True)], axis=1)
    return CoTrained(models, Logistic(penalty=1e-3).fit(_clipped(both), y[held]))


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> CoTrained | None:
    """A model of a bounded sample of labelled rows and of the pseudo-labels that all unlabelled documents give.

    The sample has the labelled keys of each class with the least hashes, `labelled_rows` at most; a key with labels that
    differ counts as unlabelled, a repeated one once. Both views of all documents are written once, about half a
    kilobyte each. In each round every document is scored; of the unlabelled ones that a view is sure of, the HANDED_ON
    surest texts for each label are handed on, ties by the text's hash, equal texts once. What is shuffled is an id, a
    hash and two numbers; what the driver sees is bounded by parameters, and no text is left out. Null texts and metadata
    count as empty.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_y"), F.max(label).alias("_z")).filter("_y = _z").drop("_z")
    hashed = docs.select(named(key).alias("_id"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("_h"), *_facts(docs, text))
    views = written(_views(hashed, ["_id", "_h"]), "views")
    pair = F.struct("_h", "_text_view", "_page_view")
    order = [F.xxhash64(F.lit(3), F.col("_id")), F.col("_id")]
    seen = views.filter("_id IS NOT NULL").select("_id").distinct()
    one = lambda y: clean.filter(f"_y = {y}").select(F.col("_key").alias("_id"), "_y").join(seen, "_id", "left_semi").orderBy(*order).limit(labelled_rows)
    wanted = F.broadcast(one(1).union(one(0)).select(F.col("_id").alias("_key"), "_y"))  # 2 * labelled_rows keys at most
    held = F.pmod(F.xxhash64(F.lit(5), F.col("_id")), F.lit(10)) < 3
    got = views.join(wanted, F.col("_id") == F.col("_key")).groupBy("_id", "_y").agg(F.min(pair).alias("v")).select("_y", held.alias("_held"), "v._text_view", "v._page_view", *(o.alias(f"_o{i}") for i, o in enumerate(order))).orderBy("_o0", "_o1").collect()
    if not got:
        return None
    stacked = [np.stack([np.frombuffer(r[c], np.uint8) for r in got]) for c in ("_text_view", "_page_view")]
    y, held_out = np.array([r["_y"] for r in got]), np.array([r["_held"] for r in got])

    def give(models: list[View], taken: list[set[int]]) -> Given:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = [np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("_text_view", "_page_view")]
                    p = np.stack([_sigmoid(m.logits(v)).astype(np.float64) for m, v in zip(models, x, strict=True)], axis=1)
                    sure = (np.maximum(p, 1 - p) >= CONFIDENCE).any(axis=1)
                    yield pd.DataFrame({"id": pdf["_id"][sure], "h": pdf["_h"][sure], "p0": p[sure, 0], "p1": p[sure, 1]})

        kind = views.schema["_id"].dataType.simpleString()
        scored = views.mapInPandas(frugal(run), f"id {kind}, h long, p0 double, p1 double")
        pool = scored.join(clean, scored["id"] == clean["_key"], "left_anti")
        each = [F.struct(F.lit(v).alias("view"), F.lit(t).alias("label"), (F.col(f"p{v}") if t else 1 - F.col(f"p{v}")).alias("sure"), F.col("h").isin(sorted(taken[1 - v])).alias("taken")) for v in (0, 1) for t in (0, 1)]
        found = pool.select("h", F.explode(F.array(*each)).alias("c")).select("h", "c.*").filter((F.col("sure") >= CONFIDENCE) & ~F.col("taken")).groupBy("view", "label", "h").agg(F.max("sure").alias("sure"))
        spread = Window.partitionBy("view", "label", F.pmod("h", F.lit(_SPREAD))).orderBy(F.desc("sure"), "h")
        rows = found.withColumn("k", F.row_number().over(spread)).filter(F.col("k") <= HANDED_ON).drop("k").collect()  # 4 * _SPREAD * HANDED_ON at most
        chosen = [(v, t, h) for v in (0, 1) for t in (0, 1) for _, h in sorted((-r["sure"], r["h"]) for r in rows if (r["view"], r["label"]) == (v, t))[:HANDED_ON]]
        if not chosen:
            return []
        facts = views.filter(F.col("_h").isin(sorted({h for *_, h in chosen}))).join(clean, F.col("_id") == F.col("_key"), "left_anti").groupBy("_h").agg(F.min(F.struct("_id", "_text_view", "_page_view")).alias("v")).select("_h", "v._text_view", "v._page_view").collect()
        known = {r["_h"]: [np.frombuffer(r[c], np.uint8) for c in ("_text_view", "_page_view")] for r in facts}
        return [(v, t, h, *known[h]) for v, t, h in chosen]

    return co_train(stacked, y, held_out, give, rounds)


def _facts(docs: DataFrame, text: str) -> list:
    have = set(docs.columns)
    column = lambda c, kind: (named(c) if c in have else F.lit(None)).cast(kind)
    return [named(text).alias("_body"), column("source", "string").alias("_source"), column("lang", "string").alias("_lang"), column("n_chars", "double").alias("_chars")]


def _pair(part: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    bodies = [(t or "").encode("utf-8", "surrogatepass") for t in part["_body"]]
    return [text_view(b) for b in bodies], [page_view(b, s, g, n) for b, s, g, n in zip(bodies, part["_source"], part["_lang"], part["_chars"], strict=True)]


def _views(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in runs(pdf, "_body"):
                a, b = _pair(part)
                yield part[keep].assign(_text_view=[x.tobytes() for x in a], _page_view=[x.tobytes() for x in b])

    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema if f.name in keep)
    return docs.mapInPandas(frugal(run), ddl + "_text_view binary, _page_view binary")


_SCORES = "text_score double, page_score double, score double"


def score_quality(docs: DataFrame, model: CoTrained | None, *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (all) with text_score, page_score and score. Without a model (too few labels) all are 1; columns of these names are replaced.

    A null text counts as empty; null metadata as empty too. Each row is scored by itself, from its whole text.
    """
    docs = docs.drop("text_score", "page_score", "score")
    rest = [f for f in docs.schema if columns is None or f.name in columns]
    carried = [f for f in rest if f.name != text]
    names = [f"c{i}" for i in range(len(carried))]  # neutral ones, as a name with a dot can't go through pandas

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in runs(pdf, "_body"):
                out = np.ones((len(part), 3))
                if model:
                    a, b = _pair(part)
                    out = model.scores(np.stack(a), np.stack(b))
                yield part[[*names, *(["_body"] if len(carried) < len(rest) else [])]].assign(text_score=out[:, 0], page_score=out[:, 1], score=out[:, 2])

    ddl = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, carried, strict=True)) + ("_body string, " if len(carried) < len(rest) else "")
    scored = docs.select(*(named(f.name).alias(n) for n, f in zip(names, carried, strict=True)), *_facts(docs, text)).mapInPandas(frugal(run), ddl + _SCORES)
    back = {f.name: n for n, f in zip(names, carried, strict=True)} | {text: "_body"}
    return scored.select(*(F.col(back[f.name]).alias(f.name) for f in rest), *(x.split()[0] for x in _SCORES.split(", ")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    kept = F.col("score") >= REJECT_BELOW
    return score_quality(docs, model, columns=["doc_id"]).select("doc_id", "text_score", "page_score", "score", kept.alias("kept"))

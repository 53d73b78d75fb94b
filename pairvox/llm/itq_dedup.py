"""Operator 7: near-duplicate vectors by iterative quantisation and multi-index Hamming tables, reranked by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import connected_components, frugal, table, written

#: Vectors that the rotation is fitted on, at most; steps of the fit; vectors of a block of a table's bucket; bits of a table at any size.
FIT_ROWS, FIT_STEPS, BLOCK, WIDTH = 8192, 40, 1500, 8
#: The share of planted pairs at the least cosine that tables must bring together, and rotations that may be needed for it.
RECALL, MOST_ROTATIONS = 0.995, 32


def fit_rotation(sample: np.ndarray, *, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes of unit vectors and the rotation that brings their signs closest to them.

    Each step quantises the rotated vectors to signs and solves the orthogonal Procrustes problem for the rotation.
    With fewer axes than bits, further bits come from random axes.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:bits]
    rotation = np.linalg.qr(rng.standard_normal((len(axes), len(axes))))[0]
    low = centred @ axes.T
    for _ in range(FIT_STEPS):
        u, _, v = np.linalg.svd(np.where(low @ rotation >= 0, 1.0, -1.0).T @ low)
        rotation = (u @ v).T
    projection = axes.T @ rotation
    if projection.shape[1] < bits:
        projection = np.hstack([projection, rng.standard_normal((sample.shape[1], bits - projection.shape[1]))])
    return mean, projection


def planted_recall(sample: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], *, min_cosine: float, bits: int, width: int, seed: int = 0) -> float:
    """The share of planted pairs that meet in a table: each sample vector and one at cosine min_cosine from it, in a random direction."""
    noise = np.random.default_rng(seed).standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    near = min_cosine * sample + np.sqrt(max(0.0, 1 - min_cosine**2)) * noise
    met = np.zeros(len(sample), bool)
    for mean, projection in models:
        met |= (_substrings((sample - mean) @ projection, bits, width) == _substrings((near - mean) @ projection, bits, width)).any(axis=1)
    return float(met.mean())


def enough_rotations(sample: np.ndarray, seeds: tuple[int, ...], *, min_cosine: float, bits: int, width: int) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """seeds with their rotations, and as many more as planted pairs need to meet at RECALL. ValueError where MOST_ROTATIONS aren't enough."""
    seeds = list(seeds)
    models = [fit_rotation(sample, bits=bits, seed=s) for s in seeds]
    while (recall := planted_recall(sample, models, min_cosine=min_cosine, bits=bits, width=width)) < RECALL and sample.shape[1] > 1:
        if len(seeds) >= MOST_ROTATIONS:
            raise ValueError(f"{len(seeds)} rotations of {bits} bits in tables of {width} find {recall:.3f} of planted pairs: set a smaller width or more bits")
        seeds.append(max(seeds) + 1)
        models.append(fit_rotation(sample, bits=bits, seed=seeds[-1]))
    return seeds, models


def _substrings(values: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The signs of each row in groups of `width`, as numbers."""
    size = -(-width // 8)
    packed = np.packbits((values >= 0)[:, : bits // width * width].reshape(len(values), -1, width), axis=2, bitorder="little")
    return packed.reshape(len(values), -1, size).astype(np.int64) @ (1 << 8 * np.arange(size))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame, *, min_cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", bits: int = 64, width: int | None = None, seeds: tuple[int, ...] = (7,), block: int = BLOCK
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row. Only vectors with the same label, not null, are compared.

    Equal vectors are one class. Each class gets a code of `bits` signs for each seed's rotation, cut into substrings of
    `width` bits (8 unless given, at any size of the input); a table for each substring brings together classes that
    agree in it, so codes that differ in fewer bits than there are tables always meet. Pairs that meet are compared by cosine
    in double precision, a pair in the first table where it meets alone. A bucket with more than `block` vectors is cut
    into blocks whose pairs are tasks of their own, so nothing is left out. Links are counted in place, and each task
    hands on a spanning forest of them.

    The rotations are fitted on FIT_ROWS vectors at most, of the commonest dimension. Pairs at min_cosine are planted
    around these, and rotations (with tables of their own) are added until RECALL of them meet: vectors that share a
    direction need more, as less is left of them to tell them apart by. If MOST_ROTATIONS don't do, it is an error. Vectors of another dimension get
    their codes from random axes and meet their like only. Vectors are scaled by their largest part first, so very large
    and very small ones neither overflow nor vanish.

    Vectors that are null, zero or hold null or non-finite parts, and those without a label, link with nothing. A row
    whose key is null gets nulls. Repeated rows are vectors of their own; ties of cosines don't matter, since all pairs
    that reach min_cosine are links. Other columns don't come along, so theirs can't clash.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    same = ["label", "h1", "h2"]
    hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    classes = hashed.filter("ok").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("count"), F.first("v").alias("v"))
    classes = written(classes, "vectors")
    size = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return _result(hashed, None, key)
    sample = classes.filter(F.size("v") == size["d"]).orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("v").toPandas()["v"]
    unit = _unit(np.stack([np.asarray(x, np.float64) for x in sample]))
    width = width or WIDTH
    seeds, models = enough_rotations(unit, seeds, min_cosine=min_cosine, bits=bits, width=width)
    n_tables = bits // width * len(models)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in pdf.groupby(pdf["v"].map(len)):
                x = _unit(np.stack(own["v"].to_list()))
                parts = []
                for mean, projection in models if d == size["d"] else [(0, np.random.default_rng([s, d]).standard_normal((d, bits))) for s in seeds]:
                    parts.append(_substrings((x - mean) @ projection, bits, width))
                yield own.assign(code=list(np.hstack(parts)))

    coded = classes.select("label", "rep", "count", "v")
    ddl = f"label {classes.schema['label'].dataType.simpleString()}, rep long, count long, v array<double>, code array<long>"
    coded = written(coded.mapInPandas(frugal(encode), ddl), "codes")
    bucket = F.xxhash64("label", F.size("v"), "t", "value").alias("bucket")
    met = coded.select(F.posexplode("code").alias("t", "value"), "label", "v").select(bucket)
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    placed = coded.select("*", F.posexplode("code").alias("t", "value")).withColumn("bucket", bucket).join(sizes, "bucket")
    blocks = F.expr(f"cast((size + {block - 1}) div {block} AS int)")
    placed = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    n_tasks = max(1, n_tables * coded.count() // 20_000)
    pair = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    jobs = placed.select(
        F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(n_tasks))).otherwise(F.col("bucket")).alias("task"),
        pair["i"].alias("i"), pair["j"].alias("j"), "bucket", "label", "t", "own", "rep", "count", "v", "code",
    )
    found = written(jobs.groupBy("task", "i", "j").applyInPandas(lambda pdf: _compare(pdf, min_cosine), "a long, b long, links long"), "links")
    return _result(hashed, (classes, found), key)


def _compare(pdf: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """For the buckets of a task: rows (a, null, links of a found here, by their classes' sizes) and (a, b, null) of a spanning forest."""
    out: list[tuple] = []
    for _, own in pdf.groupby([pdf["bucket"], pdf["label"], pdf["t"], pdf["v"].map(len)], sort=False):
        own = own.drop_duplicates("rep")
        if len(own) < 2:
            continue
        x = _unit(np.stack(own["v"].to_list()))
        link = x @ x.T >= min_cosine
        np.fill_diagonal(link, False)
        side = own["own"].to_numpy()
        if side.min() != side.max():  # two blocks: pairs of one block alone are another task's
            link &= side[:, None] != side[None, :]
        elif own["i"].iloc[0] != own["j"].iloc[0]:
            continue
        a, b = np.nonzero(link)
        code, t = np.stack(own["code"].to_list()), int(own["t"].iloc[0])
        if not len(a):
            continue
        if t:
            first = np.ones(len(a), bool)
            for begin in range(0, len(a), 1 << 18):
                s = slice(begin, begin + (1 << 18))
                first[s] = (code[a[s], :t] != code[b[s], :t]).all(axis=1)  # they didn't meet before
            a, b = a[first], b[first]
        reps, counts = own["rep"].to_numpy(np.int64), own["count"].to_numpy(np.int64)
        total = np.bincount(a, weights=counts[b], minlength=len(own)).astype(np.int64)
        out += [(int(reps[i]), None, int(total[i])) for i in np.flatnonzero(total)]
        root = list(range(len(own)))

        def find(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a[a < b].tolist(), b[a < b].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[q] = p
                out.append((int(reps[i]), int(reps[j]), None))
    return pd.DataFrame({"a": pd.array([r[0] for r in out], "Int64"), "b": pd.array([r[1] for r in out], "Int64"), "links": pd.array([r[2] for r in out], "Int64")})


def _result(hashed: DataFrame, found: tuple | None, key: str) -> DataFrame:
    if found is None:
        alone = hashed.select(F.col("id").alias(key), F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    else:
        classes, links = found
        components = connected_components(links.filter("b IS NOT NULL").select("a", "b"))
        counts = links.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
        per_class = classes.join(components, classes["rep"] == components["node"], "left").join(counts, classes["rep"] == counts["a"], "left")
        per_class = per_class.select(
            *(F.col(c).alias(f"_{c}") for c in ("label", "h1", "h2")),
            (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
        on = F.col("ok") & (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
        alone = hashed.select("id", "ok", "label", "h1", "h2").join(per_class, on, "left")
        alone = alone.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component_id", "id").alias("component_id"))
    nameless = F.col(key).isNull()
    return alone.select(key, F.when(~nameless, F.col("links")).alias("n_links"), "component_id", (F.col(key) == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM e LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

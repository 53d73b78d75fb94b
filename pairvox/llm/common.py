"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that a task contracts at once, and links from which on the rounds go on in one such step (2 MB).
LINKS_AT_ONCE, FEW_LINKS = 1 << 18, 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> F.Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame) -> str:
    """A beginning for names of a step's own columns that no column of df has."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one for a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage ends here, and a lost executor costs nothing already done."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: columns can be pruned when it is read several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_given_back = 0.0


def give_back() -> None:
    """Hands memory that this worker has freed back to the system, once a second at most: Spark keeps workers for later stages."""
    global _given_back
    if time.monotonic() - _given_back > 1:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # other C libraries decide for themselves
        _given_back = time.monotonic()


def frugal(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives freed memory back at the end of its task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        give_back()

    return wrapped


def arrow_runs(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], pa.Array], limit: int) -> Iterator[pa.RecordBatch]:
    """Row runs of Arrow batches, of about `limit` units each; a null counts as none."""
    for batch in batches:
        at = np.cumsum(pa.compute.fill_null(size(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8_bytes(text) -> F.Column:
    """Bytes of a text, a null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) with the same components as the links (a, b); nodes that are smallest themselves are left out."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for i, j in zip(of[: len(a)].tolist(), of[len(a) :].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i < j:
            parent[j] = i
        else:
            parent[i] = j
    root = np.array(parent, np.int64)
    while (root[root] != root).any():
        root = root[root]
    k = np.flatnonzero(root != np.arange(len(root)))
    return nodes[k], nodes[root[k]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= LINKS_AT_ONCE:
            u, v = forest(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in ("u", "v")))
            held = []
            yield pd.DataFrame({"u": u, "v": v})
    if held:
        u, v = forest(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in ("u", "v")))
        yield pd.DataFrame({"u": u, "v": v})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, few: int = FEW_LINKS) -> DataFrame:
    """(node, component): component is the smallest node reachable by links.

    Each task first contracts distinct links of its own to stars. Then large-star and small-star contraction alternate: every step
    is a map-side combined minimum and a join on the node, so a node with very many links needs no list of them in one
    place. Links shrink to stars, each round is checkpointed, and only a count and a checksum reach the driver. Once
    `few` links or less are left (a fixed bound, not a share of the input), one task contracts them in one step, which
    saves the last rounds and changes no result. An empty table gives an empty table.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct()
    e = cut(e.mapInPandas(frugal(_contract), "u long, v long"))  # links are dealt out anew before, so no task has two Python workers
    now, before = _sum(e), None
    while now != before and now[0]:
        if now[0] <= few:
            e = cut(e.coalesce(1).mapInPandas(frugal(_contract), "u long, v long"))
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(e.filter("u <> v").distinct())
        before, now = now, _sum(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

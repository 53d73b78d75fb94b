"""Operator 9: documents whose sets of word shingles are alike, by a grouped prefix join."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import connected_components, give_back, table, written
from pairvox.llm.hashing import sequence_hash, word_hashes
from pairvox.llm.repeated import documents_with_keys, homes, key_bits, unpacked_list

#: Documents of a block; a cluster with more is split into blocks, and each pair of blocks is a task of its own.
BLOCK = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(row of each shingle, 64-bit shingle hash), distinct in a row, and for each row (set size, 128-bit digest of the set in two halves)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    data, space = _LOWER[data], _SPACE[data]
    before = np.append(True, space[:-1])
    starts = np.flatnonzero(~space & before)
    stops = np.flatnonzero(space & ~before)
    words = word_hashes(data, starts, stops)
    row = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(row, minlength=len(texts))
    runs, own = sequence_hash(words, width), row[: max(0, len(row) - width + 1)]
    whole = own == row[width - 1 :] if len(own) else np.zeros(0, bool)
    hashes, rows = [runs[whole]], [own[whole]]
    begin = np.cumsum(counts) - counts
    for n in range(1, width):  # short texts: the whole sequence is one
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(np.concatenate([sequence_hash(words[b : b + n], n) for b in begin[short]]))
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
    h, r = h[keep], r[keep]
    sizes = np.bincount(r, minlength=len(texts))
    cuts = np.append(0, np.cumsum(sizes)).tolist()
    facts = []
    for i, n in enumerate(sizes.tolist()):
        digest = np.frombuffer(hashlib.blake2b(h[cuts[i] : cuts[i + 1]].tobytes(), digest_size=16).digest(), np.int64)
        facts.append((n, int(digest[0]), int(digest[1])))
    return r, h, facts


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) for every row: two documents link when 100 * intersection >= percent * union of their shingle sets.

    1. A packed exchange tells each document which of its shingles others hold too. A document that holds fewer
       repeated ones than percent of its set can link with nothing; it is done. Intersections consist of repeated
       shingles alone, so no full set is needed again.
    2. Equal sets are one class. Its shingles are ordered the same way everywhere: those of one document first, then by how
       common they are, then by hash; documents with equal prefixes and sizes form a group, and only groups enter the prefix index.
    3. Groups that share a prefix shingle are joined into clusters (stars, then contraction). In blocks of a cluster, of
       bounded size, group pairs are filtered by prefix and size; the members of those that are left are verified
       by their whole lists of repeated shingles, each a hash of 38 bits or more (with the number of documents), but for members that links have reached already; each block hands on a spanning forest of its links.
       The forests' components are the result.

    A null text counts as empty; a document without words has an empty set and is a component of its own. Documents
    with the same id are one node. A row whose id is null gets nulls. Only counts reach the driver.
    """
    spark = docs.sparkSession
    nameless, docs = docs.filter(F.col(key).isNull()), docs.filter(F.col(key).isNotNull())
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    enough = lambda n: np.maximum(1, (n * percent + 99) // 100)  # of n shingles so many are in any intersection that suffices
    rows = documents_with_keys(docs, lambda texts: shingle_sets(texts, width), bits=key_bits(total), n_homes=homes(total, size), least=enough, key=key, text=text)
    rows = written(rows, "shingles")
    facts = rows.select("doc_id", "n", "digest_a", "digest_b")
    classes = facts.filter("n > 0").groupBy("n", "digest_a", "digest_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))

    tokens = rows.filter("keys IS NOT NULL").groupBy("doc_id").agg(F.max("keys").alias("keys"), F.max("lead").alias("prefix"))
    members = classes.join(tokens, classes["rep"] == tokens["doc_id"])
    members = written(members.select("rep", "n", "keys", F.xxhash64("n", "prefix").alias("grp"), "prefix"), "members")

    groups = members.groupBy("grp").agg(F.min("rep").alias("gid"))
    index = members.join(groups, "grp").filter("rep = gid").select("gid", F.explode("prefix").alias("token"))
    heads = index.groupBy("token").agg(F.min("gid").alias("head"), F.max("gid").alias("tail")).filter("head <> tail").select("token", "head")
    stars = index.join(heads, "token").filter("gid <> head").select(F.col("gid").alias("a"), F.col("head").alias("b")).distinct()
    clusters = connected_components(stars).withColumnRenamed("node", "gid")

    located = members.select("rep", "n", "grp").join(groups, "grp").join(clusters, "gid", "left").withColumn("cluster", F.coalesce("component", "gid"))
    sizes = located.groupBy("cluster").agg(F.count("*").alias("size")).filter("size > 1")
    located = written(located.join(sizes, "cluster").select("cluster", "size", "rep", "gid", "n"), "clusters")
    n_tasks = max(1, located.count() // 1000)
    located = located.withColumn("blocks", F.expr(f"cast((size + {block - 1}) div {block} AS int)"))
    located = located.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(members.select("rep", "keys"), "rep")
    located = located.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(n_tasks))).otherwise(F.xxhash64("cluster", pair))
    jobs = located.select(task.alias("task"), "cluster", "rep", "gid", "n", "keys", "own", pair["i"].alias("i"), pair["j"].alias("j"))
    links = jobs.groupBy("task", "i", "j").applyInPandas(lambda pdf: _forest(pdf, percent), "a long, b long")
    components = connected_components(links)

    linked = classes.join(components, classes["rep"] == components["node"], "left").select(
        *(F.col(c).alias(f"_{c}") for c in ("n", "digest_a", "digest_b")), F.coalesce("component", "rep").alias("component")
    )
    same = (F.col("n") == F.col("_n")) & (F.col("digest_a") == F.col("_digest_a")) & (F.col("digest_b") == F.col("_digest_b"))
    found = facts.join(linked, same, "left").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    none = F.lit(None).cast("long")
    return found.union(nameless.select(none, none, none))


def _forest(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links within each cluster of a task, or between two blocks of one."""
    give_back()
    edges: list[tuple[int, int]] = []
    for _, own in pdf.groupby("cluster", sort=False):
        own = own.drop_duplicates("rep").sort_values("rep")
        i, j = own["i"].iloc[0], own["j"].iloc[0]
        sides = (own, own) if i == j else (own[own["own"] == i], own[own["own"] == j])
        if len(own) > 1 and len(sides[0]) and len(sides[1]):
            edges += _links(*sides, percent, i == j)
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


class _Side:
    """Members of a block: their sets as numbers from 0, and an index from prefix tokens to groups (rows with equal prefix and size)."""

    def __init__(self, rows: pd.DataFrame, percent: int) -> None:
        self.reps, self.sizes = rows["rep"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        sets = [unpacked_list(x) for x in rows["keys"]]
        counts = np.array([len(x) for x in sets])
        self.flat, self.begin = np.concatenate(sets), np.append(0, np.cumsum(counts))
        gid, self.group = np.unique(rows["gid"].to_numpy(np.int64), return_inverse=True)
        self.lead = np.zeros(len(gid), np.int64)
        self.lead[self.group] = np.arange(len(rows))
        self.prefix = counts - np.maximum(1, (self.sizes * percent + 99) // 100) + 1

    def number(self, universe: np.ndarray) -> None:
        self.flat = np.searchsorted(universe, self.flat).astype(np.int32)
        own = [self.flat[self.begin[k] : self.begin[k] + self.prefix[k]] for k in self.lead]
        tokens, groups = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.groups = tokens[order], groups[order]

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.begin[i] : self.begin[i + 1]]

    def groups_for(self, prefix: np.ndarray, size: int, percent: int) -> np.ndarray:
        """For each group, whether it shares a token with the prefix and its size may suffice."""
        low, high = np.searchsorted(self.tokens, prefix), np.searchsorted(self.tokens, prefix, side="right")
        out = np.zeros(len(self.lead), bool)
        out[self.groups[_ranges(low, high)]] = True
        sizes = self.sizes[self.lead]
        return out & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    times = high - low
    return np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))


def _shared(side: _Side, rows: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How many marked tokens each of the rows has: the verification of one member against others."""
    held = marked[side.flat[_ranges(side.begin[rows], side.begin[rows + 1])]]
    sums = np.append(0, np.cumsum(held))
    ends = np.cumsum(side.begin[rows + 1] - side.begin[rows])
    return sums[ends] - np.append(0, sums[ends[:-1]])


def _links(left: pd.DataFrame, right: pd.DataFrame, percent: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links. From each member on, the groups that survive the filters are expanded, and those members of them are verified that no link has reached yet."""
    sides = [_Side(left, percent)]
    sides.append(sides[0] if same else _Side(right, percent))
    universe = np.unique(np.concatenate([x.flat for x in sides[: 2 - same]]))
    for x in sides[: 2 - same]:
        x.number(universe)
    fresh = [np.ones(len(x.reps), bool) for x in sides]
    if same:
        fresh[1] = fresh[0]
    marked = np.zeros(len(universe), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(sides[0].reps)):
        if not fresh[0][root]:
            continue
        fresh[0][root] = False
        stack = [(0, root)]
        while stack:
            s, i = stack.pop()
            own, other = sides[s], sides[1 - s]
            if not fresh[1 - s].any():
                continue
            found = np.flatnonzero(fresh[1 - s] & other.groups_for(own.row(i)[: own.prefix[i]], own.sizes[i], percent)[other.group])
            if not len(found):
                continue
            marked[own.row(i)] = True
            both = _shared(other, found, marked)
            marked[own.row(i)] = False
            found = found[100 * both >= percent * (own.sizes[i] + other.sizes[found] - both)]
            fresh[1 - s][found] = False
            edges += [(int(own.reps[i]), int(other.reps[k])) for k in found]
            stack += [(1 - s, int(k)) for k in found]
    return edges


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


#: Words by place, shingles of neighbours, pairs from an inverted index, components by reach.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS shingle FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, shingle FROM q WHERE i + 3 <= n OR n < 4 AND i = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

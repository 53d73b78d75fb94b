"""Operator 11: the prefix trie of conversations, from sorted sequences and range minima over their common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import give_back, named, table, written

#: Characters of a turn's digest in a key: 15 bytes of SHA-256 in base 64.
DIGEST = 20
#: Rows and prefixes (turns and one a row) that are handled at once; prefixes or rows at the edges with which one task ends the work; ids of a piece.
CHUNK_ROWS, CHUNK_PREFIXES, FEW_PREFIXES, LAST_ROWS, PIECE_IDS = 50_000, 1_000_000, 500_000, 16, 200

#: What a task says: nodes that no other chunk can add to; the edges of its chunk, with what they hold at every depth; ids of members that end at an edge's prefix.
FOUND = pa.schema(
    [("kind", pa.string()), ("id", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_id", pa.binary()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("key", pa.string()), ("words", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("members", "least", "children", "leaves", "saved")]
)
_DDL = "kind string, id binary, conv_id long, depth long, parent_id binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key string, words array<long>, members array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>"
_INFO = ("members", "least", "children", "leaves", "saved")
_NEVER = np.iinfo(np.int64).max


def spoken(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>): each conversation in the order of its turns, null first; turns of equal number in the order of their digests.

    A null role or text counts as empty. Rows without a conversation id belong to none and are left out. Texts don't
    move: a turn is a digest of 120 bits and a count of words from here on.
    """
    role, text = (F.coalesce(named(c), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(whole, 256), 1, 30)
    one = F.struct(named(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = conversations.select(named(conv).cast("long").alias("conv_id"), one.alias("one")).filter("conv_id IS NOT NULL")
    turns = F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(F.base64(F.unhex(t["digest"])).alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def with_heads_of(convs: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Conversations that begin with the first `taken` turns of conversation `base` (all if it has fewer, none if it is absent) and go on with their own after as many."""
    heads = convs.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_head"))
    both = convs.withColumns({"_of": base, "_taken": taken.cast("int")}).join(heads, F.col("_of") == F.col("_base"), "left")
    none = F.slice("turns", 1, F.lit(0))
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_taken"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("_taken") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_trie(convs: DataFrame, *, chunk_rows: int = CHUNK_ROWS, few: int = FEW_PREFIXES) -> DataFrame:
    """Nodes of the trie of convs (conv_id, turns), one for each distinct sequence of first turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is named by its
    smallest member. The root, of depth 0, holds all conversations, those without turns too; an empty table has no node.

    1. A conversation's key is its turns' digests in a row. Keys are sorted in ranges, equal ones by id, so a sequence
       that a third of all conversations share is cut like any other; members of a prefix stand side by side.
    2. In a chunk of a range the common prefixes of neighbours get a table of minima over 1, 2, 4, ... of them. Every
       prefix of every row finds its first and its last member there by halving steps, on its own; what begins at a row
       itself is a node. Sums over a node's rows and subtree are exact unless it reaches the chunk's edge.
    3. Nodes that reach an edge are prefixes of the first or the last row of a chunk. These rows go on, with what is
       known at every depth, and are sorted and joined alike among themselves, until few are left for one task.
    4. Ids of members that end in such a node are hashed in order, in pieces; other nodes' ids are hashed where they lie.

    A task holds one chunk. A conversation's digests (20 bytes a turn) lie in one row, and turns of the same
    conversation must have been gathered for that; nothing else grows with a conversation or a node.
    """
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = written(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    rows = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    steps = [written(rows.mapInArrow(_task(chunk_rows, last=False), _DDL), "trie")]
    while True:
        edges = steps[-1].filter("kind = 'edge'")
        n, prefixes = edges.agg(F.count("*"), F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()
        if not n:
            break
        edges = edges.select("key", "words", *_INFO)
        last = prefixes <= few or n <= LAST_ROWS
        edges = edges.coalesce(1) if last else edges.repartitionByRange(min(prefixes // few, n // LAST_ROWS) + 1, "key")
        steps.append(written(edges.sortWithinPartitions("key").mapInArrow(_task(chunk_rows, last=last), _DDL), "trie"))
        if last:
            break
    return _nodes(steps)


def _nodes(steps: list[DataFrame]) -> DataFrame:
    """The nodes of all steps, with parents and ends that another step has found."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    first = steps[0].filter("kind = 'node'").select("id", "parent_id", *columns, "ends")
    if len(steps) == 1:
        return first.select(*columns, F.col("ends").alias("ends_sha256"))
    later = steps[1]
    for s in steps[2:]:
        later = later.union(s)
    later = later.filter("kind = 'node'")
    pieces = steps[0].filter("kind = 'ends'").select("id", "conv_id", "ends")
    hashed = pieces.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(_hashed, "id binary, ends string")
    later = later.drop("ends").join(hashed, "id", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256))).select("id", "parent_id", *columns, "ends")
    parents = later.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    open_ = first.filter("parent_id IS NOT NULL").union(later.filter("parent_id IS NOT NULL")).join(parents, "parent_id", "left").withColumn("parent_conv_id", F.col("_parent"))
    done = first.filter("parent_id IS NULL").union(later.filter("parent_id IS NULL"))
    return open_.select(*columns, "ends").union(done.select(*columns, "ends")).withColumnRenamed("ends", "ends_sha256")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each id's pieces, which come in order, joined by commas."""
    now, state, out = None, None, []
    for batch in batches:
        for i, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if i == now:
                state.update(b",")
            else:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = i, hashlib.sha256()
            state.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.binary()), (1, pa.string()))], ["id", "ends"])
            out = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends"])


def _task(chunk_rows: int, last: bool):
    """Cuts a sorted partition into chunks; the last step has one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, prefixes = [], 0, 0
        for batch in batches:
            for at in range(0, len(batch), min(1000, chunk_rows)):
                part = batch.slice(at, min(1000, chunk_rows))
                held.append(part)
                rows += len(part)
                prefixes += len(part) + sum(map(len, part.column("key").to_pylist())) // DIGEST
                if not last and rows > 8 and (rows >= chunk_rows or prefixes >= CHUNK_PREFIXES):
                    yield from Chunk(pa.Table.from_batches(held), last).found()
                    held, rows, prefixes = [], 0, 0
        if rows:
            yield from Chunk(pa.Table.from_batches(held), last).found()
        give_back()

    return run


def minima(x: np.ndarray) -> list[np.ndarray]:
    """A sparse table: entry k, i is the minimum of 2^k values from i on."""
    out = [x]
    while 2 << len(out) - 1 <= len(x):
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last row that share `depth` turns with each row; lcp[i] is what rows i and i + 1 share."""
    levels = minima(lcp)
    first, last = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, least = 1 << k, levels[k]
        if not len(least):
            continue
        go = last + step <= len(lcp)
        go &= least[np.minimum(last, len(least) - 1)] >= depth
        last[go] += step
        go = first - step >= 0
        go &= least[np.maximum(first - step, 0)] >= depth
        first[go] -= step
    return first, last


class Chunk:
    """Some rows in a row of the sorted order, their prefixes and nodes."""

    def __init__(self, rows: pa.Table, last: bool) -> None:
        self.last = last
        keys = rows["key"].to_pylist()
        self.keys, m = keys, len(keys)
        self.lengths = lengths = np.array([len(k) // DIGEST for k in keys], np.int64)
        self.turns = np.frombuffer("".join(keys).encode(), f"S{DIGEST}") if lengths.sum() else np.zeros(0, f"S{DIGEST}")
        self.turn_at = np.cumsum(lengths) - lengths
        self.lcp = self.common()
        self.at = np.cumsum(lengths + 1) - lengths - 1  # where a row's prefixes begin, the empty one first
        row = np.repeat(np.arange(m), lengths + 1)
        depth = np.arange(len(row)) - np.repeat(self.at, lengths + 1)
        first, last_row = extents(self.lcp, row, depth)
        order = np.argsort(depth, kind="stable")  # the rows of a node stand side by side in it
        leads = (first == row)[order]
        starts = np.flatnonzero(leads)
        self.of = np.empty(len(row), np.int64)  # the node of each prefix
        self.of[order] = np.cumsum(leads) - 1
        lead = order[starts]
        self.row, self.depth, end = row[lead], depth[lead], last_row[lead]
        self.parent = np.where(self.depth > 0, self.of[np.maximum(lead - 1, 0)], -1)
        self.closed = np.full(len(lead), True) if last else (self.row > 0) & (end < m - 1)
        words = np.concatenate([np.zeros(0, np.int64), *(c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in rows["words"].chunks)])
        own_words = np.where(self.depth > 0, words[np.minimum(self.turn_at[self.row] + self.depth - 1, max(0, len(words) - 1))] if len(words) else 0, 0)
        if "conv_id" in rows.column_names:
            self.ids = rows["conv_id"].to_numpy()
            self.members, self.least = (np.add.reduceat(np.ones(len(row), np.int64), starts), np.minimum.reduceat(self.ids[row][order], starts))
            self.children = np.zeros(len(lead), np.int64)
            self.leaves, self.saved = self.children.copy(), self.children.copy()
        else:
            self.ids = None
            told = {c: np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in rows[c].chunks])[order] for c in _INFO}
            self.members, self.children, self.leaves, self.saved = (np.add.reduceat(told[c], starts) for c in ("members", "children", "leaves", "saved"))
            self.least = np.minimum.reduceat(told["least"], starts)
        self.words = words
        closed_child = np.flatnonzero(self.closed & (self.depth > 0))
        self.children += np.bincount(self.parent[closed_child], minlength=len(lead))
        self.leaves[self.closed & (self.children == 0)] += 1
        self.saved[self.closed] += ((self.members - 1) * own_words)[self.closed]
        cuts = np.searchsorted(self.depth, np.arange(self.depth.max() + 2))
        for d in range(len(cuts) - 2, 0, -1):  # subtrees, from the deepest nodes up
            own = np.arange(cuts[d], cuts[d + 1])
            own = own[self.closed[own]]
            np.add.at(self.leaves, self.parent[own], self.leaves[own])
            np.add.at(self.saved, self.parent[own], self.saved[own])

    def common(self) -> np.ndarray:
        """How many first turns each row shares with the next."""
        least = np.minimum(self.lengths[:-1], self.lengths[1:])
        pair = np.repeat(np.arange(len(least)), least)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(least) - least, least)
        differ = self.turns[self.turn_at[pair] + place] != self.turns[self.turn_at[pair + 1] + place]
        out = least.copy()
        np.minimum.at(out, pair[differ], place[differ])
        return out

    def path(self, row: int) -> list[bytes]:
        """Names of a row's prefixes."""
        state, out = hashlib.sha256(), []
        for d in range(self.lengths[row] + 1):
            if d:
                state.update(self.keys[row][(d - 1) * DIGEST : d * DIGEST].encode())
            out.append(state.copy().digest()[:16])
        return out

    def found(self) -> Iterator[pa.RecordBatch]:
        m = len(self.keys)
        edges = [0] if self.last or m == 1 else [0, m - 1]
        name: dict[int, bytes] = {}
        for row in range(m) if self.ids is None else edges:
            nodes = self.of[self.at[row] : self.at[row] + self.lengths[row] + 1].tolist()
            for node, x in zip(nodes, self.path(row), strict=True):
                name[node] = x
        pieces: list[tuple[bytes, int, str]] = []
        if self.ids is not None:
            ends = [_EMPTY] * len(self.row)
            whole = self.lcp == np.maximum(self.lengths[1:], self.lengths[:-1])  # the same sequence again
            begins = np.flatnonzero(np.append(True, ~whole))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), m], strict=True):
                node = int(self.of[self.at[a] + self.lengths[a]])
                own = self.ids[a:b].tolist()
                if self.closed[node]:
                    ends[node] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
                else:
                    pieces += [(name[node], own[k], ",".join(map(str, own[k : k + PIECE_IDS]))) for k in range(0, len(own), PIECE_IDS)]
        k = np.flatnonzero(self.closed)
        if len(k):
            up = self.parent[k]
            known = (up >= 0) & self.closed[np.maximum(up, 0)]
            yield _batch(
                len(k), "node", id=pa.array([name.get(x) for x in k.tolist()], pa.binary()), conv_id=self.least[k], depth=self.depth[k],
                parent_id=pa.array([None if i or u < 0 else name[u] for i, u in zip(known.tolist(), up.tolist(), strict=True)], pa.binary()),
                parent_conv_id=pa.array(self.least[np.maximum(up, 0)], mask=~known), n_convs=self.members[k], n_children=self.children[k], n_leaves=self.leaves[k],
                saved_tokens=self.saved[k], **({"ends": pa.array([ends[x] for x in k.tolist()], pa.string())} if self.ids is not None else {}),
            )
        if not self.last:
            out: dict[str, list] = {c: [] for c in ("key", "words", *_INFO)}
            for row in edges:
                nodes = self.of[self.at[row] : self.at[row] + self.lengths[row] + 1]
                mine = (self.row[nodes] > 0) | (row == 0)  # prefixes of the first row too stand there
                if mine.any():
                    out["key"].append(self.keys[row])
                    out["words"].append(self.words[self.turn_at[row] : self.turn_at[row] + self.lengths[row]])
                    for c in _INFO:
                        out[c].append(np.where(mine, getattr(self, c)[nodes], _NEVER if c == "least" else 0))
            yield _batch(len(out["key"]), "edge", **{c: pa.array(x, FOUND.field(c).type) for c, x in out.items()})
        if pieces:
            yield _batch(len(pieces), "ends", id=pa.array([x[0] for x in pieces], pa.binary()), conv_id=pa.array([x[1] for x in pieces], pa.int64()), ends=pa.array([x[2] for x in pieces]))


_EMPTY = hashlib.sha256().hexdigest()


def _batch(n: int, kind: str, **columns) -> pa.RecordBatch:
    given = {"kind": pa.array([kind] * n)} | {c: x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in FOUND], schema=FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = written(spoken(table(spark, sf_dir, "conversations")), "spoken")
    c = F.col("conv_id")
    return prefix_trie(with_heads_of(convs, base=c - c % 20, taken=F.crc32(c.cast("string").cast("binary")) % 4))


#: Prefixes as lists of turns; subtrees by the prefixes of each node's list. CRC-32 bit by bit, as DuckDB has none.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text, 'words': words} ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
crc AS (SELECT i, list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)),
lut AS (SELECT list(v ORDER BY i) AS v FROM crc),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, lut.v[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM o, lut),
s AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
x AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
y AS (SELECT conv_id, depth, len(turns) = depth AS ends, turns[:depth] AS path, turns[:depth - 1] AS up FROM x),
n AS (SELECT path, depth, min(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM y GROUP BY path, depth),
p AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.up = n.path) AS n_children FROM n LEFT JOIN n p ON p.path = n.up AND p.depth = n.depth - 1),
z AS (SELECT unnest(range(depth + 1)) AS top, path, depth, n_children = 0 AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * path[depth].words ELSE 0 END AS saved FROM p),
w AS (SELECT path[:top] AS path, top AS depth, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM z GROUP BY 1, 2)
SELECT p.conv_id, p.depth, p.parent_conv_id, p.n_convs, p.n_children, w.n_leaves::BIGINT AS n_leaves, w.saved_tokens::BIGINT AS saved_tokens, p.ends_sha256 FROM p JOIN w ON w.depth = p.depth AND w.path = p.path
"""

"""Operator 8: byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, table
from pairvox.llm.repeated import runs

#: Pre-tokens of a cache generation, and characters that are encoded at once: memory is bounded, results are the same.
CACHE_ENTRIES, RUN_CHARS = 200_000, 2_000_000


class RankQueue:
    """Waiting merges, ordered by rank and then by place.

    A bucket for each rank holds list positions. Three levels of 64-bit words say which buckets hold any: a set bit at
    one level stands for a word that isn't zero at the level below, so the lowest rank is found by three
    find-first-set steps, however many merges wait.
    """

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, place: int) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def lowest(self) -> int:
        """The lowest rank with entries, or -1."""
        if not (top := self.top):
            return -1
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The places of a bucket in order; the bucket is taken out of all levels."""
        bucket = self.buckets.pop(rank)
        bucket.sort()
        a, b = rank >> 6, rank >> 12
        if word := self.low[a] & ~(1 << (rank & 63)):
            self.low[a] = word
            return bucket
        del self.low[a]
        if word := self.mid[b] & ~(1 << (a & 63)):
            self.mid[b] = word
            return bucket
        del self.mid[b]
        self.top &= ~(1 << b)
        return bucket


class BytePairEncoder:
    """Encodes and decodes by a table of ranks, bytes to rank, as byte-level BPE does: the lowest rank merges first, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of two tokens in a row that make a token, by their ranks."""
        ranks = self.ranks
        return {a << 32 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All of them stand in one list, with walls between, and share one queue."""
        rank_of, joint = self.ranks.get, self.pairs.get
        data = b"".join(pieces)
        n = len(data)
        wall = bytearray(n + 1)
        at = 0
        for p in pieces:
            wall[at] = 1
            at += len(p)
        wall[n] = 1
        end = list(range(1, n + 1))  # where the part that begins at a place ends; parts are linked by end and before
        before = list(range(-1, n))
        letters = np.frombuffer(data, np.uint8)
        ids = self.single[letters].tolist()
        first = self.double[letters[:-1].astype(np.int64) << 8 | letters[1:]] if n else letters.astype(np.int64)
        first[np.frombuffer(wall, np.uint8)[1:n] > 0] = -1
        wants = [*first.tolist(), -1]  # the rank at which a part would merge with the next one
        queue = RankQueue()
        buckets, push = queue.buckets, queue.push
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")]
        cuts = [*np.flatnonzero(np.diff(first[waiting], prepend=-1)).tolist(), len(waiting)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            push(wants[waiting[a]], 0)
            buckets[wants[waiting[a]]][:] = waiting[a:b].tolist()
        while (r := queue.lowest()) >= 0:
            bucket = queue.take(r)
            for k, i in enumerate(bucket):
                if wants[i] != r:
                    continue  # stale: a neighbour has merged since
                j = end[i]
                e = end[i] = end[j]
                ids[i] = r
                wants[j] = -1
                lowest = r
                if wall[e]:
                    wants[i] = -1
                else:
                    before[e] = i
                    if (s := joint(r << 32 | ids[e])) is None:
                        wants[i] = -1
                    else:
                        wants[i] = s
                        if s in buckets:
                            buckets[s].append(i)
                        else:
                            push(s, i)
                        if s < r:
                            lowest = s
                if not wall[i]:
                    h = before[i]
                    if (s := joint(ids[h] << 32 | r)) is None:
                        wants[h] = -1
                    else:
                        wants[h] = s
                        if s in buckets:
                            buckets[s].append(h)
                        else:
                            push(s, h)
                        if s < r:
                            lowest = s
                if lowest < r and k + 1 < len(bucket):  # a lower rank has come up: it goes first
                    for i in bucket[k + 1 :]:
                        push(r, i)
                    break
        out, i = [], 0
        for p in pieces:
            stop = i + len(p)
            if (whole := rank_of(p)) is not None:
                out.append([whole])
                i = stop
                continue
            own = []
            while i < stop:
                own.append(ids[i])
                i = end[i]
            out.append(own)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Cache:
    """Ids of pre-tokens as little-endian unsigned 32-bit integers. Two generations: what the younger one holds stays in use, the older one goes."""

    def __init__(self, encoder: BytePairEncoder) -> None:
        self.encoder, self.young, self.old = encoder, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.encoder.words.findall(t) for t in texts]
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for w in set().union(*split).difference(young):
            if (ids := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = ids
        for w, ids in zip(missing, self.encoder.merge([w.encode() for w in missing]), strict=True):
            young[w] = array("I", ids).tobytes()
        return [b"".join(map(young.__getitem__, words)) for words in split]


_ENCODERS: dict[tuple[str, str], tuple[BytePairEncoder, _Cache]] = {}


def _encoder(path: str, pattern: str) -> tuple[BytePairEncoder, _Cache]:
    """One encoder and cache for each worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        encoder = BytePairEncoder.from_file(path, pattern)
        _ENCODERS[path, pattern] = encoder, _Cache(encoder)
    return _ENCODERS[path, pattern]


def encode_ids(df: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the ids of each text as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; a null key stays null. Rows are encoded whole, at any length, repeated
    ones included, and nothing is shuffled. Other columns don't come along, so theirs can't clash. The file at `path` holds base64 tokens and ranks and has to lie on every worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _encoder(path, pattern)[1]
        for pdf in batches:
            for part in runs(pdf, "_text", RUN_CHARS):
                yield pd.DataFrame({key: part[key].to_numpy(), "ids": cache.encode([x or "" for x in part["_text"]])})

    return df.select(key, F.col(text).alias("_text")).mapInPandas(frugal(run), f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary")


def decode_ids(df: DataFrame, *, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with a binary column `decoded`: the bytes that the ids stand for."""
    rest = [f for f in df.schema if f.name != "decoded"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = _encoder(path, pattern)[0].decode
        for pdf in batches:
            for part in runs(pdf, ids, RUN_CHARS):
                yield part.assign(decoded=[decode(array("I", x or b"").tolist()) for x in part[ids]])

    return df.mapInPandas(frugal(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    read = decode_ids(encode_ids(table(spark, sf_dir, "documents"), **vocabulary), **vocabulary)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

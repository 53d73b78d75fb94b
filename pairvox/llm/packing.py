"""Operator 6: documents packed into training windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, table, written

#: Chunks between spaces that a worker keeps with their ids; at the bound it starts anew. Text is handled in runs of so many characters.
CACHE_CHUNKS, RUN_CHARS = 300_000, 1_000_000


class ChunkedTokenizer:
    """Ids of whole texts, equal to those of the tokenizers library for the same byte-level BPE file.

    A single space between two other characters always begins a new pre-token, so a text's ids are those of its chunks
    between spaces, one after the other. Most chunks come again; a new one is encoded once, together with the other new
    ones of its run. Texts where a space stands beside white space are encoded whole.
    """

    def __init__(self, path: str, special: str = "<|endoftext|>") -> None:
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level BPE with the usual pattern is known here")
        letters = _byte_letters()
        vocabulary = {bytes(map(letters.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k != special}
        self.special, self.special_id = special, {x["content"]: x["id"] for x in spec["added_tokens"]}[special]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.whole = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for k, v in vocabulary.items():
            self.sizes[v] = len(k)
        self.beside = re.compile(r" \s|\s ").search
        self.clear()

    def clear(self) -> None:
        self.at: dict = {}
        self.pool, self.starts, self.lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.filled = 0

    def _keep(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.pool.append(ids)
        self.starts.append(self.filled + np.cumsum(lengths) - lengths)
        self.lengths.append(lengths)
        self.filled += len(ids)

    def _learn(self, chunks: list) -> None:
        alone = [c for c in chunks if isinstance(c, tuple) or not c or c[-1].isspace()]
        if alone:
            ids = [self.whole(c[0] if isinstance(c, tuple) else f" {c}") for c in alone]
            self._keep(alone, np.array([x for y in ids for x in y], np.uint32), np.array([len(y) for y in ids], np.int64))
        if joint := [c for c in chunks if not isinstance(c, tuple) and c and not c[-1].isspace()]:
            ids = np.array(self.whole(" " + " ".join(joint)), np.uint32)
            ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in joint), np.int64, len(joint)))
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            self._keep(joint, ids, np.diff(cuts, prepend=0))

    def run(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        split = []
        for i, t in enumerate(texts):
            if self.special in t:
                ids = [self.whole(x) for x in t.split(self.special)]
                out[i] = np.array([x for y in ids for x in (*y, self.special_id)][:-1], np.uint32)
            elif self.beside(t):
                out[i] = np.array(self.whole(t), np.uint32)
            else:
                first, *rest = t.split(" ")
                split.append((i, (first,), rest))
        if not split:
            return out
        if len(self.at) > CACHE_CHUNKS:
            self.clear()
        seen = set().union(*(rest for _, _, rest in split))
        seen.update(first for _, first, _ in split)
        if new := [c for c in seen if c not in self.at]:
            self._learn(new)
            self.pool, self.starts, self.lengths = [np.concatenate(self.pool)], [np.concatenate(self.starts)], [np.concatenate(self.lengths)]
        at, pool = self.at.__getitem__, self.pool[0]
        for i, first, rest in split:
            k = np.fromiter(map(at, (first, *rest)), np.int64, len(rest) + 1)
            n = self.lengths[0][k]
            ends = np.cumsum(n)
            out[i] = pool[np.repeat(self.starts[0][k] - ends + n, n) + np.arange(ends[-1])]
        return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level BPE files: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def cut_pieces(docs: DataFrame, *, path: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and end_id, cut every `capacity` ids. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = ChunkedTokenizer(path)
        for pdf in batches:
            texts = pdf["_text"].fillna("")
            for _, part in pdf.assign(_text=texts).groupby((texts.str.len().cumsum() // RUN_CHARS).to_numpy()):
                rows = []
                for k, ids in zip(part[key], tokenizer.run(part["_text"].tolist()), strict=True):
                    raw, n = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes(), len(ids) + 1
                    rows += [(k, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                yield pd.DataFrame(rows, columns=[key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInPandas(frugal(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows for pieces of these lengths: (pieces of each length in a window, how many such windows).

    The longest piece left opens a window. A bitset over the sums up to the room left says which sums the remaining
    multiset reaches (counts in powers of two); the highest one is traced back to piece counts. The window is repeated
    while all its pieces are there, so the work depends on the number of lengths and not on the number of pieces.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    windows = []
    while left:
        seed = next(iter(left))
        room = capacity - seed
        mask, goal = (1 << room + 1) - 1, 1 << room
        reach, steps = 1, []
        for n, c in left.items():
            if n > room:
                continue
            c, k = min(c - (n == seed), room // n), 1
            while c > 0:
                k = min(k, c)
                steps.append((n, k, reach))
                reach |= reach << n * k & mask
                c, k = c - k, 2 * k
            if reach & goal:
                break
        total, chosen = reach.bit_length() - 1, {seed: 1}
        for n, k, before in reversed(steps):
            if not before >> total & 1:
                chosen[n] = chosen.get(n, 0) + k
                total -= n * k
        times = min(left[n] // k for n, k in chosen.items())
        windows.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return windows


def assign_windows(pieces: DataFrame, *, capacity: int, order: tuple[str, ...], rows_per_bucket: int = 50_000) -> DataFrame:
    """pieces (with `length`) and their sequence_id and offset.

    Only the histogram of lengths, `capacity` rows at most, reaches the driver; the plan that returns has a few rows for
    each length. A piece's number among those of its length comes from small hash buckets and the buckets' counts, so a
    length that very many pieces have is dealt over many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = max(1, -(-sum(histogram.values()) // rows_per_bucket))
    plan, number, taken = [], 0, dict.fromkeys(histogram, 0)
    for chosen, times in minimum_slack(histogram, capacity):
        offset = 0
        for n, k in chosen.items():
            plan.append((n, taken[n], taken[n] + k * times, k, number, offset))
            taken[n] += k * times
            offset += n * k
        number += times
    plan_df = spark.createDataFrame(plan, "_n long, _from long, _to long, _k long, _window long, _base long")
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("length", "_bucket").count()
    before = counts.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    numbered = (
        rows.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
        .join(before, ["length", "_bucket"])
        .withColumn("_i", F.col("_before") + F.col("_in"))
    )
    placed = numbered.join(F.broadcast(plan_df), (F.col("length") == F.col("_n")) & (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")))
    placed = placed.withColumn("_j", F.col("_i") - F.col("_from"))
    return placed.select(
        *pieces.columns,
        F.expr("_window + _j div _k").alias("sequence_id"),
        F.expr("_base + (_j % _k) * length").alias("offset"),
    )


def pack(docs: DataFrame, *, path: str, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in exactly one piece.

    Full pieces of `capacity` ids are windows of their own; the rests, one a document, are packed by minimum bin slack.
    A null or empty text is its end id alone, a null key stays null, a text of any length is cut into pieces. Repeated
    rows are documents of their own; ties go by the key, the start and the ids. Other columns don't come along, so theirs
    can't clash. No rows give no rows.
    """
    pieces = written(cut_pieces(docs, path=path, capacity=capacity, key=key, text=text), "pieces")
    return assign_windows(pieces, capacity=capacity, order=(key, "start", "ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"))

"""Operator 12: SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import give_back, named, table

#: Segments and characters of a cache generation, and bytes of text that are encoded at once: memory is bounded, results are the same.
CACHE_ENTRIES, CACHE_CHARS, RUN_BYTES = 400_000, 12_000_000, 1 << 20

SPACE = "▁"


class PieceEncoder:
    """Encodes as the library does for a merge-type model: of all neighbouring symbols that make a piece, the pair of the best score merges first, the leftmost of equal ones.

    The agenda is a heap of (rank of the score, place). An entry is stale once either symbol has changed since; it is
    skipped when it comes up. Merges never cross a place where the characters on both sides stand together in no
    piece, so a text is cut at such places first and each segment has an agenda of its own. Symbols that are no piece
    become bytes.
    """

    def __init__(self, processor) -> None:
        sp = self.processor = processor
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        id_of = {sp.id_to_piece(i): i for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte)):
            raise ValueError("the vocabulary has no pieces for bytes")
        best = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        merged = [p for p in id_of if len(p) > 1]
        joined = {c for p in merged for c in p}
        # Symbols are numbered: pieces by their ids, then characters that stand in pieces but are none, then -1 for all others.
        symbol = id_of | {c: sp.vocab_size() + k for k, c in enumerate(sorted(joined - id_of.keys()))}
        self.rank = [0] * sp.vocab_size()  # of the score, in the upper half of a key
        for p in merged:
            self.rank[id_of[p]] = best[sp.get_score(id_of[p])] << 32
        self.pairs = {a << 32 | b: id_of[p] for p in merged for i in range(1, len(p)) if (a := symbol.get(p[:i])) is not None and (b := symbol.get(p[i:])) is not None}
        self.number = np.full(0x110000, -1, np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.number[ord(c)] = i
        two = sorted((symbol[p[0]] << 32 | symbol[p[1]], id_of[p]) for p in merged if len(p) == 2)
        self.two, self.two_made = (np.array([x[k] for x in two], np.int64) for k in (0, 1))
        self.vocabulary = sp.vocab_size()
        self.cut = re.compile(_cuts(merged, joined), re.DOTALL)
        #: Whether segments can be checked together, with line feeds between: the library must leave them as they are.
        self.walls = "\n" not in joined and "\n" not in id_of and sp.normalize("\n a  b ") == f"{SPACE}\n{SPACE}a{SPACE}{SPACE}b{SPACE}"

    def merge(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as 32-bit integers. All of them stand in one list, each with its own agenda."""
        text = "".join(segments)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(letters)
        ends = np.cumsum([len(x) for x in segments])
        numbers = self.number[letters]
        first = numbers[:-1] << 32 | numbers[1:]
        at = np.minimum(np.searchsorted(self.two, first), len(self.two) - 1)
        fits = (self.two[at] == first) & (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        fits[ends[:-1] - 1] = False
        start = np.flatnonzero(fits)
        made = np.full(n, -1, np.int64)  # what a symbol would make with the next one
        made[start] = self.two_made[at[start]]
        keys = np.array(self.rank, np.int64)[made[start]] | start
        wants = np.full(n, -1, np.int64)  # and the agenda's entry for that
        wants[start] = keys
        keys, wants = keys.tolist(), wants.tolist()
        of = np.searchsorted(start, np.append(0, ends)).tolist()
        made, ids, ends = made.tolist(), numbers.tolist(), ends.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        rank, joint, byte, vocabulary = self.rank, self.pairs.get, self.byte, self.vocabulary
        out, begin = [], 0
        for k, stop in enumerate(ends):
            agenda = keys[of[k] : of[k + 1]]
            heapify(agenda)
            while agenda:
                top = heappop(agenda)
                i = top & 0xFFFFFFFF
                if wants[i] != top:
                    continue  # stale: one of the two has changed
                m = ids[i] = made[i]
                j = after[i]
                e = after[i] = after[j]
                wants[i] = wants[j] = -1
                if e < stop:
                    before[e] = i
                    if (x := joint(m << 32 | ids[e])) is not None:
                        made[i] = x
                        key = wants[i] = rank[x] | i
                        heappush(agenda, key)
                if i > begin:
                    h = before[i]
                    if (x := joint(ids[h] << 32 | m)) is None:
                        wants[h] = -1
                    else:
                        made[h] = x
                        key = wants[h] = rank[x] | h
                        heappush(agenda, key)
            own = array("i")
            while begin < stop:
                i, nxt = ids[begin], after[begin]
                if 0 <= i < vocabulary:
                    own.append(i)
                else:
                    own.extend([byte[b] for b in text[begin].encode()])
                begin = nxt
            out.append(own.tobytes())
        return out

    def check(self, segments: list[str], ids: list[bytes]) -> None:
        """Raises ValueError unless the library gives the same ids for the segments."""
        if not self.walls or not segments:
            return
        lead, wall = self.merge([SPACE])[0], array("i", [self.byte[10]]).tobytes()
        for k in range(0, len(segments), 100):  # some at once: a call has its cost, and so has a long text
            own = array("i", wall.join([lead, *ids[k : k + 100]])).tolist()
            if self.processor.encode("\n" + "\n".join(segments[k : k + 100]).replace(SPACE, " ")) != own:
                raise ValueError("the library encodes a segment in another way: not a merge-type vocabulary, or one with symbols of the user's")

    def check_text(self, text: str, ids: bytes) -> None:
        """The same for a whole text, where segments can't be checked together."""
        if not self.walls and self.processor.encode(text) != array("i", ids).tolist():
            raise ValueError(f"the library encodes another way: {text[:80]!r}")


def _cuts(merged: list[str], joined: set[str]) -> str:
    """A pattern for segments. No piece holds the two characters around a cut side by side:

    a space mark begins a segment (unless some piece has one after another character), a character of no longer piece is
    one, and one that follows a letter in no piece ends the segment of letters before it.
    """
    if any(a != SPACE and b == SPACE for p in merged for a, b in zip(p, p[1:], strict=False)):
        return ".+"
    after_letters = {b for p in merged for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
    one = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
    letters = one({c for c in joined if c.isalpha()})
    others = {c for c in joined if not c.isalpha()} - {SPACE}
    return f"{SPACE}*(?:{one(others)}+{letters}*|{letters}+)(?:{one(others & after_letters)}{one(others)}*{letters}*)*|{SPACE}+|."


class _Cache:
    """Ids of segments. Two generations: what the younger one holds stays in use, the older one goes."""

    def __init__(self, encoder: PieceEncoder) -> None:
        self.encoder, self.young, self.old, self.chars = encoder, {}, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        encoder = self.encoder
        split = [encoder.cut.findall(encoder.processor.normalize(t)) if t else [] for t in texts]
        if len(self.young) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        young, old = self.young, self.old
        missing = []
        for w in set().union(*split).difference(young):
            if (ids := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = ids
            self.chars += len(w)
        new = encoder.merge(missing) if missing else []
        encoder.check(missing, new)
        young.update(zip(missing, new, strict=True))
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        for t, ids in zip(texts, out, strict=True):
            encoder.check_text(t, ids)
        return out


_ENCODERS: dict[str, _Cache] = {}


def _cache(path: str) -> _Cache:
    """One encoder and cache for each worker and model."""
    if path not in _ENCODERS:
        import sentencepiece

        _ENCODERS[path] = _Cache(PieceEncoder(sentencepiece.SentencePieceProcessor(model_file=path)))
    return _ENCODERS[path]


def _runs(batches: Iterator[pa.RecordBatch], size: Callable[[pa.Array], np.ndarray], limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Row runs of about `limit` units of the second column."""
    for batch in batches:
        at = np.cumsum(size(batch.column(1))) // limit
        cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def _lengths(column: pa.Array) -> np.ndarray:
    measure = pa.compute.binary_length if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.compute.list_value_length
    return pa.compute.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_pieces(df: DataFrame, *, path: str, end: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of each text as the library gives them, followed by the model's end id if `end`; nothing is sampled.

    A null text counts as empty (the end id alone, or no ids); a null key stays null. Rows are encoded whole, at any
    length, repeated ones included, and nothing is shuffled. Other columns don't come along, so theirs can't clash. In
    every Arrow batch the segments that are new to a worker are checked against the library, which must agree on all of
    them; a difference is an error. The model file at `path` has to lie on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        tail = array("i", [cache.encoder.processor.eos_id()] * end).tobytes()
        for part in _runs(batches, _lengths):
            ids = [x + tail for x in cache.encode([t or "" for t in part.column(1).to_pylist()])]
            offsets = pa.array(np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32))
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], ["key", "ids"])

    kind = df.select(named(key)).schema[0].dataType.simpleString()
    out = df.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def decode_pieces(df: DataFrame, *, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded string): the text that the library's decoder gives for the ids of each row.

    Null or empty ids give an empty text, a null key stays null, repeated rows are decoded each. Lists of any length are
    decoded whole, some at once. Other columns don't come along. An id that the model doesn't have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _cache(path).encoder.processor.decode
        for part in _runs(batches, _lengths):
            texts = [decode(x) if x else "" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    kind = df.select(named(key)).schema[0].dataType.simpleString()
    out = df.select(named(key).alias("key"), named(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids), "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    read = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path=path), path=path)
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

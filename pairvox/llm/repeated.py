"""Which keys (hashes of shingles, anchors) do two or more documents hold? A packed exchange that answers it for every document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, give_back

#: A document, what `keys` said about it, and its repeated keys in order or null: all, packed, and the leading ones.
SCHEMA = "doc_id long, n long, digest_a long, digest_b long, keys binary, lead array<long>"
PACKED = "part int, kind int, first binary, second binary"

#: Documents of a batch from which a key counts as common; where an answer's level begins; the highest level.
COMMON, LEVEL, TOP = 8, 60, np.int64(7)

#: Text that is handled at once, and text whose keys are sorted together.
RUN_BYTES, SORT_BYTES = 1 << 20, 4 << 20


def homes(n_docs: int, n_bytes: int) -> int:
    """A prime number of parts for documents: about 2,000 of them or 5 MB of text each, whichever makes more parts."""
    n = max(17, n_docs // 2000, n_bytes // 5_000_000) | 1
    while any(n % d == 0 for d in range(3, math.isqrt(n) + 1, 2)):
        n += 2
    return n


def by_home(kind: int, d: np.ndarray, other: np.ndarray, n_homes: int) -> pd.DataFrame:
    """Rows for the parts of documents d; other has one column or several, one after the other."""
    if not len(d):
        return _rows([], [], [], [])
    to = np.mod(d, n_homes)
    order = np.argsort(to, kind="stable")
    to, d, other = to[order], d[order], other.reshape(-1, len(d))[:, order]
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)).tolist()
    pairs = list(zip(cuts, cuts[1:], strict=False))
    return _rows([int(to[a]) for a, _ in pairs], [kind] * len(pairs), [planes(d[a:b]) for a, b in pairs], [planes(other[:, a:b].reshape(-1)) for a, b in pairs])


def key_bits(n_docs: int) -> int:
    """Leading bits of a key that name its part: the number of parts grows with the table (up to 10^11 documents), so a part's size doesn't."""
    return min(27, max(6, math.ceil(math.log2(max(n_docs, 1) / 512 + 1))))


def short_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of 64-bit hashes, as they come back in the answer."""
    return (hashes >> np.uint64(32 - bits)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, for the shuffle's compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def runs(pdf: pd.DataFrame, column: str, limit: int = RUN_BYTES) -> Iterator[pd.DataFrame]:
    """Row runs of about `limit` characters."""
    if len(pdf):
        at = pdf[column].map(lambda x: len(x) if x is not None else 0).cumsum() // limit
        for _, part in pdf.groupby(at.to_numpy()):
            yield part


def flags(x: np.ndarray) -> bytes:
    """Truth values as bits; no bytes if none is true."""
    return np.packbits(x).tobytes() if x.any() else b""


def unflags(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) if len(b) else np.zeros(n, bool)


def answers(docs: DataFrame, keys: Callable[[list[bytes]], tuple], *, bits: int, n_homes: int, hot: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows for the home of each document: kind 1, its repeated keys; kind 2, what `keys` said about it; kind 3 in part 0, keys that `hot` entries or more came for.

    keys(texts) gives (row of each key, 64-bit key) without repeats in a row, and a list of (n, a, b) for the rows or
    None. Of equal texts the smallest document of a batch may get the keys alone.

    Keys go to parts by their leading bits and the answers to parts by document, both packed. Within a batch equal texts
    are one, and a key that COMMON documents of the batch hold is told to them on the spot; one entry of it goes on. So a
    key that a third of all documents hold sends one entry a batch. An entry takes about six bytes: keys are sorted and
    sent as differences, with their documents beside them and,
    behind these, a bit for each that was told already; ids may have any sign. From bit LEVEL on, an answer says how common the key is: the
    logarithm of its entries, or TOP if it was common in any batch; all its holders are told the same.
    """
    low, many = np.uint64(0xFFFFFFFF), 1 << bits

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in runs(pdf, "_text", SORT_BYTES):
                yield from share(part)

    def share(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        held, holder, first = [], [], {}
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in pdf["_text"]]
        ids = pdf["_id"].to_numpy(np.int64)
        for i in np.argsort(ids, kind="stable").tolist():
            first.setdefault(texts[i], i)
        mine = sorted(first.values())
        told = dict(zip(mine, range(len(mine)), strict=True))
        notes: list = []
        at = size = 0
        for j, i in enumerate(mine):
            size += len(texts[i])
            if size >= RUN_BYTES or j + 1 == len(mine):
                row, hashes, note = keys([texts[m] for m in mine[at : j + 1]])
                held.append(hashes)
                holder.append(ids[mine][row + at])
                notes += note or []
                at, size = j + 1, 0
        if notes:
            facts = np.array([(ids[i], *notes[told[first[t]]]) for i, t in enumerate(texts)], np.int64)
            yield _rows([many + int(ids[0]) % many], [2], [planes(facts[:, 0])], [planes(facts[:, 1:].T.reshape(-1))])
        k, d = short_keys(np.concatenate(held), bits).view(np.uint64), np.concatenate(holder)
        if not len(k):
            return
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        new = np.append(True, k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(k)) - 1
        common = (ends - begins + 1 >= COMMON)[group]
        if common.any():
            yield _rows([many + int(d[0]) % many], [1], [planes(d[common])], [planes(k[common].view(np.int64) | TOP << LEVEL)])
        keep = ~common | new
        k, d, common = k[keep], d[keep], common[keep]
        part = (k >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(k)).tolist()
        rest = (k & low).astype(np.uint32)
        pairs = list(zip(cuts, cuts[1:], strict=False))
        yield _rows([int(part[a]) for a, _ in pairs], [0] * len(pairs), [planes(np.diff(rest[a:b], prepend=np.uint32(0))) for a, b in pairs], [planes(d[a:b]) + flags(common[a:b]) for a, b in pairs])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [by_home(kind, unplanes(a, np.int64), unplanes(b, np.int64), n_homes) for kind, a, b in zip(pdf["kind"], pdf["first"], pdf["second"], strict=True) if kind]
        entries = pdf[pdf["kind"] == 0]
        if len(entries):
            rest = np.concatenate([np.cumsum(unplanes(x, np.uint32), dtype=np.uint32) for x in entries["first"]])
            sizes = [len(x) // 4 for x in entries["first"]]
            d = np.concatenate([unplanes(x[: 8 * n], np.int64) for x, n in zip(entries["second"], sizes, strict=True)])
            told = np.concatenate([unflags(x[8 * n :], n) for x, n in zip(entries["second"], sizes, strict=True)])
            order = np.lexsort((d, rest))
            rest, d, told = rest[order], d[order], told[order]
            new = np.append(True, rest[1:] != rest[:-1])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(rest)) - 1
            group = np.cumsum(new) - 1
            known = np.logical_or.reduceat(told, begins)
            ask = (known | (d[begins] != d[ends]))[group] & ~told
            level = np.where(known, TOP, np.minimum(TOP - 1, np.log2(ends - begins + 1).astype(np.int64)))
            lead = np.int64(entries["part"].iloc[0]) << 32
            out.append(by_home(1, d[ask], level[group][ask] << LEVEL | lead | rest[ask].astype(np.int64), n_homes))
            if hot:
                holders = ends - begins + 1 + (COMMON - 1) * np.add.reduceat(told.astype(np.int64), begins)
                k = lead | rest[begins][holders >= hot].astype(np.int64)
                out.append(_rows([0], [3], [planes(k)], [b""]) if len(k) else _rows([], [], [], []))
        give_back()
        return pd.concat(out)

    sent = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInPandas(frugal(send), PACKED)
    return sent.groupBy("part").applyInPandas(meet, PACKED)


def told_keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of kind 1, in order and without repeats."""
    own = pdf[pdf["kind"] == 1]
    none = np.zeros(0, np.int64)
    d, k = (np.concatenate([none, *(unplanes(x, np.int64) for x in own[c])]) for c in ("first", "second"))
    order = np.lexsort((k, d))
    d, k = d[order], k[order]
    new = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])) if len(d) else np.zeros(0, bool)
    return d[new], k[new]


def packed_list(x: np.ndarray) -> bytes:
    """Numbers in order as compressed differences."""
    return zstandard.compress(planes(np.diff(x, prepend=np.int64(0))), 3)


def unpacked_list(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(zstandard.decompress(b), np.int64))


def documents_with_keys(docs: DataFrame, keys: Callable[[list[bytes]], tuple], *, bits: int, n_homes: int, least: Callable[[np.ndarray], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of SCHEMA for all rows of docs (see `answers`). Documents with least(n) repeated keys or more have theirs; all but least(n) - 1 of them lead."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        d, k = told_keys(pdf)
        facts = pdf[pdf["kind"] == 2]
        docs, begins = np.unique(d, return_index=True)
        counts = np.diff(np.append(begins, len(d)))
        ids = np.concatenate([unplanes(x, np.int64) for x in facts["first"]])
        n, a, b = np.concatenate([unplanes(x, np.int64).reshape(3, -1) for x in facts["second"]], axis=1)
        need = least(n)
        lists: list = [None] * len(ids)
        if len(docs):
            at = np.minimum(np.searchsorted(docs, ids), len(docs) - 1)
            has = (docs[at] == ids) & (counts[at] >= need)
            lists = [k[s : s + c] if h else None for h, s, c in zip(has.tolist(), begins[at].tolist(), counts[at].tolist(), strict=True)]
        packed = [None if x is None else packed_list(x) for x in lists]
        lead = [None if x is None else x[: len(x) - t + 1] for x, t in zip(lists, need.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": ids, "n": n, "digest_a": a, "digest_b": b, "keys": packed, "lead": lead})

    return answers(docs, keys, bits=bits, n_homes=n_homes, key=key, text=text).groupBy("part").applyInPandas(gather, SCHEMA)


def _rows(part: list, kind: list, first: list, second: list) -> pd.DataFrame:
    return pd.DataFrame({"part": part, "kind": kind, "first": first, "second": second})

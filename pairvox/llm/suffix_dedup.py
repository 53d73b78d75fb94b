"""Operator 3: bytes that stand in a smaller document already, by suffix arrays that are built by linear grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, give_back, named, table, written
from pairvox.llm.hashing import Substrings, mix
from pairvox.llm.repeated import LEVEL, PACKED, _rows, answers, by_home, homes, key_bits, planes, runs, short_keys, told_keys, unplanes

#: Bytes of an anchor string; bytes of a symbol; entries of an anchor from which its windows meet by content.
ANCHOR, SYMBOL, HOT_ROWS = 16, 32, 50_000
#: Parts that a group of whole copies is cut into when it meets its smallest document.
SALTS = 32
_PIECE = 1 << 20  # text that is hashed at once; a longer one is taken in pieces
_FAR = np.iinfo(np.int64).max


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of integers from 1 on, in order, by grouping in linear steps.

    First, suffixes are grouped by their Lyndon prefixes: groups, at first one for each symbol, are taken in descending
    order; a suffix of the group points at the nearest one before it in a lower group (pointers of suffixes already
    done are followed), and what is pointed at moves into a new group just above its old one, by how often it is
    pointed at. Then, in ascending order, each suffix places the suffixes that end at it, along the same pointers, at
    the front of their groups. No group is sorted again or renamed.
    """
    t = [*text, 0]
    n = len(t)
    members: list[list[int]] = [[] for _ in range(max(t) + 1)]
    for i, c in enumerate(t):
        members[c].append(i)
    of = list(t)  # the group of each suffix
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    done = bytearray(n)
    prev = [-1] * n
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) == 1:  # most groups
            i = own[0]
            if of[i] != g:
                members[g] = []
            else:
                done[i] = 1
                j = i - 1
                while j >= 0 and done[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    old = of[j]
                    new = of[j] = len(members)
                    members.append([j])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
            g = below[g]
            continue
        own = members[g] = [i for i in own if of[i] == g]
        own.sort()
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                moved.setdefault((of[j], -k), []).append(j)
            for (old, _), group in sorted(moved.items()):
                new = len(members)
                members.append(group)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in group:
                    of[j] = new
        g = below[g]
    front = [0] * len(members)
    g, at = 0, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            k = of[j]
            order[front[k]] = j
            front[k] += 1
            j = prev[j]
    return order[1:]


def windows(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Runs of windows of `length` bytes with the same anchor: arrays (row, start, windows, anchor's place, anchor's hash), by pieces of texts.

    A window's anchor is the leftmost of its ANCHOR-byte strings with the least hash, so equal windows have equal
    anchors at equal places wherever they stand.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _PIECE):
            parts.append((row, at, t[at : at + _PIECE + length - 1]))
            size += len(parts[-1][2])
            if size >= _PIECE:
                yield _windows(parts, length)
                parts, size = [], 0
    if parts:
        yield _windows(parts, length)


def _windows(parts: list[tuple[int, int, bytes]], length: int) -> tuple:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in parts])
    width = length - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = Substrings(data).every(ANCHOR)
    low = np.uint64((1 << 26) - 1)  # pieces of a call hold fewer bytes
    least = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = (least & low).astype(np.int64)
    at = np.arange(len(place))
    begins = ends - np.diff(ends, prepend=0)
    new = np.append(True, place[1:] != place[:-1])
    new[begins[begins < len(new)]] = True
    first = np.flatnonzero(new)
    part = np.searchsorted(ends, first, side="right")
    count = np.minimum(np.append(first[1:], len(place)), ends[part] - length + 1) - first
    keep = count > 0
    first, part, count = first[keep], part[keep], count[keep]
    rows, offsets = np.array([r for r, _, _ in parts]), np.array([o for _, o, _ in parts])
    shift = offsets[part] - begins[part]
    return rows[part], at[first] + shift, count, place[first] + shift, hashes[place[first]]


def anchor_keys(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, None]:
    """(row, hash) of the anchors of all windows, without repeats in a row."""
    found = [(row, h) for row, _, _, _, h in windows(texts, length)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    row, h = np.concatenate([x[0] for x in found]).astype(np.int64), np.concatenate([x[1] for x in found])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    return row[new], h[new], None


def _contexts(texts: list[bytes], length: int, known: np.ndarray, hot: np.ndarray, bits: int) -> Iterator[tuple]:
    """Contexts of anchors that another document has too, by pieces: arrays (row, start, windows, anchor's place in the context, block hash).

    A context is a run of windows with one anchor. Windows of a hot anchor are contexts of their own, which meet by content.
    """
    for row, start, n, place, h in windows(texts, length):
        keys = short_keys(h, bits)
        keep = np.isin(keys, known)
        row, start, n, place, h, keys = (x[keep] for x in (row, start, n, place, h, keys))
        if len(hot) and len(row) and (very := np.isin(keys, hot)).any():
            own = np.repeat(np.flatnonzero(very), n[very])
            shift = np.arange(len(own)) - np.repeat(np.cumsum(n[very]) - n[very], n[very])
            begin = start[own] + shift
            content = [texts[r][s : s + length] for r, s in zip(row[own].tolist(), begin.tolist(), strict=True)]
            alone = Substrings(np.frombuffer(b"".join(content), np.uint8)).every(length)[::length]
            row, place, h = np.append(row[~very], row[own]), np.append(place[~very], place[own]), np.append(h[~very], alone)
            start, n = np.append(start[~very], begin), np.append(n[~very], np.ones(len(own), n.dtype))
        if len(row):
            yield row, start, n, place - start, h


def _send_contexts(docs: pd.DataFrame, told: pd.DataFrame, length: int, hot: np.ndarray, bits: int) -> Iterator[pd.DataFrame]:
    """Packed rows. Kind 0: contexts for a block. Kind 1: spans already known, since a smaller document of these has the same context."""
    ids, keys = told_keys(told)
    gone = {(int.from_bytes(a, "big", signed=True), int.from_bytes(b, "big", signed=True)) for a, b in told.loc[told["kind"] == COPY, ["first", "second"]].itertuples(index=False)}
    here = set(np.unique(ids).tolist())
    keep = [i in here and (i, m) not in gone for i, m in zip(docs["id"].tolist(), docs["m"].tolist(), strict=True)]
    known, unpack = np.unique(keys & (1 << LEVEL) - 1), zstandard.ZstdDecompressor().decompress
    docs = docs[keep].drop_duplicates(["id", "m"])
    texts = [unpack(b) for b in docs["body"]]
    id_, m_ = docs["id"].to_numpy(np.int64), docs["m"].to_numpy(np.int64)
    many = 1 << bits
    for row, start, n, at, h in _contexts(texts, length, known, hot, bits):
        cut = [texts[r][s : s + k + length - 1] for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
        ends = np.cumsum([len(c) for c in cut])
        z = Substrings(np.frombuffer(b"".join(cut), np.uint8)).of(np.append(0, ends[:-1]), ends)
        order = np.lexsort((id_[row], z))
        d, m, start, n, at, h, z = (x[order] for x in (id_[row], m_[row], start, n, at, h, z))
        first = np.flatnonzero(np.append(True, z[1:] != z[:-1]))
        low = np.repeat(d[first], np.diff(np.append(first, len(d))))
        lost = d > low
        if lost.any():
            yield _rows([many + int(d[0]) % many], [1], [planes(d[lost])], [planes(np.concatenate([m[lost], start[lost], start[lost] + n[lost] + (length - 1)]))])
        k = np.flatnonzero(~lost)
        block = (mix(h[k]) >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        block, k = block[by], k[by]
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = k[a:b]
            body = b"".join(cut[i] for i in order[own].tolist())
            facts = planes(d[own]) + planes(m[own]) + planes(start[own]) + n[own].astype(np.uint8).tobytes() + at[own].astype(np.uint8).tobytes()
            out.append((int(block[a]), facts, zstandard.compress(body, 3)))
        if out:
            yield _rows([x[0] for x in out], [0] * len(out), [x[1] for x in out], [x[2] for x in out])


def _sorted_contexts(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings in order: (place in the order of each given string, the common prefix of each with the one before it in the order).

    The suffix array is of all strings, cut into symbols of SYMBOL bytes and their number, with walls between.
    """
    distinct = list(dict.fromkeys(strings))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    lengths = np.array([len(s) for s in distinct])
    counts = lengths // SYMBOL + 1  # a last symbol is there even when it is empty: a prefix comes first
    wide = int(lengths.max()) // SYMBOL * SYMBOL + SYMBOL
    padded = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in distinct), np.uint8).reshape(len(distinct), wide)
    cells = padded.reshape(len(distinct), -1, SYMBOL)
    used = np.arange(cells.shape[1]) < counts[:, None]
    words = np.ascontiguousarray(cells[used]).view(">u8").astype(np.uint64)
    filled = np.clip(lengths[:, None] - SYMBOL * np.arange(cells.shape[1]), 0, SYMBOL)[used]
    by = np.lexsort((filled, *words.T[::-1]))
    change = np.append(True, (words[by[1:]] != words[by[:-1]]).any(axis=1) | (np.diff(filled[by]) != 0))
    symbols = np.empty(len(by), np.int64)
    symbols[by] = np.cumsum(change) + 1
    ends = np.cumsum(counts)
    text = np.insert(symbols, ends, 1)  # 1: the wall after each string
    starts = ends - counts + np.arange(len(distinct))
    string = np.full(len(text), -1)
    string[starts] = np.arange(len(distinct))
    order = string[np.array(suffix_array(text.tolist()))]
    order = order[order >= 0]
    differ = padded[order[1:]] != padded[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.append(0, np.minimum(common, np.minimum(lengths[order[1:]], lengths[order[:-1]])))
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    return place[np.array([number[s] for s in strings])], common, lengths


def _meet_contexts(pdf: pd.DataFrame, length: int, n_homes: int) -> pd.DataFrame:
    """Packed rows of kind 1 for the homes of documents: (document, m, a, b) of spans that a smaller document has."""
    give_back()
    out = [by_home(1, unplanes(a, np.int64), unplanes(b, np.int64), n_homes) for a, b in pdf.loc[pdf["kind"] == 1, ["first", "second"]].itertuples(index=False)]
    facts: list[list[np.ndarray]] = [[], [], [], [], []]
    strings: list[bytes] = []
    for a, b in pdf.loc[pdf["kind"] == 0, ["first", "second"]].itertuples(index=False):
        k = len(a) // 26
        for i in range(3):
            facts[i].append(unplanes(a[8 * k * i : 8 * k * (i + 1)], np.int64))
        for i in range(2):
            facts[3 + i].append(np.frombuffer(a, np.uint8, k, 24 * k + i * k).astype(np.int64))
        body = zstandard.decompress(b)
        ends = np.cumsum(facts[3][-1] + length - 1)
        strings += [body[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    if strings:
        d, m, start, n, at = map(np.concatenate, facts)
        distinct = list(dict.fromkeys(zip(strings, at.tolist(), strict=True)))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        context = np.array([number[x] for x in zip(strings, at.tolist(), strict=True)])
        low, high = np.full(len(distinct), _FAR), np.full(len(distinct), -_FAR)
        np.minimum.at(low, context, d)
        np.maximum.at(high, context, d)
        i, j, k, least = _equal_windows([x for x, _ in distinct], np.array([x for _, x in distinct]), low, high, length)
        by = np.argsort(context, kind="stable")  # occurrences of a context stand together
        begin = np.searchsorted(context[by], np.arange(len(distinct) + 1))
        times = begin[i + 1] - begin[i]
        run = np.repeat(np.arange(len(i)), times)
        own = by[begin[i][run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)]
        keep = least[run] < d[own]
        run, own = run[keep], own[keep]
        out.append(by_home(1, d[own], np.concatenate([m[own], start[own] + j[run], start[own] + k[run] + (length - 1)]), n_homes))
    return pd.concat(out) if out else _rows([], [], [], [])


def _equal_windows(strings: list[bytes], at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple:
    """Arrays (context, j, k, least): in the windows [j, k) of a context, least is the smallest document that has them; only where it is below `high` of the context."""
    n = np.array([len(s) for s in strings]) - (length - 1)
    right, right_common, _ = _sorted_contexts([s[a : a + length] for s, a in zip(strings, at.tolist(), strict=True)])
    left, left_common, _ = _sorted_contexts([s[:a][::-1] for s, a in zip(strings, at.tolist(), strict=True)])
    width = length - ANCHOR + 1
    least = np.full((len(strings), width + 1), _FAR)
    for o in range(width):  # windows whose anchor is o bytes from their start: equal by what follows the anchor and what comes before
        rows = np.flatnonzero((at >= o) & (at - o < n))
        if not len(rows):
            continue
        follow, lead = np.cumsum(right_common < length - o)[right[rows]], np.cumsum(left_common < o)[left[rows]]
        same = follow * (len(strings) + 1) + lead
        by = np.argsort(same, kind="stable")
        begin = np.flatnonzero(np.append(True, same[by][1:] != same[by][:-1]))
        smallest = np.empty(len(rows), np.int64)
        smallest[by] = np.repeat(np.minimum.reduceat(low[rows][by], begin), np.diff(np.append(begin, len(rows))))
        least[rows, at[rows] - o] = np.where(smallest < high[rows], smallest, _FAR)
    flat = least.reshape(-1)
    begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    end = np.append(begin[1:], len(flat))
    keep = flat[begin] != _FAR
    begin, end = begin[keep], end[keep]
    row = begin // (width + 1)
    return row, begin - row * (width + 1), end - row * (width + 1), flat[begin]


_CUT = "kept binary, n_bytes long, n_removed long, n_spans long"


def _cut_out(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """(bytes left, all, removed, maximal removed runs)."""
    kept, removed, count, at = [], 0, 0, 0
    for a, b in sorted(spans):
        b = min(b, len(body))
        if a > at or not count:
            kept.append(body[at:a])
            count += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(body[at:])
    return b"".join(kept), len(body), removed, count


def _finish(docs: pd.DataFrame, told: pd.DataFrame, names: list[str], text: str | None) -> pd.DataFrame:
    d, own = told.loc[told["kind"] == 1, "first"], told.loc[told["kind"] == 1, "second"]
    none = np.zeros(0, np.int64)
    d = np.concatenate([none, *(unplanes(x, np.int64) for x in d)])
    m, a, b = np.concatenate([np.zeros((3, 0), np.int64), *(unplanes(x, np.int64).reshape(3, -1) for x in own)], axis=1)
    order = np.lexsort((m, d))
    d, m, a, b = (x[order].tolist() for x in (d, m, a, b))
    spans: dict[tuple[int, int], list] = {}
    for key, x in zip(zip(d, m, strict=True), zip(a, b, strict=True), strict=True):
        spans.setdefault(key, []).append(x)
    for x, y in told.loc[told["kind"] == COPY, ["first", "second"]].itertuples(index=False):
        spans[int.from_bytes(x, "big", signed=True), int.from_bytes(y, "big", signed=True)] = [(0, 1 << 62)]
    unpack = zstandard.ZstdDecompressor().decompress
    bodies = [unpack(x) for x in docs["body"]]
    ids = [None if i != i or i is None else int(i) for i in docs["id"]]
    rows = [_cut_out(t, spans.get((i, m), [])) for t, i, m in zip(bodies, ids, docs["m"].tolist(), strict=True)]
    out = docs.assign(**{n.split()[0]: [r[i] for r in rows] for i, n in enumerate(_CUT.split(", "))})
    if text:
        out[text] = [None if z else t.decode("utf-8", "surrogatepass") for z, t in zip(docs["nil"], bodies, strict=True)]
    return out[[*names, *(n.split()[0] for n in _CUT.split(", "))]]


#: Kind of rows that name a document whose whole text is a copy of a smaller one's.
COPY = 5


def _packed_texts(docs: DataFrame, key: str, text: str, n_homes: int, rest: list) -> DataFrame:
    """(part, id, m, nil, body) and columns `rest`: texts as compressed UTF-8, so that shuffling them takes a third; m is the text's 32-bit hash."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for pdf in batches:
            for part in runs(pdf, "body"):
                yield part.assign(body=[compress(bytes(x)) for x in part["body"]])

    at = F.pmod(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)), F.lit(n_homes)).cast("int").alias("part")  # rows without id go by content
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    slim = docs.select(at, F.col(key).cast("long").alias("id"), F.hash(text).alias("m"), F.col(text).isNull().alias("nil"), body, *[named(f.name).alias(f"_{i}") for i, f in enumerate(rest)])
    return slim.mapInPandas(frugal(pack), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema))


def remove_repeats(docs: DataFrame, *, length: int = 50, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (all) with the columns of _CUT: the bytes left once each byte is gone that a string of `length` bytes covers which also starts in a smaller document.

    1. Each window of `length` bytes has an anchor (see `windows`). A packed exchange tells each document which of its
       anchors others have too; only windows around those can be copies.
    2. Their contexts meet in blocks by anchor, once for each run of documents that holds them. In a block suffix arrays
       by linear grouping order what follows the anchors and, reversed, what comes before; common prefixes in these
       orders say which windows are equal, byte by byte, and so the smallest document of each window.
    3. The windows of an anchor that very many documents have (a passage in a large share of them) don't meet by anchor
       but by content, so that the different borders of the passage lie in many blocks. Such anchors, a millionth of all
       documents or more each, are the only keys that reach the driver.

    A null text counts as empty. Rows with the same id never take bytes from each other; a row without id neither gives
    nor loses any. Columns of docs that are named as those of _CUT are replaced, others pass through.
    """
    docs = docs.drop(*(c.split()[0] for c in _CUT.split(", ")))
    rest = [f for f in docs.schema if columns is None or f.name in columns]
    fine = docs.filter(F.col(key).isNotNull() & (F.octet_length(F.coalesce(F.col(text), F.lit(""))) >= length))
    own = written(fine.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), F.hash(text).alias("m"), F.octet_length(text).alias("size")), "digests")
    total, size = own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits, n_homes, hot_rows = key_bits(total), homes(total, size), max(hot_rows, total // 1_000_000)
    told = answers(fine, lambda texts: anchor_keys(texts, length), bits=bits, n_homes=n_homes, hot=hot_rows, key=key, text=text)
    told = written(told, "anchors")
    hot = np.unique(np.concatenate([np.zeros(0, np.int64), *(unplanes(r["first"], np.int64) for r in told.filter("kind = 3").select("first").collect())]))
    first = own.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    first = first.select("digest", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"]).filter("id > low").select("id", "m").distinct()
    copies = copies.select(F.pmod("id", F.lit(n_homes)).cast("int").alias("part"), F.lit(COPY).alias("kind"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("first"), F.unhex(F.lpad(F.hex(F.col("m").cast("long")), 16, "0")).alias("second"))

    texts = _packed_texts(fine, key, text, n_homes, [])
    asked = told.filter("kind = 1").union(copies)

    def send(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = list(_send_contexts(docs, told, length, hot, bits)) if len(docs) and len(told) else []
        return pd.concat(out) if out else _rows([], [], [], [])

    contexts = texts.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(send, PACKED)
    spans = contexts.groupBy("part").applyInPandas(lambda pdf: _meet_contexts(pdf, length, n_homes), PACKED).union(copies)
    carried = [f for f in rest if f.name != text]
    whole = _packed_texts(docs, key, text, n_homes, carried)
    of = {f.name: f"_{i}" for i, f in enumerate(carried)}
    names = [of.get(f.name, text) for f in rest]

    def finish(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = _finish(docs, told, names, text if text in names else None)
        return out.rename(columns={n: c for c, n in of.items()})

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return whole.groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(finish, ddl + _CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 50 bytes of the hexadecimal text and the smallest document it starts in; runs of bytes that such windows cover.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(h, '.{1,256}') AS p FROM d)),
y AS (SELECT doc_id, (i - 1) * 128 AS c, part || coalesce(left(lead(part) OVER (PARTITION BY doc_id ORDER BY i), 98), '') AS h FROM x),
w AS (SELECT doc_id, c + unnest(range(length(h) // 2 - 49)) AS p, unnest(list_transform(range(length(h) // 2 - 49), lambda i: md5_number(substr(h, 2 * i + 1, 100)))) AS w FROM y WHERE length(h) >= 100),
m AS (SELECT w, min(doc_id) AS low FROM w GROUP BY w),
g AS (SELECT doc_id, p FROM w JOIN m USING (w) WHERE low < doc_id),
o AS (SELECT doc_id, p, coalesce(p > lag(p) OVER q + 50, true) AS begins FROM g WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT doc_id, p, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM n GROUP BY doc_id, run),
k AS (SELECT u.doc_id, a, e, substr(h, 2 * lag(e, 1, 0) OVER q + 1, 2 * (a - lag(e, 1, 0) OVER q)) AS piece FROM u JOIN d USING (doc_id) WINDOW q AS (PARTITION BY u.doc_id ORDER BY a)),
r AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(piece, '' ORDER BY a) AS pieces FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

"""Operator 5: licence spans by matching statistics against a generalised suffix automaton of licence words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import frugal, table
from pairvox.llm.licence_texts import TEMPLATES

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: A match counts from so many words (or a whole template); a chain's matches are at most so many words apart in the text; a
#: span gets its label from this share of the template. A text with a base phrase scores so much at least.
MIN_MATCH, MAX_GAP, MIN_COVER, PHRASE_SCORE = 4, 8, 0.5, 0.5

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # on UTF-8 bytes in lower case: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, cover: double>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z alone."""
    return _WORDS((text or "").encode("utf-8", "surrogatepass").lower())


class LicenceAutomaton:
    """Suffix automaton of several word sequences: templates, then phrases; a state's `ends` has all (sequence, last word) where its strings stand."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.texts = [(words_of(t), label) for label, t in templates] + self.phrases
        self.first_phrase = len(templates)
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t, _ in self.texts for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, (sequence, _) in enumerate(self.texts):
            last = 0
            for at, w in enumerate(sequence):
                last = self._extend(last, self.ids[w])
                self.ends[last].add((t, at))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]
        # Phrases that are a suffix of a state's longest string.
        self.done = [[k for k, (p, _) in enumerate(self.phrases) if self._whole(v, self.first_phrase + k, len(p))] for v in range(len(self.next))]
        # Where matches can be in templates: by state, for strings of MIN_MATCH words and more or a whole template.
        short = min((len(t) for t, _ in self.texts[: self.first_phrase]), default=MIN_MATCH)
        self.places = [sorted(e for e in own if e[0] < self.first_phrase) if n >= min(MIN_MATCH, short) else [] for own, n in zip(self.ends, self.length, strict=True)]

    def _whole(self, v: int, t: int, n: int) -> bool:
        while v > 0 and self.length[self.link[v]] >= n:
            v = self.link[v]
        return v > 0 and self.length[v] >= n and (t, n - 1) in self.ends[v]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases as (start, phrase), and right-maximal matches of two words or more as (last word, length, state)."""
        places, matches = [], []
        follow, link, lengths, done = self.next, self.link, self.length, self.done
        v = n = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                if n > 1:
                    matches.append((i - 1, n, v))
                v = n = 0
                continue
            to = follow[v].get(w)
            if to is None:
                if n > 1:
                    matches.append((i - 1, n, v))
                while (to := follow[v].get(w)) is None:
                    v = link[v]
                n = lengths[v]
            v, n = to, n + 1
            for k in done[v]:
                if n >= (m := len(self.phrases[k][0])):
                    places.append((i - m + 1, k))
        if n > 1:
            matches.append((len(words) - 1, n, v))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """Covered spans (label, first word, last word, cover) and the best cover of any chain.

        A chain is a run of matches that go forward in the text and in one template, at most MAX_GAP words apart in the
        text; its weight is the number of template words covered. The heaviest chain to each match comes from dynamic
        programming over all places of the match in the template. Chains are taken from the heaviest on, as long as they
        share no match, and those that cover MIN_COVER of their template are spans.
        """
        anchors: dict[int, list[tuple[int, int, int]]] = {}  # (last word in the text, last word in the template, length)
        for last, n, v in matches:
            for t, at in self.places[v]:
                if n >= min(MIN_MATCH, len(self.texts[t][0])):
                    anchors.setdefault(t, []).append((last, at, n))
        found, best = [], 0.0
        for t, own in anchors.items():
            size = len(self.texts[t][0])
            weight, back = [n for *_, n in own], [-1] * len(own)
            for k, (last, at, n) in enumerate(own):
                for j in range(k - 1, -1, -1):
                    before, reached, _ = own[j]
                    if before < last - n - MAX_GAP:
                        break
                    if before < last and reached < at and (w := weight[j] + min(n, last - before, at - reached)) > weight[k]:
                        weight[k], back[k] = w, j
            best = max(best, max(weight) / size)
            used = [False] * len(own)
            for k in sorted(range(len(own)), key=lambda k: (-weight[k], k)):
                if weight[k] < MIN_COVER * size:
                    break
                chain = [k]
                while back[chain[-1]] >= 0:
                    chain.append(back[chain[-1]])
                if not any(used[j] for j in chain):
                    last, _, n = own[chain[-1]]
                    found.append((self.texts[t][1], last - n + 1, own[k][0], min(1.0, weight[k] / size)))
                    for j in range(chain[-1], k + 1):  # other matches of the covered span are not chains of their own
                        used[j] = True
        return sorted(set(found), key=lambda x: (x[1], x[2], x[0], x[3])), min(1.0, best)


def scan_text(automaton: LicenceAutomaton, text: str | None) -> tuple:
    """A row of SCHEMA. score: the best cover of a chain; PHRASE_SCORE at least where a base phrase stands."""
    words = words_of(text)
    places, matches = automaton.scan(words)
    spans, cover = automaton.spans(matches)
    base = sorted({automaton.phrases[k][1] for _, k in places})
    labels = sorted({*base, *(x[0] for x in spans)})
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels),
        max(cover, PHRASE_SCORE if places else 0.0), [dict(zip(("label", "first", "last", "cover"), x, strict=True)) for x in spans],
    )


def scan_licences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, columns of SCHEMA) for every row: base places, labels, score and covered spans of its whole text.

    The automaton is built from the given texts on each worker; documents stream through it and nothing is shuffled. A
    text is scanned in one pass whatever its length, so a very long one takes time and memory in proportion. A null or
    empty text has no words, no labels and score 0. Repeated rows are scanned each, a null key stays null. Other columns
    don't come along, so theirs can't clash.
    """
    own = phrases or PHRASES, templates or TEMPLATES
    names = [x.split()[0] for x in SCHEMA.split(", ")[:7]] + ["spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LicenceAutomaton(*own)
        for pdf in batches:
            rows = [scan_text(automaton, x) for x in pdf["_text"]]
            out = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df_key(docs, key, text).mapInPandas(frugal(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}")


def df_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.col(text).alias("_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

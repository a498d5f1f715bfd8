"""Evaluation texts leaking into training text (problem 9).

The words of the test items go into generalised suffix automatons, which tasks build
and write to the shared folder: items are dealt by their id, so all texts of an item
stand in one automaton, and more items make more automatons of the same size. Each
document is streamed word by word through all of them in one pass; state and matching
length tell at every word the longest passage that ends there and stands in some item.
Documents are never shuffled. What a document loses is the union over all automatons,
judged and cut once, so the answer does not depend on how many there are.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise

#: Words in a row that make a leak.
MIN_WORDS = 13
#: Characters of items in one automaton, on average; some 30 bytes of automaton each.
AUTOMATON_CHARS = 1_000_000
#: Bytes of automatons sent to the executors at once; more are streamed in further waves.
WAVE_BYTES = 128 << 20
#: A document whose leaked words reach this share is dropped as a whole.
MAX_COVERAGE = 0.5

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, without case; none for null and empty."""
    return " ".join(_WORD.findall(text)).casefold().split() if text else []


class _Builder:
    """The automaton as it grows: ``step[state]`` maps a word id to the next state, ``link``
    is the suffix link and ``length`` the longest passage of a state."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur


class SuffixAutomaton:
    """A generalised suffix automaton over the word ids of many items, in flat arrays.

    Most states have one way on (``word``, ``next``); only those with several have a
    table of their own. ``held[state]`` numbers the set of items in which the passages
    of a state stand, 0 being none; states of fewer than *min_words* words hold none.
    """

    def __init__(self, texts: list[tuple[int, list[str]]], min_words: int) -> None:
        b, self.ids = _Builder(), {}
        ends: list[tuple[int, int]] = []
        for item, ws in texts:
            last = 0
            for w in ws:
                last = b.extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
        holders: dict[int, set[int]] = {}
        for state, item in ends:
            while b.length[state] >= min_words and item not in (h := holders.setdefault(state, set())):
                h.add(item)
                state = b.link[state]
        sets: dict[tuple, int] = {(): 0}
        self.held = array("i", (sets.setdefault(tuple(sorted(holders.get(s, ()))), len(sets)) for s in range(len(b.link))))
        self.sets = list(sets)
        self.link, self.length = array("i", b.link), array("i", b.length)
        self.word = array("i", (next(iter(t)) if len(t) == 1 else -1 for t in b.step))
        self.next = array("i", (next(iter(t.values())) if len(t) == 1 else -1 for t in b.step))
        self.ways = {s: t for s, t in enumerate(b.step) if len(t) > 1}

    def matches(self, ws: list[str], min_words: int) -> Iterator[tuple[int, int, int]]:
        """(last word, matching length, state) wherever at least *min_words* words match."""
        get, word, to_next, ways, link, length = self.ids.get, self.word, self.next, self.ways, self.link, self.length
        state = n = 0
        for i, w in enumerate(map(get, ws)):
            if w is None:
                state = n = 0
                continue
            while True:
                to = to_next[state] if word[state] == w else ways[state].get(w) if state in ways else None
                if to is not None or not state:
                    break
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= min_words:
                yield i, n, state

    def passages(self, n: int, state: int, min_words: int) -> Iterator[tuple[int, int]]:
        """(item, words) of each item in which at least *min_words* of the *n* words matched last stand: its longest such passage."""
        seen: tuple = ()
        while n >= min_words:
            items = self.sets[self.held[state]]
            if items is not seen:
                for item in items:
                    if item not in seen:
                        yield item, n
                seen = items
            state = self.link[state]
            n = self.length[state]


def automatons(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(chunk, n_bytes, automaton): built in tasks, written once. Repeated and wordless items count once or not."""
    texts = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    n_chars = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    n_chunks = max(1, -(-n_chars // AUTOMATON_CHARS))

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        sam = SuffixAutomaton([(int(i), words(t)) for i, t in zip(g["item_id"], g["text"])], min_words)
        made = pickle.dumps(sam, protocol=5)
        return pd.DataFrame({"chunk": [key[0]], "n_bytes": [len(made)], "automaton": [made]})

    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(n_chunks)).cast("int"))
    return materialise(dealt.groupBy("chunk").applyInPandas(build, "chunk int, n_bytes bigint, automaton binary"), "automatons")


def _waves(items: DataFrame, min_words: int) -> Iterator[list]:
    """The automatons as broadcast variables, in waves of WAVE_BYTES (or one automaton) at most."""
    made = automatons(items, min_words)
    wave, size = [], 0
    for r in [*made.select("chunk", "n_bytes").orderBy("chunk").collect(), None]:
        if r is None or (wave and size + r.n_bytes > WAVE_BYTES):
            if wave:
                got = made.where(F.col("chunk").isin(wave)).orderBy("chunk").select("automaton").collect()
                yield [items.sparkSession.sparkContext.broadcast(bytes(x.automaton)) for x in got]
            wave, size = [], 0
        if r is not None:
            wave.append(r.chunk)
            size += r.n_bytes


def _load(sent: list) -> list[SuffixAutomaton]:
    return [pickle.loads(s.value) for s in sent]


LEAK_SCHEMA = "doc_id bigint, item_id bigint, longest int, n_leaked int, n_words int"


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, n_leaked, n_words): documents with a passage of an item.

    ``longest`` is the longest such passage in words, ``n_leaked`` how many words of the
    document stand in passages of the item, ``n_words`` all its words. Items shorter than
    *min_words* leak nowhere; null and empty texts hold nothing; repeated items count
    once, several texts of one item together; documents are read whole.
    """
    out = None
    for wave in _waves(items, min_words):

        def run(batches: Iterator[pd.DataFrame], wave=wave) -> Iterator[pd.DataFrame]:
            sams = _load(wave)
            for b in batches:
                rows = []
                for doc_id, text in zip(b["doc_id"], b["text"]):
                    ws = words(text)
                    if len(ws) < min_words:
                        continue
                    for sam in sams:
                        hit: dict[int, list] = {}
                        for i, n, state in sam.matches(ws, min_words):
                            for item, m in sam.passages(n, state, min_words):
                                h = hit.setdefault(item, [0, 0, -1])
                                h[0] = max(h[0], m)
                                h[1] += i - max(i - m, h[2])
                                h[2] = i
                        rows += [(doc_id, item, h[0], h[1], len(ws)) for item, h in hit.items()]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAK_SCHEMA.split(", ")])

        got = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, LEAK_SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else documents.sparkSession.createDataFrame([], LEAK_SCHEMA)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold 13 words of the item's text in a row."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def clean(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(doc_id, text, n_removed): documents without their leaked passages.

    Each passage of *min_words* words or more goes, whatever item it stands in; a document
    of which more than *max_coverage* of the words leaked goes as a whole. Each wave of
    automatons adds the places it leaks to those of the waves before; the last step,
    in the same pass, judges their union and cuts.
    """
    out = documents.select("doc_id", "text", F.array().cast("array<int>").alias("bad"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, bad in zip(b["doc_id"], b["text"], b["bad"]):
                if bad is None or not len(bad):
                    rows.append((doc_id, text, 0))
                    continue
                at = list(_WORD.finditer(text))
                leaked = np.zeros(len(at), dtype=bool)
                leaked[np.asarray(bad)] = True
                if leaked.sum() > max_coverage * len(at):
                    continue
                parts, last = [], 0
                for a, z in zip(np.flatnonzero(np.diff(np.r_[0, leaked]) == 1), np.flatnonzero(np.diff(np.r_[leaked, 0]) == -1)):
                    parts.append(text[last : at[a].start()])
                    last = at[z].end()
                rows.append((doc_id, "".join([*parts, text[last:]]), int(leaked.sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_removed"])

    for wave in _waves(items, min_words):

        def mark(batches: Iterator[pd.DataFrame], wave=wave) -> Iterator[pd.DataFrame]:
            sams = _load(wave)
            for b in batches:
                every = []
                for text, bad in zip(b["text"], b["bad"]):
                    ws, places = words(text), set(bad)
                    for sam in sams:
                        for i, n, _ in sam.matches(ws, min_words):
                            places.update(range(i - n + 1, i + 1))
                    every.append(sorted(places))
                yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "bad": every})

        out = out.mapInPandas(mark, "doc_id bigint, text string, bad array<int>")
    return out.mapInPandas(cut, "doc_id bigint, text string, n_removed int")

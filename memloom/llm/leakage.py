"""Evaluation texts leaking into training text (problem 7).

The normalised test items form one generalised suffix automaton over words.  The corpus is streamed through it, document
by document, in a single pass without any shuffle: per word the automaton gives the length of the longest match that ends
there, and from ``min_words`` on the state tells all items that hold the match.

The automaton is sent to all tasks.  It grows with the test items only, never with the corpus, and a set of more than
``MAX_ITEM_WORDS`` words is refused (such a set has to be worked off in blocks of items).

Null and empty texts hold nothing; null item texts and items of fewer than ``min_words`` words match nothing; repeated item
rows and repeated documents give the same pairs, once per document row before ``distinct``; no texts are cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
MAX_ITEM_WORDS = 5_000_000
WORD = re.compile(r"[^\W_]+")


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that hold each state's strings."""

    min_words: int = MIN_WORDS
    vocabulary: dict[str, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[tuple[int, ...]] = field(default_factory=list)
    top: list[int] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:  # an earlier item had this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def add(self, words: list[str]) -> list[int]:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        return ids

    def finish(self, sequences: dict[int, list[list[int]]]) -> SuffixAutomaton:
        """sequences: word ids by item.  Marks each state with its items and finds the state of its shortest long suffix."""
        held: list[set[int]] = [set() for _ in self.length]
        for item, all_ids in sequences.items():
            for ids in all_ids:
                v = 0
                for w in ids:
                    v = self.step[v][w]
                    u = v
                    while u > 0 and item not in held[u]:
                        held[u].add(item)
                        u = self.link[u]
        self.items = [tuple(sorted(h)) for h in held]
        self.top = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[v]
            self.top[v] = self.top[up] if self.length[up] >= self.min_words else v
        return self

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(end word, length, state) of each match that can't be made longer to the right."""
        get, step, link, length, least = self.vocabulary.get, self.step, self.link, self.length, self.min_words
        out, v, n = [], 0, 0
        for i, word in enumerate(words):
            w = get(word, -1)
            if w < 0:
                if n >= least:
                    out.append((i - 1, n, v))
                v = n = 0
                continue
            nxt = step[v].get(w, -1)
            if nxt < 0:
                if n >= least:
                    out.append((i - 1, n, v))
                while nxt < 0 and v:
                    v = link[v]
                    nxt = step[v].get(w, -1)
                n = length[v]
            if nxt >= 0:
                v, n = nxt, n + 1
        if n >= least:
            out.append((len(words) - 1, n, v))
        return out

    def leaks(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item -> word spans (start, end exclusive) that it shares with the text, each at least min_words long.

        Within a maximal match each window of min_words words is looked up, since items may share a part of it only.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for end, n, _ in self.matches(words):
            start = end - n + 1
            v = length = 0
            for i in range(start, end + 1):
                w = self.vocabulary[words[i]]
                while v and w not in self.step[v]:
                    v = self.link[v]
                    length = self.length[v]
                if w in self.step[v]:
                    v, length = self.step[v][w], length + 1
                if length >= self.min_words:
                    for item in self.items[self.top[v]]:
                        spans = found.setdefault(item, [])
                        lo = i - self.min_words + 1
                        if spans and spans[-1][1] >= lo:
                            spans[-1] = (spans[-1][0], i + 1)
                        else:
                            spans.append((lo, i + 1))
        return found


def build(items: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_ITEM_WORDS) -> SuffixAutomaton:
    sam, seqs, total = SuffixAutomaton(min_words), {}, 0
    for r in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = WORD.findall(r.text.lower())
        total += len(words)
        if total > max_words:
            raise ValueError(f"more than {max_words} words of test items; pass them in blocks")
        if len(words) >= min_words:
            seqs.setdefault(r.item_id, []).append(sam.add(words))
    return sam.finish(seqs)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_share): matched words of each item in each document."""
    sam = build(items, min_words)
    sizes = dict.fromkeys(sorted({i for s in sam.items for i in s}), 0)
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if r.item_id in sizes:
            sizes[r.item_id] = max(sizes[r.item_id], len(WORD.findall(r.text.lower())))
    shared = documents.sparkSession.sparkContext.broadcast((sam, sizes))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("covered", pa.int32()), ("item_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam, sizes = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = WORD.findall((text.as_py() or "").lower())
                if len(words) < sam.min_words:
                    continue
                for item, spans in sam.leaks(words).items():
                    covered = sum(e - s for s, e in spans)
                    rows.append((doc, item, max(e - s for s, e in spans), covered, min(1.0, covered / max(1, sizes[item]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "doc_id BIGINT, item_id BIGINT, longest INT, covered INT, item_share DOUBLE")


def cut_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_span: int = MIN_WORDS, max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, n_cut): documents without the spans of items that exceed a limit.

    Spans of at least ``max_span`` words go, and all spans of an item of which the document holds more than ``max_share``.
    """
    sam = build(items, min_words)
    shared = documents.sparkSession.sparkContext.broadcast(sam)
    lengths = {}
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        lengths[r.item_id] = max(lengths.get(r.item_id, 0), len(WORD.findall(r.text.lower())))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_cut", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = shared.value
        for b in batches:
            texts, cuts = [], []
            for text in b.column("text").to_pylist():
                at = list(WORD.finditer(text or ""))
                gone = set()
                for item, spans in sam.leaks([m.group().lower() for m in at]).items():
                    share = sum(e - s for s, e in spans) / max(1, lengths[item])
                    for s, e in spans:
                        if e - s >= max_span or share > max_share:
                            gone.update(range(s, e))
                if gone:
                    parts, pos = [], 0
                    for i in sorted(gone):
                        if i - 1 not in gone:
                            parts.append(text[pos : at[i].start()])
                        pos = at[i].end()
                    text = "".join([*parts, text[pos:]])
                texts.append(text)
                cuts.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(cuts, pa.int32())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, text STRING, n_cut INT")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each document that gives an item away."""
    return leaks(documents, items).where("doc_id IS NOT NULL").select("doc_id", "item_id").distinct()


def by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Which test items leaked: number of documents and longest passage."""
    return leaks(documents, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"), F.max("item_share").alias("item_share"))

"""License scans: matching statistics on a generalised suffix automaton of template words, chained to spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.words import LETTERED, text_slices, words_of

# fixed values: the phrases of the base labels
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# fixed values: notices and texts of public licences
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0"],
}

LEAST = 3  # words of a match that enters a chain
GAP = 12  # document words a chain may step over
COVER = 0.7  # share of a template's words that a chain covers to give its label


def template_words(text: str) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


class Automaton:
    """Suffix automaton of several word sequences. ``ends[state]``: (template, last word) of every place of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for template, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((template, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(dict(edges))
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, start: int, word: int, target: int) -> int:
        """A copy of ``target`` for the strings that end at ``start`` and go on with ``word``."""
        copy = self._state(self.length[start] + 1, self.link[target], self.next[target])
        self.link[target] = copy
        while start >= 0 and self.next[start].get(word) == target:
            self.next[start][word] = copy
            start = self.link[start]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(document begin, length, template, template begin) of matches that can't be made longer to the right."""
        state, size = 0, 0
        for at, word in enumerate([*words, -1]):
            before, had = state, size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state, size = (self.next[state][word], size + 1) if word in self.next[state] else (0, 0)
            if size <= had and had >= least:
                for template, end in self.ends[before]:
                    yield at - had, had, template, end - had + 1


def chain(matches: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int]:
    """Best chain of (document begin, length, template begin): words covered, document begin and end.

    Both places grow along a chain, overlaps count once, and at most ``gap`` document words lie between
    neighbours. Matches come in the order of their begins; one that ends more than ``gap`` words before the
    next begin is out of reach for all that follow, so only those whose end is near are looked at, however
    long they are.
    """
    if not matches:
        return 0, 0, 0
    doc, size, place = np.array(matches, dtype=np.int64).T
    covered, begin = size.copy(), doc.copy()
    near = np.zeros(0, dtype=np.int64)
    for k in range(len(matches)):
        near = near[doc[near] + size[near] >= doc[k] - gap]
        before = near[(doc[near] < doc[k]) & (place[near] < place[k])]
        if len(before):
            shared = np.maximum(0, np.maximum(doc[before] + size[before] - doc[k], place[before] + size[before] - place[k]))
            sums = covered[before] + size[k] - shared
            best = before[np.lexsort((begin[before], -sums))[0]]
            if sums.max() > size[k]:
                covered[k], begin[k] = sums.max(), begin[best]
        near = np.append(near, k)
    top = np.lexsort((-(doc + size), begin, -covered))[0]
    return int(covered[top]), int(begin[top]), int(doc[top] + size[top])


def templates_from(table: DataFrame, label_column: str = "label", text_column: str = "text", most: int = 10_000) -> dict[str, list[str]]:
    """Templates from a table of licence texts. The table goes through the driver and into every task, so more than
    ``most`` rows raise; rows without a label or a word are left out."""
    rows = table.select(F.col(label_column).cast("string"), text_column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    out: dict[str, list[str]] = {}
    for label, text in sorted(r for r in map(tuple, rows) if None not in r):
        if template_words(text):
            out.setdefault(label, []).append(text)
    return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [k for k, texts in templates.items() for _ in texts]
        sequences = [template_words(t) for texts in templates.values() for t in texts]
        self.phrases = {k: p.split() for k, p in phrases.items()}
        vocabulary = sorted({w for s in [*sequences, *self.phrases.values()] for w in s})
        ids = {w: i for i, w in enumerate(vocabulary)}
        raw = " ".join(vocabulary).encode()
        hashes = words_of(slice(0, 1), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), LETTERED).hashes
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[ids[w] for w in s] for s in sequences])
        self.phrase_ids = {k: [ids[w] for w in p] for k, p in self.phrases.items()}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for all others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def covered(self, ids: np.ndarray, runs: list[tuple[int, int]]) -> dict[int, tuple[float, int, int]]:
        """Per template: share covered by its best chain, and the chain's span in document words."""
        found: dict[int, list] = {}
        for a, b in runs:
            for doc, size, template, place in self.automaton.matches(ids[a:b].tolist(), min([LEAST, *self.sizes])):
                found.setdefault(template, []).append((a + doc, size, place))
        out = {}
        for template, matches in found.items():
            words, begin, end = chain(sorted(set(matches)), GAP)
            out[template] = (words / self.sizes[template], begin, end)
        return out


SCAN = "id {id}, n_words long, places array<struct<label:string,word:int>>, chains array<struct<label:string,share:double,begin:int,end:int>>"


def _scan(scanner_of):
    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        place_kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())]))
        chain_kind = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for rows, data, offsets in text_slices(batch.column(1)):
                words = words_of(rows, data, offsets, LETTERED)
                ids = scanner.word_ids(words.hashes)
                texts = words.texts()
                places: list[list] = [[] for _ in range(texts)]
                chains: list[list] = [[] for _ in range(texts)]
                for label, phrase in scanner.phrase_ids.items():
                    hit = np.flatnonzero(ids[:len(ids) - len(phrase) + 1] == phrase[0]) if len(ids) >= len(phrase) else np.zeros(0, int)
                    for k, word in enumerate(phrase):
                        hit = hit[ids[hit + k] == word]
                    owner = np.searchsorted(words.first, hit, side="right") - 1
                    for at, text in zip(hit[hit + len(phrase) <= words.first[owner + 1]].tolist(), owner[hit + len(phrase) <= words.first[owner + 1]].tolist()):
                        places[text].append({"label": label, "word": at - int(words.first[text])})
                # only runs of template words can hold a match
                known = ids >= 0
                edge = np.zeros(len(ids) + 1, dtype=bool)
                edge[words.first[:-1]] = True
                begins = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
                run_begin = np.flatnonzero(begins)
                owner = np.searchsorted(words.first, run_begin, side="right") - 1
                run_end = np.minimum(words.first[owner + 1], _run_ends(known, run_begin))
                long = np.flatnonzero(run_end - run_begin >= LEAST)
                by_text: dict[int, list] = {}
                for k in long:
                    by_text.setdefault(int(owner[k]), []).append((int(run_begin[k]), int(run_end[k])))
                for text, runs in by_text.items():
                    shift = int(words.first[text])
                    for template, (share, begin, end) in scanner.covered(ids, runs).items():
                        chains[text].append({"label": scanner.labels[template], "share": min(1.0, share), "begin": begin - shift, "end": end - shift})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, texts), pa.array(np.diff(words.first), pa.int64()), pa.array(places, place_kind), pa.array(chains, chain_kind)],
                    ["id", "n_words", "places", "chains"],
                )

    return run


def _run_ends(known: np.ndarray, begins: np.ndarray) -> np.ndarray:
    stops = np.append(np.flatnonzero(~known), len(known))
    return stops[np.searchsorted(stops, begins)]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cover: float = COVER,
                  templates: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``places``, ``chains``, ``base_labels``, ``labels``, ``score`` for every row.

    ``places``: every place of a base phrase (label, first word). ``chains``: per template the best chain of
    matches, its share of the template's words and its span in document words. ``labels``: base labels and the
    labels of templates covered by ``cover`` or more, sorted. ``score``: the largest share, 1 for a base
    phrase. A NULL text is empty. Whole texts are read. Repeated rows are judged alike, other columns are
    ignored, an empty table gives no rows. Of chains that cover equally many words the one that begins first
    counts, then the longest. ``templates`` is a table of licence texts (``label``, ``text``) to use instead of ``TEMPLATES``.
    """
    kind = dict(docs.dtypes)[id_column]
    known = TEMPLATES if templates is None else templates_from(templates)
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(_scan(lambda: Scanner(known)), SCAN.format(id=kind))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    more = F.transform(F.filter("chains", lambda x: x["share"] >= cover), lambda x: x["label"])
    share = F.coalesce(F.array_max(F.transform("chains", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "places", "chains", base.alias("base_labels"),
        F.array_sort(F.array_union(base, more)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"))

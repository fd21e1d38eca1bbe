"""Personal data: base patterns as seeds, and contexts learned from them that lead to further identifiers.

Seeds and other identifier-like runs of all texts are the instances; one to three words in front of them, and one to
three behind, are the patterns. Spark scores the graph between patterns and instances in rounds until it settles: a
pattern is worth the mean belief of the instances that it leads to, an instance is believed as far as some good
pattern leads to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # distinct seeds a pattern must lead to
CONFIDENCE = 0.5
CONTEXT_WORDS = 3  # on each side, at most
LEAST_CHARS = 5  # of a whole candidate, not of its pieces
LONG = 64  # characters; longer words and instances stand in the graph as their digests

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match within a run of digits always starts with the run
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = ".,;:!?()[]{}<>\"'|"
_BLANK = "\x20\t\n\x0b\x0c\r"
_PIECE = re.compile(r"[0-9A-Z()\[\]+./-]*")  # of an identifier in several pieces: digit groups, capitals, joints
_JOINT = re.compile(r"[\x20().-]{1,3}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each ``@``: the run of local characters in front starts the leftmost match. Linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        else:
            done = at  # the run in front belongs to this sign only
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _short(word: str) -> str:
    return word if len(word) <= LONG else "#" + hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()


def context(text: str, start: int, end: int) -> list[str]:
    """Patterns of text[start:end]: the last one to three words in front (``<``), the next one to three behind (``>``).

    A-Z lower-cased; a text's begin and end are words of their own (``^``, ``$``). Marks alone are no word.
    """
    front, at = [], start
    while len(front) < CONTEXT_WORDS:
        while at > 0 and text[at - 1] in _BLANK:
            at -= 1
        stop = at
        while at > 0 and text[at - 1] not in _BLANK:
            at -= 1
        if at == stop:
            front.append("^")
            break
        if text[at:stop].strip(_EDGE):
            front.append(_short(text[at:stop].lower()))
    behind, at, size = [], end, len(text)
    while len(behind) < CONTEXT_WORDS:
        while at < size and text[at] in _BLANK:
            at += 1
        begin = at
        while at < size and text[at] not in _BLANK:
            at += 1
        if begin == at:
            behind.append("$")
            break
        if text[begin:at].strip(_EDGE):
            behind.append(_short(text[begin:at].lower()))
    return ["<" + " ".join(front[k::-1]) for k in range(len(front))] + [">" + " ".join(behind[:k + 1]) for k in range(len(behind))]


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of identifier-like runs outside the sorted spans ``taken``.

    A token with a digit or ``@``, without the marks at its edges; next to each other, tokens of digits, capitals and
    joints only are one run, whatever their lengths, unless a mark other than a bracket, hyphen or dot parts them.
    """
    begin = end = None
    at = reach = 0  # reach: the furthest end of the spans passed
    loose = False  # the run may go on
    for m in _TOKEN.finditer(text):
        word = m.group()
        start, stop = m.start() + len(word) - len(word.lstrip(_EDGE)), m.start() + len(word.rstrip(_EDGE))
        while at < len(taken) and taken[at][0] < stop:
            reach, at = max(reach, taken[at][1]), at + 1
        if start >= stop or reach > start:
            loose = False
            continue
        piece = bool(_PIECE.fullmatch(word))
        if loose and piece and _JOINT.fullmatch(text, end, start):
            end = stop
        else:
            if begin is not None and end - begin >= LEAST_CHARS:
                yield begin, end
            begin, end = start, stop
        loose = piece and not word.endswith(".")
    if begin is not None and end - begin >= LEAST_CHARS:
        yield begin, end


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
TOKEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())])


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, tokens = [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py() or ""
            own = base_spans(text)
            more = [(-1, a, b) for a, b in candidates(text, sorted((a, b) for _, a, b in own))]
            seen = [{"kind": k, "start": a, "end": b, "patterns": context(text, a, b), "instance": _short(text[a:b].lower())} for k, a, b in own + more]
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            tokens.append(seen)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(tokens, pa.list_(TOKEN))], ["id", "spans", "tokens"])


def learn_patterns(edges: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(patterns, beliefs): accepted (``pattern``, ``kind``, ``score``), and (``instance``, ``kind``, ``belief``).

    ``edges``: distinct ``pattern``, ``instance``, ``seed`` (kind, or -1). Each round is two aggregations: patterns over
    their instances, instances over their patterns; nothing is gathered. Patterns of one side of an instance lie in
    each other, so its best pattern in front and its best behind make its belief. Scores never fall and are held
    in hundredths, so the rounds end by themselves; ``rounds`` ends them earlier.
    """
    seeds = edges.where("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    pairs = edges.select("pattern", "instance").distinct()
    sizes = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    pairs, beliefs, sizes = checkpointed(pairs), checkpointed(seeds), checkpointed(sizes)
    done, before = 0, None
    while True:
        held = pairs.join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"), F.sum(F.when(F.col("belief") >= confidence, 1)).alias("sure"))
        patterns = held.where(F.col("sure") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("score"))
        patterns = checkpointed(patterns.where(F.col("score") >= confidence).withColumn("score", F.round("score", 2)))
        done += 1
        now = tuple(patterns.agg(F.count(F.lit(1)), F.sum(F.round(F.col("score") * 100).cast("long"))).first())
        if now == before:
            return patterns, beliefs
        before = now
        front = F.col("pattern").startswith("<")
        led = pairs.join(patterns, "pattern").groupBy("instance", "kind").agg(*[
            (1 - F.coalesce(F.max(F.when(side, F.least("score", F.lit(0.999)))), F.lit(0.0))).alias(name) for side, name in ((front, "f"), (~front, "b"))])
        led = led.select("instance", "kind", (1 - F.col("f") * F.col("b")).alias("belief"))
        beliefs = checkpointed(led.unionByName(seeds).groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
        if done == rounds:
            return patterns, beliefs


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id``, ``spans`` (base) and ``found`` (learned): arrays of (kind, start, end) in code points, by kind, then start.

    A learned span is an identifier-like run (``candidates``: five or more characters in all, one of them a digit or
    ``@``) outside the base spans, with a pattern accepted for a kind in front or behind, and believed. A NULL text is empty. Repeated rows are each
    reported and count once as evidence. Without seeds nothing is learned.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    columns = "spans array<struct<kind:int,start:int,end:int>>, tokens array<struct<kind:int,start:int,end:int,patterns:array<string>,instance:string>>"
    read = checkpointed(rows.mapInArrow(_extract, f"id {kind}, {columns}"))
    seen = read.select(F.xxhash64("id", "tokens").alias("key"), F.explode("tokens").alias("t"))
    seen = seen.select("key", "t.kind", "t.start", "t.end", "t.instance", F.explode("t.patterns").alias("pattern"))
    edges = checkpointed(seen.groupBy("pattern", "instance", F.col("kind").alias("seed")).agg(F.lit(1).alias("one")).drop("one"))
    patterns, beliefs = learn_patterns(edges, rounds, support, confidence)
    new = (
        seen.where("kind < 0").select("key", "start", "end", "pattern", "instance")
        .join(patterns.select("pattern", "kind", "score"), "pattern")
        .join(beliefs.where(F.col("belief") >= confidence), ["instance", "kind"])
        .groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    )
    keyed = read.withColumn("key", F.xxhash64("id", "tokens"))
    return keyed.join(new, "key", "left").select(
        F.col("id").alias("doc_id"), "spans", F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("found"))


def span_text(spans: str | Column, prefix: str = "") -> Column:
    names = F.array(*[F.lit(prefix + k) for k in KINDS])
    return F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))

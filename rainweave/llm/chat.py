"""Chat formatting in budgeted windows: whole turns, the system turn kept, some history repeated, repeated targets masked.

Template of a turn: ``<turn ROLE>``, a line feed, the text, ``</turn>`` and a line feed. In roles and texts a
backslash comes before every backslash, ``<``, ``>`` and ``#``, so no control string appears inside them and
the text is read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.llm.text import count_spaced_words

BUDGET = 1024  # tokens of a window
HISTORY = 256  # tokens of repeated turns in front of the new ones
TURN_TOKENS = 4  # of the marks around a turn
CHUNK = 1024  # turn numbers of a slice
TARGET = "assistant"
SYSTEM = "system"

_CONTROL = re.compile(r"[\\<>#]")
_ESCAPED = re.compile(r"\\([\\<>#])")
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

WINDOWS = "conv_id bigint, window bigint, text string, n_system int, n_history int, n_new int, targets array<struct<begin:int,end:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the escaped text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(turn[1]), unescape(turn[2]), turn.start(2), turn.end(2)))
        at = turn.end()
    return out


def _tokens(text: str) -> int:
    return TURN_TOKENS + sum(1 for _ in _WORD.finditer(text))


KEYS = ["missing", "conv"]
SLICE = [*KEYS, "chunk"]
ORDER = ["turn", "role", "text"]


def _leading_system(rows: DataFrame, budget: int) -> DataFrame:
    """``missing``, ``conv``, ``system``: the leading system turns that together fit ``budget``, in order.

    The room only shrinks, so of equal sizes the first ones are kept: at most budget / size turns of each size are compared.
    """
    first = rows.where(F.col("role") != SYSTEM).groupBy(*KEYS).agg(F.min(F.struct("turn", "role")).alias("first"))
    leading = rows.where((F.col("role") == SYSTEM) & (F.col("tokens") <= budget)).join(first, KEYS, "left")
    leading = leading.where(F.col("first").isNull() | (F.struct("turn", "role") < F.col("first")))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "tokens").orderBy(*ORDER))
    few = leading.withColumn("rank", rank).where(F.col("rank") <= budget // TURN_TOKENS).where(F.col("rank") * F.col("tokens") <= budget)
    listed = few.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*ORDER, "tokens"))).alias("given"))
    kind = listed.schema["given"].dataType
    kept = F.aggregate("given", F.struct(F.array().cast(kind).alias("turns"), F.lit(0).cast("long").alias("size")), lambda out, t: F.when(
        out["size"] + t["tokens"] <= budget,
        F.struct(F.concat(out["turns"], F.array(t)).alias("turns"), (out["size"] + t["tokens"]).alias("size"))).otherwise(out))
    return listed.select(*KEYS, kept.alias("kept")).select(*KEYS, F.col("kept.turns").alias("system"), F.col("kept.size").alias("system_tokens"))


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Every turn with ``number`` and ``before``, the turns and tokens before it, and ``cell``, ``room``, ``wide``, ``system``.

    Two-level prefix sums: inside slices of a conversation, and over the sums of its slices. ``room`` is what the system
    turns leave of the budget, ``wide`` the tokens of a cell; the rest of the room is for history.
    """
    inside = Window.partitionBy(*SLICE).orderBy(*ORDER)
    earlier = Window.partitionBy(*KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*SLICE).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    starts = sums.select(*SLICE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in ("t", "n")])
    starts = starts.join(_leading_system(rows, budget), KEYS, "left").withColumn("room", budget - F.coalesce("system_tokens", F.lit(0)))
    starts = starts.withColumn("wide", F.greatest(F.col("room") - history, F.floor(F.col("room") / 2), F.lit(TURN_TOKENS)))
    sliced = rows.withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(inside))
    return sliced.join(starts, SLICE).select(
        *KEYS, *ORDER, "tokens", (F.col("n_offset") + F.col("k") - 1).alias("number"), (F.col("t_offset") + F.col("upto") - F.col("tokens")).alias("before"),
        "room", "wide", "system", F.floor((F.col("t_offset") + F.col("upto") - 1) / F.col("wide")).alias("cell"))


HEAD, PAST, NEW, ALONE = range(4)


def _spans(placed: DataFrame, history: int) -> DataFrame:
    """``missing``, ``conv``, ``cell``, ``turns``: the turns that end in a cell of the prefix sums, and the last ones before it.

    A turn that starts so far before its cell that both do not fit the room is marked ``ALONE`` and goes with the turns before it.
    """
    cell, wide, before = F.col("cell"), F.col("wide"), F.col("before")
    own = F.when(before > 0, F.floor((before - 1) / wide)).otherwise(-1)
    marked = placed.withColumn("own", own).withColumn("alone", cell * wide - before > F.col("room") - wide)
    alone, system = F.col("alone"), F.col("system")
    near = ~alone & (F.col("tokens") <= history) & (before >= (cell + 1) * wide - (F.col("room") - wide) - history)
    none = F.lit(None).cast(placed.schema["system"].dataType)

    def part(kind: Column, at: Column, head: Column, text: Column) -> Column:
        return F.struct(at.alias("cell"), F.struct("number", kind.alias("kind"), "turn", "role", text.alias("text"), "tokens", head.alias("system")).alias("turn"))

    parts = F.array_compact(F.array(
        part(F.when(alone, ALONE).otherwise(NEW), F.when(alone, F.greatest("own", F.lit(0))).otherwise(cell), F.when(alone | (F.col("own") != cell), system), F.col("text")),
        F.when(near, part(F.lit(PAST), cell + 1, none, F.col("text"))),
        F.when(alone, part(F.lit(HEAD), cell, system, F.lit(""))),
    ))
    dealt = marked.select(*KEYS, F.explode(parts).alias("part")).select(*KEYS, "part.cell", "part.turn")
    return dealt.groupBy(*KEYS, "cell").agg(F.collect_list("turn").alias("turns"))


def _key(turn: dict) -> tuple:
    return turn["turn"] is not None, turn["turn"] if turn["turn"] is not None else 0, turn["role"], turn["text"]


def _windows(turns: list[dict], budget: int, history: int) -> Iterator[tuple]:
    """The windows of one cell: its new turns, and each turn that stands alone."""
    system = next((t["system"] for t in turns if t["system"]), [])
    kept = {_key(t) for t in system}
    own = sorted((t for t in turns if t["kind"] != HEAD), key=lambda t: t["number"])
    new = [t for t in own if t["kind"] == NEW]
    for span in [*([new] if new else []), *([t] for t in own if t["kind"] == ALONE)]:
        first, spent = span[0], sum(t["tokens"] for t in span)
        head = [t for t in system if _key(t) < _key(first)]
        while head and spent + sum(t["tokens"] for t in head) > budget:
            head.pop()
        left = min(history, budget - spent - sum(t["tokens"] for t in head))
        past, at = [], first["number"]
        for turn in reversed([t for t in own if t["number"] < at]):
            left -= turn["tokens"]
            if turn["number"] != at - 1 or left < 0 or _key(turn) in kept:
                break
            past.insert(0, turn)
            at -= 1
        parts, targets, end = [], [], 0
        for k, turn in enumerate([*head, *past, *span]):
            open_mark, body = f"<turn {escape(turn['role'])}>\n", escape(turn["text"])
            end += len(open_mark)
            if k >= len(head) + len(past) and turn["role"] == TARGET:
                targets.append({"begin": end, "end": end + len(body)})
            parts.append(f"{open_mark}{body}</turn>\n")
            end += len(body) + 8
        yield first["number"], "".join(parts), len(head), len(past), len(span), targets


def _build(budget: int, history: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
    names = ["conv_id", "window", "text", "n_system", "n_history", "n_new", "targets"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0), batch.column(1)):
                rows += [(conv.as_py(), *w) for w in _windows(turns.as_py(), budget, history)]
                if len(rows) >= 500:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return run


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                         conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Formatted windows: ``conv_id``, ``window`` (number of its first new turn), ``text``, ``n_system``, ``n_history``, ``n_new``, ``targets``.

    ``targets`` is the loss mask: (begin, end) in code points of ``text``, the assistant texts that are new in the
    window, each in one window only. Prefix sums of the turns' tokens (words, and a few for the marks) are cut into cells of
    equal width, and a window takes the turns that end in one cell; a turn that reaches too far back over the border of its cell stands alone, as
    does one above the budget. All others keep whole turns within ``budget``. In front come the leading system turns
    before the window and the last turns of the cell before that fit ``history`` and the rest of the budget; a window without room for the
    system turns lacks the last of them. Leading system turns that together pass the budget: those that fit in order
    are repeated, each other one stands once. NULL texts and roles are empty; a NULL conversation id is one conversation. Turns (numbers)
    that are equal go by role, then text, a NULL number first; repeated rows are repeated turns, and a system turn equal to the
    first new one is not repeated before it. Other columns are not read.

    A conversation is spread by slices of turn numbers, then by cells. Rows that share one number, NULL included, share a slice,
    which is sorted on disk if need be. Turn numbers are numeric.
    """
    number = F.floor(F.col(turn_column) / CHUNK).cast("long")
    rows = turns.select(
        F.col(conv_column).isNull().alias("missing"), F.coalesce(F.col(conv_column).cast("long"), F.lit(0)).alias("conv"),
        F.coalesce(number, F.lit(-(1 << 62))).alias("chunk"), F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", count_spaced_words(F.col("text")) + TURN_TOKENS)
    spans = _spans(_placed(rows, budget, history), history)
    return spans.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), "turns").mapInArrow(_build(budget, history), WINDOWS)


def _digest(batches) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, rows = None, []

    def close():
        rows.append((state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

    def flush():
        columns = list(zip(*rows)) if rows else [[]] * 6
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        rows.clear()
        return batch

    for batch in batches:
        for conv, _, text, n_system, n_history, _, targets in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv != state["conv"]:
                if state is not None:
                    close()
                state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            for role, body, *_ in read_turns(text)[n_system + n_history:]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{body}\n".encode())
            for span in targets:
                body = unescape(text[span["begin"]:span["end"]])
                state["chars"] += len(body)
                state["loss"].update(body.encode())
            state["size"] += len(text)
        if len(rows) >= 500:
            yield flush()
    if state is not None:
        close()
    yield flush()


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted windows alone, in order. A digest is sequential by nature: the windows
    of a conversation pass one task as a stream, which holds one batch."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

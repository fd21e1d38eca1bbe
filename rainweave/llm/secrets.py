"""Secret scans by a trigram index: Boolean trigram queries, postings, then the patterns themselves."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.llm.text import lower_ascii, row_key
from rainweave.session import checkpointed

try:
    from re import _parser as regex_parser
except ImportError:  # before Python 3.11
    import sre_parse as regex_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose ``group`` has fewer than
    ``least`` characters are dropped. The pattern must mean the same in Java and Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64  # alternatives followed as exact strings before they are turned into trigrams
SLICE_ROWS = 4096  # rows per slice of the postings

# A query is True (no condition), a trigram, or ("and" | "or", [queries]).


def _both(queries: Iterable) -> object:
    parts = [q for q in queries if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _either(queries: Iterable) -> object:
    parts = list(queries)
    return True if any(q is True for q in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _low(char: str) -> str:
    return char.lower() if char.isascii() else char


def _grams(strings: set[str]) -> object:
    """Every match has one of these strings in it. A string that asks for all that another asks for adds nothing."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(o < s for o in sets)]
    return _either(_both(sorted(s)) for s in sorted(least, key=sorted))


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings that a pattern matches, if few, else None; a query that its matches fulfil)."""
    exact, query, whole = {""}, True, True
    for op, arg in items:
        name = str(op)
        strings, inner = None, True  # a wide class, a look-around, a back reference: no condition
        if name == "LITERAL":
            strings = {_low(chr(arg))}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            strings = {_low(chr(v)) for _, v in arg}
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                inner = _either(q if s is None else _grams(s) for s, q in parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            once, asked = _walk(arg[2])
            if arg[1] == 1 and once is not None:
                strings = once if arg[0] else once | {""}
            elif arg[0] > 0:
                inner = asked if once is None else _grams(once)
        elif name == "AT":
            continue
        if strings is None or len(exact) * len(strings) > MOST_STRINGS:
            query, exact, whole = _both([query, _grams(exact), inner]), strings or {""}, False
        else:
            exact = {a + b for a, b in product(exact, strings)}
    return (exact, True) if whole else (None, _both([query, _grams(exact)]))


def trigram_query(pattern: str) -> object:
    """Boolean query over trigrams of the lower-cased text that every match fulfils; True without any."""
    strings, query = _walk(regex_parser.parse(pattern))
    return query if strings is None else _both([query, _grams(strings)])


def trigrams_in(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


def postings(keyed: DataFrame, vocabulary: list[str], slices: int) -> DataFrame:
    """``slice`` and one array of row keys per trigram of the vocabulary, from the whole texts."""
    low = keyed.select("key", F.pmod("key", F.lit(slices)).alias("slice"), lower_ascii(F.col("text")).alias("low"))
    flags = low.select("key", "slice", *[F.contains("low", F.lit(g)).alias(f"g{i}") for i, g in enumerate(vocabulary)])
    return flags.groupBy("slice").agg(*[F.collect_set(F.when(F.col(f"g{i}"), F.col("key"))).alias(f"g{i}") for i in range(len(vocabulary))])


def _answer(query: object, place: dict[str, int]) -> Column:
    if isinstance(query, str):
        return F.col(f"g{place[query]}")
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [_answer(q, place) for q in query[1]])


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, end, kind) of the rule's matches in code points; the gaps between matches give the places."""
    pattern = rule.pattern
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    sized = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.char_length(g)).alias("gap"),
        F.transform(found, lambda m: F.char_length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), rule.group), lambda m: F.char_length(m)).alias("part"),
    )
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    return F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                x["part"] >= rule.least,
                F.concat(s["out"], F.array(F.struct(
                    (s["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), (s["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans``: (start, order, end, kind) in code points, by start, then rule.

    Rules with mandatory trigrams are tried only on rows that their postings name; the others scan
    all texts. A NULL text is empty. Repeated rows share a key in the index and are each reported.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"))
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit(""))
    keyed = rows.select("row", row_key(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns]).alias("key"))
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = [i for i, q in queries.items() if q is not True]
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = [_spans(text, r, i) for i, r in enumerate(rules) if i not in indexed]
    if indexed:
        vocabulary = sorted(set().union(*(trigrams_in(queries[i]) for i in indexed)))
        place = {g: i for i, g in enumerate(vocabulary)}
        slices = max(12, docs.count() // SLICE_ROWS)
        index = checkpointed(postings(keyed.select("key", text.alias("text")), vocabulary, slices))
        named = reduce(DataFrame.union, [index.select(F.explode(_answer(queries[i], place)).alias("named"), F.lit(i).alias("rule")) for i in indexed])
        named = checkpointed(named.groupBy("named").agg(F.collect_set("rule").alias("rules")))
        keyed = keyed.join(named, F.col("key") == F.col("named"), "left").select("row", "rules")
        parts += [F.when(F.array_contains("rules", i), _spans(text, rules[i], i)) for i in indexed]
    found = keyed.select("row", *[F.coalesce(p, empty).alias(f"p{i}") for i, p in enumerate(parts)])
    return found.select("row", F.sort_array(F.concat(*[F.col(f"p{i}") for i in range(len(parts))])).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[{}]") -> Column:
    """The text with every span replaced by its kind; of overlapping spans the union is replaced once."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans, state,
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))))).otherwise(s["out"]).alias("out"),
        )),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """``docs`` with secrets replaced by their kind; texts without secrets stay as they are."""
    text = F.col(f"row.`{text_column}`")
    found = scan(docs, rules, text_column)
    return found.select(*[
        (F.when(F.size("spans") > 0, redacted(text, F.col("spans"))).otherwise(text) if c == text_column else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
    ])

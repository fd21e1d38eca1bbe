import random
import re

from pyspark.sql import functions as F

from rainweave.llm import ngram_join
from rainweave.llm.ngram_join import ngram_components


def brute_sets(rows):
    out = []
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((doc, {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    return out


def brute(rows):
    sets = brute_sets(rows)
    parent, links = {doc: doc for doc, _ in sets}, [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
                links[i] += 1
                links[j] += 1
    return sorted(((doc, len(s), root(doc), n) for (doc, s), n in zip(sets, links)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in ngram_components(docs).collect()), key=str)
    assert got == brute(rows)


def corpus(seed, documents=260):
    pick = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    passage = [pick.choice(word) for _ in range(30)]
    rows, roots = [], [[pick.choice(word) for _ in range(pick.choice((3, 5, 12, 40, 200)))] for _ in range(12)]
    for doc in range(documents):
        words = list(pick.choice(roots)) if pick.random() < 0.7 else [pick.choice(word) for _ in range(40)]
        for _ in range(pick.choice((0, 0, 1, 1, 2, 3))):
            words[pick.randrange(len(words))] = pick.choice(word)
        if pick.random() < 0.3:
            words += passage[:pick.choice((8, 30))]
        rows.append((doc * 7 % 1009, pick.choice((" ", "\n", " \t")).join(w.upper() if pick.random() < 0.05 else w for w in words)))
    return rows


def test_equals_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_without_the_merging_step(spark, monkeypatch):
    """The column blocks find every component by themselves."""
    monkeypatch.setattr(ngram_join, "KEYS", 0)
    monkeypatch.setattr(ngram_join, "PAIR_CHUNK", 50)
    check(spark, corpus(9))


def test_groups_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    monkeypatch.setattr(ngram_join, "AGREE", 1)
    monkeypatch.setattr(ngram_join, "TILE_COLUMNS", 16)
    check(spark, corpus(4))


def test_borders(spark):
    base = [f"a{i}" for i in range(44)]
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two three"), (7, "one two three four five"),
        (8, " ".join(base)), (9, " ".join(base[:34])), (10, " ".join(base[:35])), (11, "É b c d e f"), (12, "é b c d e f"),
        (None, "one"), (13, "x" * 300_000), (14, "x" * 300_000), (15, " ".join(base * 900)), (16, " ".join(base * 700)),
    ]
    check(spark, rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string").withColumns(
        {c: F.lit("z") for c in ("id", "n", "same", "node", "a", "b", "component", "sketch")})
    assert {tuple(r) for r in ngram_components(docs).collect()} == {(1, 1, 1, 1), (2, 1, 1, 1)}

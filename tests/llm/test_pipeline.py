"""The whole pipeline against a plain version, stage by stage in Python, on a small corpus."""

import random
import re

import duckdb

import corpus_pipeline
from rainweave.llm import quality_rules, secrets
from rainweave.llm import sql as twins
from tests.llm.test_ngram_join import brute

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def good(text):
    """All rules of the table, from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 8)}
    n, stop = len(words), set(quality_rules.STOP_WORDS.split())
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    size = sum(map(len, words)) / n
    stops = sum(w.lower() in stop for w in words)
    bangs = sum(bool(re.search(r"(!!\s+\S+){3}", x)) for x in lines)
    return (1.5 <= size <= 40 and len(re.findall(r"[#*$%&|<>]", text)) <= 0.4 * n and (n < 60 or 100 * stops >= 0.5 * n)
            and 100 * (len(lines) - len(set(lines))) <= 60 * len(lines) and 100 * bangs <= 60 * len(lines))


def without_passages(text, items):
    """The text without words inside a window of an item; None for a text that mostly consists of them."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    low, hit = [w.group().lower() for w in words], set()
    for item in items:
        own = item.lower().split()
        size = min(10, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(low) - size + 1):
            if tuple(low[i:i + size]) in windows:
                hit.update(range(i, i + size))
    if len(hit) > 0.5 * len(low):
        return None
    for i in sorted(hit, reverse=True):
        text = text[:words[i].start()] + text[words[i].end():]
    return text


def masked(text):
    spans = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.RULES)
                   for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least)
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def corpus(pick):
    word = [f"w{i}" for i in range(500)] + ["the", "of", "and"] * 40
    rows, roots = [], [[pick.choice(word) for _ in range(90)] for _ in range(8)]
    for doc in range(120):
        words = list(pick.choice(roots)) if pick.random() < 0.4 else [pick.choice(word) for _ in range(pick.choice((5, 25, 90, 200)))]
        for _ in range(pick.choice((0, 1, 2))):
            words[pick.randrange(len(words))] = pick.choice(word)
        at = pick.randrange(len(words))
        odd = pick.choice([[], [], [], ITEM.upper().split(), ["password", "=", "hunter22abc"], ["AKIA" + "A1B2" * 5], ["#", "*"] * 60, words[:30]])
        rows.append((doc, " ".join(words[:at] + odd + words[at:]), "en", pick.choice(("a", "b", "c", None)), 1))
    clean = " ".join(f"c{i} of" for i in range(60))
    return rows + [(200, None, None, None, None), (201, "", "en", "a", 0), (202, clean, "en", "a", 9), (203, clean, None, None, 9), (204, "ok the " + ITEM + " ok " + ITEM, "en", "b", 3)]


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows = corpus(random.Random(5))
    items = [(1, ITEM), (2, None), (3, "c7 of c8 of")]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if good(r[1])]
    first = {doc for doc, _, component, _ in brute([(r[0], r[1]) for r in kept]) if doc == component}
    kept = [r for r in kept if r[0] in first]
    kept = [(r[0], without_passages(r[1], [x or "" for _, x in items]), r[3]) for r in kept]
    kept = [(doc, masked(text), source) for doc, text, source in kept if text is not None]
    assert 20 < len(kept) < 90 and any("[assign]" in t for _, t, _ in kept) and any("[access]" in t for _, t, _ in kept)

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", kept)
    want = {doc: (size, total, target, taken) for doc, size, total, target, taken in con.execute(twins.MIX).fetchall()}
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == {doc for doc, row in want.items() if row[3] > 0}
    for doc in got:
        size, total, target, taken = want[doc]
        assert got[doc][:2] == (size, total) and abs(got[doc][2] - target) < 1e-6 and got[doc][3] == taken

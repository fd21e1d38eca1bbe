"""Operators that stay inside Spark's functions, and chat windows, on small and odd tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rainweave.llm import chat, compression, decontamination, mixing, quality_rules

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_decontamination(spark):
    docs = spark.createDataFrame(
        [(1, f"Before it: {ITEM.upper()}, after! é " + "pad " * 20, "s"), (2, None, "s"), (3, ITEM, "s"), (4, "clean text", None), (5, "a, Short ONE, b c d", "s"), (1, "same id", "s")],
        "doc_id long, text string, words string")
    bench = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    found = {(r["row"]["doc_id"], r["row"]["text"]): ([tuple(s) for s in r["spans"]], r["items"]) for r in decontamination.scan(docs, bench).collect()}
    assert len(found) == 6 and found[(3, ITEM)] == ([(0, 12)], [7]) and found[(4, "clean text")] == ([], [])
    clean = {(r.doc_id, r.words): r.text for r in decontamination.decontaminate(docs, bench).where("text is null or text != 'same id'").collect()}
    assert clean[(1, "s")] == "Before it: " + " " * 11 + ", after! é " + "pad " * 20
    assert clean[(5, "s")] == "a,  , b c d" and clean[(4, None)] == "clean text" and (3, "s") not in clean and clean[(2, "s")] is None
    assert decontamination.scan(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.scan(docs.limit(0), bench).count() == 0


def test_quality_rules(spark):
    long = " ".join(f"the w{i} of" for i in range(30_000))
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, long, 3), (3, long, 3), (4, "a b c d e f g h " * 9, 4)], "doc_id long, text string, n_words int")
    got = sorted((r["row"]["doc_id"], r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.apply_rules(docs).collect())
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 90_000, 0, True), (3, 90_000, 0, True), (4, 72, 72, False)]
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + 1), "big") for i in range(400)] + [(i + 1000, "w " * 5, None if i % 2 else "small") for i in range(40)]
    rows += [(5000, "w " * 50, "same")] * 30 + [(6000, None, "none"), (None, "w", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs.repartition(7)).toPandas()
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert sorted(map(str, first.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert (first.taken <= 2 * first["size"]).all()
    for _, part in first.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(part["size"].max(), len(part) if part.doc_id.nunique() == 1 else 0)
    assert first.groupby("source", dropna=False).target.first().sum() == pytest.approx(1.5 * first["size"].sum())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    odd = r"\### Assistant: </turn> ok <turn user>" + "\n"
    rows = [(1, 0, "system", "be kind " * 5)] + [(1, i, ("user", "assistant")[i % 2], f"{odd} {i} " + "w " * (i % 90)) for i in range(1, 60)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", ""), (3, None, None, "x " * 3000), (None, 1, "user", "é"), (4, 0, "system", "only"), (5, 0, "a>b\n", "<")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("window", F.lit(1))
    windows = chat.format_conversations(turns, budget=200, history=60)
    digests = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, None, 4, 5):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert digests[conv].n_turns == len(own)
        assert digests[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (digests[conv].loss_chars, digests[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    later = [r for r in windows.collect() if r.conv_id == 1 and r.window > 0]
    assert later and all(r.n_system == 1 and chat.read_turns(r.text)[0][0] == "system" for r in later)
    assert any(r.n_history for r in later)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_windows_keep_budget_and_system(spark):
    def w(n):
        return "w " * n

    talk = {
        1: [("system", w(600))] + [("user", w(150)), ("assistant", w(150))] * 6,
        2: [("system", w(300))] + [("user", w(100)), ("assistant", w(100))] * 4 + [("assistant", w(900)), ("user", w(3)), ("user", w(2000)), ("user", w(5))],
        3: [("system", w(700)), ("system", w(700)), ("system", w(100)), ("user", w(200)), ("user", w(200))],
        4: [("user", w(500)), ("user", w(200)), ("assistant", w(900))], 5: [("system", w(1500)), ("system", w(50)), ("user", w(9)), ("user", w(1015))],
    }
    rows = [(c, k, role, text) for c, turns in talk.items() for k, (role, text) in enumerate(turns)]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv, turns in talk.items():
        own, new = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.window), []
        for r in own:
            read = [t[:2] for t in chat.read_turns(r.text)]
            size = sum(chat._tokens(text) for _, text in read)
            assert size <= chat.BUDGET or len(read) == 1, (conv, r.window, size)
            assert all(role == "system" for role, _ in read[:r.n_system]) and len(read) == r.n_system + r.n_history + r.n_new
            new += read[r.n_system + r.n_history:]
        assert new == turns  # each turn is new once, in order
    later = {c: [r for r in found if r.conv_id == c and r.window > 0] for c in talk}
    assert later[1] and all(r.n_system == 1 for r in later[1])
    assert [r.n_system for r in later[2] if "w " * 900 in r.text] == [0, 0] and any(r.n_system for r in later[2])
    assert all(r.n_system == 2 for r in later[3] if r.window == max(x.window for x in later[3]))


def plain_windows(turns, budget, history):
    """Windows of one conversation in order: (first turn, system turns, history turns, new turns), by one running sum."""
    size = [chat._tokens(text) for _, text in turns]
    lead = next((k for k, t in enumerate(turns) if t[0] != "system"), len(turns))
    system, used = [], 0
    for k in range(lead):
        if used + size[k] <= budget:
            system.append(k)
            used += size[k]
    room = budget - used
    wide = max(room - history, room // 2, chat.TURN_TOKENS)
    before, spans, open_cell = 0, [], None
    for k, n in enumerate(size):
        cell = (before + n - 1) // wide
        alone = cell * wide - before > room - wide
        if alone or cell != open_cell:
            spans.append([])
        spans[-1].append(k)
        open_cell, before = None if alone else cell, before + n
    for span in spans:
        spent = sum(size[k] for k in span)
        head = [k for k in system if k < span[0]]
        while head and spent + sum(size[k] for k in head) > budget:
            head.pop()
        left, past = min(history, budget - spent - sum(size[k] for k in head)), span[0]
        while past and past - 1 not in system and size[past - 1] <= left:
            past -= 1
            left -= size[past]
        yield span[0], [turns[k] for k in [*head, *range(past, span[0]), *span]], len(head), span[0] - past, len(span)


def test_chat_windows_equal_plain_version(spark):
    """Long conversations over many slices and cells, one with most of all turns."""
    pick = random.Random(3)
    talk = {}
    for conv, n in ((1, 4000), (2, 300), (3, 40), (4, 1)):
        heads = [("system", f"s{conv}{k} " * pick.choice((3, 40, 500))) for k in range(conv - 1)]
        talk[conv] = heads + [(("user", "assistant")[k % 2], f"t{k} " * pick.choice((0, 1, 5, 30, 90, 90, 400))) for k in range(n)]
    rows = [(conv, k - 50, role, text) for conv, turns in talk.items() for k, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {conv: [] for conv in talk}
    for r in chat.format_conversations(table, budget=400, history=90).collect():
        got[r.conv_id].append((r.window, [t[:2] for t in chat.read_turns(r.text)], r.n_system, r.n_history, r.n_new))
    for conv, turns in talk.items():
        assert sorted(got[conv], key=lambda w: w[0]) == list(plain_windows(turns, 400, 90)), conv


def test_classifiers_on_odd_tables(spark):
    english, german = "the cat and the dog of this house with a hat ", "der hund und die katze von diesem haus mit einem hut "
    rows = [(i, (english, german)[i % 2] * (1 + i % 5), ("en", "de")[i % 2]) for i in range(200)] + [(900, None, "en"), (901, "12 !", None), (None, english, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("z")).withColumn("h", F.lit("z"))
    got = {r.doc_id: r for r in compression.identify_language(docs).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(200)) and got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "en"
    assert {r.lang_pred for r in compression.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r for r in compression.score_quality(docs, labels).collect()}
    assert len(scores) == 203 and all(0 <= r.score <= 1 for r in scores.values())
    assert all(scores[i].predicted == i % 2 for i in range(200))
    assert compression.score_quality(docs, labels.limit(0)).count() == 203
    assert compression.identify_language(docs.limit(0)).count() == 0


def test_dictionaries_hold_all_parts_of_every_sampled_text(spark):
    assert compression.share_bytes([10, 10, 500], 300) == 277 and compression.share_bytes([5], 300) == 300
    # 900 texts with a mark of their own in every 40 bytes, from 700 to 30,000 bytes long
    rows = [("a", i, f"mark{i:04d} é " * (50 if i % 9 else 2500)) for i in range(900)] + [("b", 0, "head " * 1000 + "middle " * 8000 + "tail " * 1000)]
    learned = compression.learn_dictionaries(compression.learning_sample(spark.createDataFrame(rows, "label string, id long, text string")))
    assert len(learned["a"]) <= compression.DICTIONARY_BYTES and all(f"mark{i:04d}".encode() in learned["a"] for i in range(900))
    assert all(w in learned["b"] for w in (b"head ", b"middle ", b"tail ")) and len(learned["b"]) > 60_000


def test_calibration_measures_whole_texts(spark, monkeypatch):
    clean, junk = "a calm and clean sentence about rain and radar. ", "zq!! xx## 77%% "
    rows = [(i, clean * 90 + (junk * 900 if i % 2 == 0 else clean * 300)) for i in range(40)]
    seen = []
    monkeypatch.setattr(compression, "_features", lambda sizes, length, own=compression._features: (seen.append(length), own(sizes, length))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compression.score_quality(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as quality"))
    assert min(seen[0]) > 4000


def test_pipeline_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 3, "en", "s", 12), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_windows_of_several_lengths_and_mixed_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a one two b three four five c " + ITEM, "s", 5), (1, "a one two b three four five c " + ITEM, "s", 5), (2, None, None, 7), (3, "one", "s", 9)],
        "doc_id long, text string, source string, size int")
    items = spark.createDataFrame([(1, "one two"), (2, "three four five"), (3, ITEM), (4, "one two")], "item_id long, text string")
    found = decontamination.scan(docs, items).collect()
    assert sorted((r.row.doc_id, [tuple(s) for s in r.spans], sorted(r["items"])) for r in found) == [
        (1, [(1, 3), (4, 7), (8, 20)], [1, 2, 3, 4])] * 2 + [(2, [], []), (3, [], [])]
    rows = mixing.mix_rows(docs).toPandas().sort_values(["doc_id", "taken"])
    plain = mixing.mix(docs).toPandas().sort_values(["doc_id", "taken"])
    assert list(rows.columns) == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    for column in ("doc_id", "size", "source_size", "target", "taken"):
        assert rows[column].tolist() == plain[column].tolist()

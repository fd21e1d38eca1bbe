"""The classifiers by compressed size against plain single-process versions."""

import math
import random
import zlib

import pytest
import zstandard

from rainweave.llm import compression

KINDS = {"sa": "lorem ipsum dolor amet sunt elit quis nulla vita cor".split(), "sb": "kala vesi talo puu maa yksi kaksi ilma tuli tie".split(),
         "sc": "grad nebo voda zima leto more reka put dan noc".split()}


def texts(seed, n):
    pick = random.Random(seed)
    rows = []
    for doc in range(n):
        kind = pick.choice(sorted(KINDS))
        words = [pick.choice(KINDS[kind]) + pick.choice(("", "", "s", "e", "a")) for _ in range(pick.choice((1, 4, 30, 120, 900)))]
        rows.append((doc, " ".join(words), kind))
    return rows


def plain_sizes(text, dictionaries):
    out = []
    for data in dictionaries:
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(compression.LEVEL, min_match=compression.LEAST_MATCH, write_content_size=False, write_dict_id=False)
        out.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress((text or "").encode())))
    return out


def is_held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.fixture
def learned(monkeypatch):
    """What each call of learn_dictionaries gave, and the sample that it saw."""
    seen, own = [], compression.learn_dictionaries

    def spied(sample):
        seen.append(own(sample))
        return seen[-1]

    monkeypatch.setattr(compression, "learn_dictionaries", spied)
    return seen


def test_language_is_the_smallest_plain_size(spark, learned):
    rows = texts(1, 150) + [(900, None, "sa"), (901, "12 34 !", "sb"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in compression.identify_language(docs).collect()}
    assert got.keys() == {r[0] for r in rows}
    langs = sorted(learned[0])
    for doc, text, _ in rows:
        assert got[doc].held_out == is_held_out(doc)
        if not text or not any(c.isalpha() for c in text):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        sizes = plain_sizes(text, [learned[0][k] for k in langs])
        first, second = sorted(sizes)[:2]
        assert got[doc].lang_pred == langs[sizes.index(first)]
        assert got[doc].score == pytest.approx(1 / (1 + math.exp(-(second - first) / 4)))
        assert got[doc].rejected == (second - first < compression.NARROW * second)
    right = [got[doc].lang_pred == lang for doc, text, lang in rows[:150] if is_held_out(doc) and len(text) > 100]
    assert len(right) > 10 and all(right)


def test_quality_rises_with_the_plain_difference_alone(spark, learned):
    rows = [(doc, text, int(kind == "sa")) for doc, text, kind in texts(2, 240) if kind != "sc"]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in compression.score_quality(docs, labels).collect()}
    plain = {}
    for doc, text in [r[:2] for r in rows] + [(900, None), (901, "")]:
        bad, good = plain_sizes(text, [learned[0][0], learned[0][1]])
        plain[doc] = (bad - good) / math.sqrt(1 + len((text or "").encode()))
        assert got[doc].predicted == int(got[doc].score >= 0.3) and 0 <= got[doc].score <= 1
    assert got[900].score == got[901].score
    # one curve for all: equal differences have equal scores, and the log odds are a line over the difference
    inside = [(plain[d], math.log(r.score / (1 - r.score))) for d, r in got.items() if 1e-9 < r.score < 1 - 1e-9]
    (x0, y0), (x1, y1) = min(inside), max(inside)
    slope = (y1 - y0) / (x1 - x0)
    assert slope > 0 and all(y == pytest.approx(y0 + slope * (x - x0), abs=1e-6) for x, y in inside)
    judged = [(got[d].predicted, q) for d, text, q in rows if is_held_out(d) and len(text) > 100]
    assert len(judged) > 10 and all(p == q for p, q in judged)


def test_calibration_equals_plain_ascent():
    pick = random.Random(3)
    x = [pick.gauss(0, 2) for _ in range(300)]
    y = [float(pick.random() < 1 / (1 + math.exp(-(0.5 + 1.2 * v)))) for v in x]
    import numpy as np

    fit, middle, spread = compression._calibrate(np.array([[1.0, v] for v in x]), np.array(y))
    a = b = 0.0
    scaled = [(v - middle[1]) / spread[1] for v in x]
    for _ in range(4000):
        p = [1 / (1 + math.exp(-(a + b * v))) for v in scaled]
        a += 0.01 * (sum(t - q for t, q in zip(y, p)) - 1e-2 * a)
        b += 0.01 * (sum((t - q) * v for t, q, v in zip(y, p, scaled)) - 1e-2 * b)
    assert fit == pytest.approx([a, b], abs=1e-6)

"""Lexical search, phrase mining and licence scans, each against a plain definition."""

import random

from . import brute
import numpy as np
import pyarrow as pa
import pytest
from terrachron.llm import collocations, lexical_search, license_scan, spans, terms

WORDS = [f"{a}{b}" for a in "bcdfghkl" for b in ("a", "e", "io", "ü")] + ["X", "9", "É"]


def texts(rng, n, longest=60):
    sep = [" "] * 12 + [", ", ". ", "\n", "\t", "  ", "-"]
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return ["".join(w + rng.choice(sep) for w in rng.choices(WORDS, weights, k=rng.randint(0, longest))) for _ in range(n)]


def weak(monkeypatch):
    """Hashes that most words share."""

    class Weak:
        def __init__(self, data):
            pass

        def __call__(self, first, last):
            return (last - first).astype(np.uint64)

    monkeypatch.setattr(spans, "Hashes", Weak)


def test_vocabulary_tells_words_apart_that_share_a_hash(monkeypatch):
    words = ["ab", "cd", "é", "abc", "x"]
    data = np.frombuffer("ab é cd ef x abc zz abd".encode(), dtype=np.uint8)
    block = spans.Block(0, data, np.array([0]), np.array([len(data)]))
    for make_weak in (False, True):
        if make_weak:
            weak(monkeypatch)
        first, last, _ = block.words(terms.APART)
        assert terms.Vocabulary(words).find(data, first, last).tolist() == [0, 2, 1, -1, 4, 3, -1, -1]
    assert terms.Vocabulary([]).find(data, first, last).tolist() == [-1] * 8


def test_search(spark, monkeypatch):
    rng = random.Random(21)
    plain = texts(rng, 300)
    docs = [(i, t) for i, t in enumerate(plain)]
    docs += [(1000 + i, plain[7].upper().replace("Ü", "ü")) for i in range(120)]  # one class
    docs += [(2000 + i, plain[i].replace(" ", "  ")) for i in range(40)] + [(3, plain[5]), (3, plain[3])]
    docs += [(None, plain[9]), (None, None), (5000, None), (5001, ""), (5002, "unknown words"), (5003, "ba " * 30_000)]
    items = [(i, t) for i, t in enumerate(texts(rng, 25, 12))] + [(3, "bio"), (None, "ba É"), (90, None), (91, "nowhere"), (92, "...")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, n int").repartition(7)
    asked = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    for blocks in (lexical_search.BLOCK_PAIRS, 40):  # one pass, and many
        for depth in (3, 50):
            got = lexical_search.search(frame, asked, depth, block_pairs=blocks)
            assert got.columns == ["item_id", "rank", "doc_id", "score"]
            assert brute.by_id(map(tuple, got.collect())) == brute.search(docs, items, depth)
    assert lexical_search.search(frame.limit(0), asked).collect() == []
    assert lexical_search.search(frame, asked.limit(0)).collect() == []


def test_search_in_small_steps(monkeypatch):
    """Scores held in pieces of a few classes give the same best classes."""
    rng = random.Random(5)
    items = lexical_search.Items([(i, w) for i in range(6) for w in rng.sample(WORDS, 9)])
    weights = np.arange(1, len(items.vocabulary) + 1) * 100
    rows = []
    for k in range(200):
        words = sorted(rng.sample(range(len(weights)), rng.randint(1, 8)))
        rows.append(dict(vector=np.array([(w, rng.randint(1, 3)) for w in words], dtype="<i4").tobytes(), m=rng.choice([50, 70]), first_id=rng.choice([k, None]), members=1))
        rows[-1]["class"] = k
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 70]) for i in (0, 70, 140)]
    whole = [b.to_pylist() for b in lexical_search._scored(items, weights, 5)(iter(batches))]
    monkeypatch.setattr(lexical_search, "HELD", 64)
    assert [b.to_pylist() for b in lexical_search._scored(items, weights, 5)(iter(batches))] == whole and len(whole[0]) == 30


@pytest.mark.parametrize("depth, widths", [(2000, (16, 512)), (4, (1, 2)), (10, (1,)), (3, ())])
def test_collocations(spark, depth, widths):
    rng = random.Random(31)
    rows = [(t, rng.choice(["en", "en", "fr", None, "und"])) for t in texts(rng, 400, 50)]
    rows += [("one fixed phrase of words", "en")] * 30 + [("one fixed Phrase", "fr")] * 12 + [("tie a. tie b! b tie; a tie", "de")] * 10
    rows += [(None, "en"), ("", None), ("a a a a a a a a a a a a a", "xx"), ("alone", "yy"), ("ba ce " * 20_000, "long")]
    frame = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, n int, rank int").repartition(5)
    got = collocations.collocations(frame, depth=depth, widths=widths)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute.phrases(rows, depth)


def test_collocations_of_empty_tables(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(frame).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_words_that_share_a_key_are_told_apart(monkeypatch):
    rows = ["ab cd ab ef", "cd, x", None, "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(["en", "en", None, "fr"])], ["text", "lang"])

    def count():
        found = {}
        for b in collocations._words(0)(iter([batch])):
            for r in b.to_pylist():
                found[r["lang"], r["word"]] = found.get((r["lang"], r["word"]), 0) + r["n"]
        return found

    plain = count()
    assert plain == {("en", "ab"): 2, ("en", "cd"): 2, ("en", "ef"): 1, ("en", "x"): 1, ("fr", "ab"): 1}
    weak(monkeypatch)
    assert count() == plain


def test_keys_are_hashed_anew_after_a_collision(spark, monkeypatch):
    docs = spark.createDataFrame([("ab cd ab", "en")], "text string, lang string")
    tried = []

    def clash(seed):
        tried.append(seed)
        mine = collocations_words(seed)

        def run(batches):
            for b in mine(batches):
                key = b.column("key") if seed else pa.array([0] * b.num_rows, pa.int64())
                yield b.set_column(0, "key", key)

        return run

    collocations_words = collocations._words
    monkeypatch.setattr(collocations, "_words", clash)
    found, seed = collocations.words(collocations.ship(docs))
    assert seed == 1 and tried == [0, 1] and {r.word: r.n for r in found.collect()} == {"ab": 2, "cd": 1}


MIT = license_scan.TEMPLATES[0][1]
GIVEN = [
    ("Released under the MIT License.", "mit", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc"),
    ("licensed under the Apache License, Version 2.0", "apache-2", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "", "gpl-2"),
    ("GNU Lesser General Public License version 2.1", "", "lgpl-2.1"),
    ("GNU General Public License", "", ""),
    ("under the MIT brand license", "", ""),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "", "cc-by-sa"),
    ("distributed under the terms of the MIT license", "", "mit"),
    ("cc by nc", "cc-by-nc", "cc-by-nc"),
]


def filled(nodes, rng, breadth):
    """Words that a template accepts: some optional regions, some words for the replaceable ones."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        elif n[0] == "any":
            out += [rng.choice(WORDS) for _ in range(rng.randint(n[1], n[2]))]
        elif rng.random() < breadth:
            out += filled(n[1], rng, breadth)
    return out


def plain_scan(text):
    """(words, base places, base labels, labels) by trying every template at every word."""
    words = brute.terms(text)
    base = [(i, label) for label, p in license_scan.BASE for i in range(len(words)) if brute.accepts(license_scan.parse(p), words[i:]) - {0}]
    labels = {x for _, x in base}
    for label, markup in license_scan.TEMPLATES:
        nodes = license_scan.parse(markup)
        if any(brute.accepts(nodes, words[i:]) for i in range(len(words))):
            labels.add(label)
    places = [i for i, _ in base]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_license_scan(spark):
    rng = random.Random(41)
    cases = [None, "", "...", *(t for t, _, _ in GIVEN), "\n".join(t for t, _, _ in GIVEN)]
    for label, markup in license_scan.TEMPLATES:
        nodes = license_scan.parse(markup)
        for breadth in (0.0, 0.6, 1.0):
            words = filled(nodes, rng, breadth)
            around = texts(rng, 2, 20)
            cases.append(f"{around[0]} {' '.join(words)} {around[1]}")
            broken = list(words)
            broken[rng.randrange(len(broken))] = "other"
            cases.append(" ".join(broken))
    cases.append(("filler, " * 1500) + "Released under the MIT License. " + "cc by-nc by-nc cc by nc")
    rows = [(i % 90 if i != 4 else None, t, 1) for i, t in enumerate(cases)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int").repartition(3)
    scanned = license_scan.scan_licenses(docs)
    got = license_scan.digest(scanned).drop("score").collect()
    expected = [(i, *plain_scan(t)) for i, t, _ in rows]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    scores = [r.score for r in license_scan.digest(scanned).collect()]
    assert all(0 <= s <= 1 for s in scores) and max(scores) == 1
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text, base, labels", GIVEN)
def test_given_notices(text, base, labels):
    assert plain_scan(text)[4:] == (base, labels)


def test_longest_passages_and_their_places():
    found = license_scan.compiled((), [("t", "[[the {{name:1-2}}]] alpha beta [[gamma {{more:0-2}} delta]]")])
    anchors = license_scan._anchors(found)
    for text, expected in {
        "see the big red alpha beta gamma x delta end": [(0, 1, 9)],
        "alpha beta alpha beta": [(0, 0, 2), (0, 2, 4)],
        "the one alpha beta gamma a b c delta": [(0, 0, 4)],
        "alpha x beta": [],
        "the alpha beta": [(0, 1, 3)],
    }.items():
        block = next(spans.blocks(pa.array([text])))
        assert license_scan.passages(block, found, anchors)[1] == [expected]


@pytest.mark.parametrize("markup", ["{{x:0-3}}", "[[only]]", "a [[b", "a b]]"])
def test_templates_that_are_refused(markup):
    with pytest.raises(ValueError):
        license_scan.Template("x", markup)

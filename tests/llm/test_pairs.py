"""Exact dedup, Jaccard join, suffix dedup and components against plain definitions."""

import random

from . import brute
import numpy as np
import pytest
from terrachron.llm import components, exact_dedup, jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string"
ODD = [(None, "a b"), (None, "a  b"), (None, None), (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2004, "ONE"), (2005, "x" * 3000)]


@pytest.mark.parametrize("rows", [[], ODD, [(i % 7, random.Random(i).choice(["a b", "a\tb", "a b ", "", "c"])) for i in range(60)]])
def test_exact_groups(spark, rows):
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert brute.by_id(map(tuple, got)) == brute.exact(rows)


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(3, "a b", "x"), (1, "a  b", "y"), (2, "c", "z"), (2, "c", "w"), (None, "a b", "n"), (9, None, "q"), (8, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_digest string")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(r["doc_id"] for r in kept.collect())
    assert found == [1, 2, 8]


def edited(rng, words, base):
    base = list(base)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
        if base:
            k, r = rng.randrange(len(base)), rng.random()
            if r < 0.5:
                base[k] = rng.choice(words)
            elif r < 0.8:
                del base[k]
            else:
                base.insert(k, rng.choice(words))
    return " ".join(base)


def test_jaccard_components(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 30, 80, 200]))] for _ in range(15)]
    rows = [(i * 3 % 301, edited(rng, words, rng.choice(bases[:5]))) for i in range(300)] + ODD
    rows += [(3000, "É a b c d e"), (3001, "é a b c d e"), (3002, "w1 w2 w3 w4"), (3003, "W1 w2\tw3 w4"), (5, "w1 w2 w3 w4 w5 w6")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert brute.by_id(map(tuple, jaccard_join.jaccard_components(docs).collect())) == brute.jaccard(rows)
    # Every token counted and late in the order, small batches.
    monkeypatch.setattr(jaccard_join, "PROBE", 1)
    monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", 500)
    assert brute.by_id(map(tuple, jaccard_join.jaccard_components(docs).collect())) == brute.jaccard(rows)


def test_jaccard_join_of_nothing_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_components(empty).collect() == []
    rows = [(2, "a b c d e f", "u"), (1, "a b c d e f", "v"), (3, None, "w"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = jaccard_join.keep_smallest(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep = rng.random(len(a)) < 0.93
        b = np.unique(np.concatenate((a[keep], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 12))).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 80 * (len(a) + len(b) - common):
            continue
        frequent = np.sort(rng.choice(a, len(a) // 3, replace=False))
        p, q = (jaccard_join.prefix_of(s, frequent, 80) for s in (a, b))
        least = min(1 + 80 * len(x) // (100 * jaccard_join.EXTRA) for x in (a, b))
        assert len(np.intersect1d(p, q)) >= least


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (9, 8), (8, 9)], "u long, v long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {7: 7, 5: 5, 8: 8, 9: 8} | {i: 7 for i in range(200, 260)}
    assert components.components(edges.where("u < 0")).collect() == []


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 400, 2000):
        for low, high in ((0, 1), (0, 2), (97, 99), (97, 110)):
            text = rng.integers(low, high, n).astype(np.uint8)
            raw, order = text.tobytes(), suffix_dedup.suffix_order(text)
            assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
            shared = suffix_dedup.common_prefixes(text, order, 50, 64)
            for x, y in zip(order, order[1:]):
                k = 0
                while k < 50 and max(x, y) + k < n and raw[x + k] == raw[y + k]:
                    k += 1
                assert shared[y] == k


@pytest.mark.parametrize("hot_probes", [16, 1])
def test_remove_repeats(spark, hot_probes, monkeypatch):
    """With one probe per anchor, shared anchors are split over shards and merged."""
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "PROBE", 16 if hot_probes > 1 else 1)
    rng = random.Random(3)
    letters = "abcdefghij é"
    parts = ["".join(rng.choice(letters) for _ in range(rng.choice([40, 49, 50, 51, 60, 120, 400]))) for _ in range(12)]
    rows = []
    for _ in range(150):
        some = [rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 9))]
        rows.append((rng.randint(0, 170), "".join(some)))
    rows += [(None, parts[6] * 3), (None, parts[5]), (7, None), (7, ""), (5, parts[6] + parts[5]), (3, "ab" * 500), (4, "ba" * 400), (600, "x" * 49), (5, "\x00" * 120), (6, "\x00" * 60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = suffix_dedup.remove_repeats(docs, hot_probes=hot_probes)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert brute.by_id(map(tuple, got)) == brute.unrepeated(rows)


def test_without_repeats_keeps_columns(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(2, f"é{passage} two", 1, "a"), (1, passage, 2, "b"), (3, None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, passage, 61, "b"), (2, "é two", 5, "a"), (3, "", 0, "c")]
    assert suffix_dedup.without_repeats(docs.limit(0)).collect() == []


def test_keep_one_keeps_texts_of_their_own_beside_a_copy(spark):
    rows = [(1, "a b"), (None, "a  b"), (None, "own"), (None, "other"), (7, "a\tb"), (7, "seven"), (None, "twice"), (None, "twice")]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "other"), (0, "own"), (0, "twice"), (1, "a b"), (7, "seven")]


def test_jaccard_links_rows_without_an_id_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, b + " more"), (None, c), (None, c), (3, a + " end"), (9, b + " end"), (11, "x y z"), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(None, 36, 3), (None, 36, 9), (None, 37, 9), (None, 36, None), (None, 36, None), (3, 37, 3), (9, 37, 9), (11, 1, 11), (None, 0, None)]
    assert brute.by_id(map(tuple, got)) == brute.by_id(expected)


def test_keep_smallest_drops_rows_and_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(7, a), (7, b), (3, b + " end"), (9, a + " end"), (None, c), (None, c + " end"), (None, d), (None, d), (None, a), (None, None), (12, None)]
    kept = jaccard_join.keep_smallest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == 6
    found = {(r.doc_id, (r.text or "-")[0]) for r in kept}
    assert found == {(7, "a"), (3, "b"), (None, "c"), (None, "d"), (None, "-"), (12, "-")}

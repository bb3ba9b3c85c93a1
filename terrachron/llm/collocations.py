"""Phrases whose words belong together, mined per language by best-first branch and bound.

A phrase grows from its prefix. A count of a phrase is at most that of its prefix, and so is every
score below a prefix: with a = f(x y z), the cut after x gives a*a / (f(x) * f(y z)) <= a / f(x) <=
f(x y) / f(x), known before any three words are counted. Prefixes with the best bounds are grown
first; a language is settled when its wanted number of phrases that survive score at least as high
as every bound that is left. Languages that are not settled get a wider frontier and another pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans, terms
from .common import ship, tidy, written

#: Phrases returned for each language.
DEPTH = 2000
#: Occurrences that make a phrase a candidate.
LEAST = 10
#: A candidate is dropped if a longer one that holds it has this share (per cent) of its count.
SHARE = 50
#: Prefixes of a language that are grown, as multiples of the wanted phrases; then all of them.
WIDTHS = (16, 512)
#: Bits of a filter (4 MB); when more keys share bits, more phrases are counted in vain.
FILTER_BITS = 25

SCALE = 1_000_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_ROTATION = 21


class Scan:
    """Words of a block of texts: byte ranges, a key of language and word, and what continues a piece."""

    def __init__(self, block: spans.Block, langs: np.ndarray, seed: int):
        self.data = terms.lower(block.data)
        self.first, self.last, self.doc = block.words(_APART)
        coded = self.data if not seed else np.random.default_rng(seed).permutation(256).astype(np.uint8)[self.data]
        self.lang = langs[block.first : block.first + len(block)][self.doc]
        self.keys = spans.mix(spans.Hashes(coded)(self.first, self.last) ^ self.lang)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[block.data])))[self.first]
        self.joined = (self.doc[1:] == self.doc[:-1]) & (breaks[1:] == breaks[:-1])


def _scans(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Scan, pa.Array, np.ndarray]]:
    for batch in batches:
        coded = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        names = coded.dictionary.to_pylist()
        marks = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names]
        langs = np.array(marks, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
        by_mark = np.argsort(np.array(marks, dtype=np.uint64))
        for block in spans.blocks(batch.column("text"), 4 * spans.BLOCK_BYTES):
            yield Scan(block, langs, seed), coded.dictionary.take(pa.array(by_mark)), np.array(marks, dtype=np.uint64)[by_mark]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position of each value, how often it occurs, and for each position the first one of its value."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(keys)))
    of = np.empty(len(keys), dtype=np.int64)
    of[order] = np.repeat(order[start], count)
    return order[start], count, of


def _words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, names, marks in _scans(batches, seed):
            if not len(s.keys):
                continue
            rep, count, of = _grouped(s.keys)
            length = s.last - s.first
            alike = (length == length[of]) & (s.lang == s.lang[of])
            same = np.flatnonzero(alike)
            alike[same] = terms.same_bytes(s.data, s.first[same], s.data, s.first[of[same]], length[same])
            odd = np.flatnonzero(~alike)  # words whose key is that of another word
            count = np.concatenate((count - np.bincount(np.searchsorted(s.keys[rep], s.keys[odd]), minlength=len(rep)), np.ones(len(odd), np.int64)))
            rep = np.concatenate((rep, odd))
            offsets = np.concatenate(([0], np.cumsum(length[rep]))).astype(np.int32)
            letters = s.data[terms.ragged(s.first[rep], length[rep])]
            word = pa.Array.from_buffers(
                pa.string(), len(rep), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())]
            )
            lang = names.take(pa.array(np.searchsorted(marks, s.lang[rep])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.keys[rep].view(np.int64)), lang, word, pa.array(count)], ["key", "lang", "word", "n"]
            )

    return tidy(run)


def words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(key, lang, word, n) of every word of every language, and the seed of its keys.

    Words are counted as they are written, so counts are exact. Keys are 64-bit hashes; if two
    words share one, all are hashed anew with another seed, so that keys stand for words exactly.
    """
    seed = 0
    while True:
        rows = docs.mapInArrow(_words(seed), "key bigint, lang string, word string, n bigint")
        found = written(rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")))
        if found.groupBy("key").count().where("count > 1").isEmpty():
            return found, seed
        seed += 1


def _slot(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    if y is not None:
        x = x ^ ((y << np.uint64(_ROTATION)) | (y >> np.uint64(64 - _ROTATION)))
    return (x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _slot_column(x: str, y: str | None = None) -> Column:
    turned = f" ^ (shiftleft({y}, {_ROTATION}) | shiftrightunsigned({y}, {64 - _ROTATION}))" if y else ""
    return F.expr(f"({x}{turned}) & {(1 << FILTER_BITS) - 1}L")


def bit_filter(keys: DataFrame, x: str, y: str | None = None) -> np.ndarray:
    """Bits of a fixed number of slots, set where a key of the frame falls; at most 4 MB whatever its size."""
    slot = keys.select(_slot_column(x, y).alias("slot"))
    cells = slot.select(
        F.expr("slot div 64").alias("cell"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")
    )
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def _has(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) != 0


def _counted(parts: tuple[np.ndarray, ...], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Each distinct row of keys with its number of occurrences, told apart by all of its keys."""
    if not len(parts[0]):
        return
    whole = parts[0]
    for p in parts[1:]:
        whole = spans.mix(whole) ^ p
    rep, count, of = _grouped(whole)
    odd = np.flatnonzero(np.any([p != p[of] for p in parts], axis=0))
    if len(odd):
        count = count - np.bincount(np.searchsorted(whole[rep], whole[odd]), minlength=len(rep))
        rep, count = np.concatenate((rep, odd)), np.concatenate((count, np.ones(len(odd), np.int64)))
    columns = [pa.array(p[rep].view(np.int64)) for p in parts]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(count)], [*names, "n"])


def _pairs(seed: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, _ in _scans(batches, seed):
            often = _has(frequent, _slot(s.keys))
            at = np.flatnonzero(s.joined & often[:-1] & often[1:]) if len(s.keys) else np.zeros(0, np.int64)
            yield from _counted((s.keys[at], s.keys[at + 1]), ("x", "y"))

    return tidy(run)


def _triples(seed: int, prefix: np.ndarray, suffix: np.ndarray, whole: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, _ in _scans(batches, seed):
            if len(s.keys) < 3:
                continue
            slot = _slot(s.keys[:-1], s.keys[1:])
            wanted = _has(whole, slot)
            grow = (_has(prefix, slot)[:-1] & _has(suffix, slot)[1:]) | wanted[:-1] | wanted[1:]
            at = np.flatnonzero(grow & s.joined[:-1] & s.joined[1:])
            yield from _counted((s.keys[at], s.keys[at + 1], s.keys[at + 2]), ("x", "y", "z"))

    return tidy(run)


def _score(a: str, left: str, right: str) -> Column:
    wide = "cast({} as decimal(15,0))".format
    return F.expr(f"cast({SCALE} as decimal(7,0)) * {wide(a)} * {wide(a)} div ({wide(left)} * {wide(right)})")


def _ratio(part: str, whole: str) -> Column:
    return F.expr(f"cast({SCALE} as decimal(7,0)) * cast({part} as decimal(15,0)) div cast({whole} as decimal(15,0))")


def word_pairs(docs: DataFrame, frequent: DataFrame, seed: int, least: int) -> DataFrame:
    """(lang, x, y, a, fx, fy, score, grown, ended): candidates of two words with the score of their
    only cut and the bounds of every phrase that they begin or end."""
    counts = docs.mapInArrow(_pairs(seed, bit_filter(frequent, "key")), "x bigint, y bigint, n bigint")
    often = written(counts.groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    left = frequent.select(F.col("key").alias("x"), "lang", F.col("n").alias("fx"))
    right = frequent.select(F.col("key").alias("y"), F.col("n").alias("fy"))
    return written(
        often.join(left, "x")
        .join(right, "y")
        .select(
            "lang", "x", "y", "a", "fx", "fy",
            _score("a", "fx", "fy").alias("score"), _ratio("a", "fx").alias("grown"), _ratio("a", "fy").alias("ended"),
        )
    )


def _levels(pairs: DataFrame, width: int | None) -> DataFrame:
    """(lang, least): the bound from which on a language's prefixes are grown, 0 for all of them."""
    if width is None:
        return pairs.select("lang").distinct().withColumn("least", F.lit(0).cast("bigint"))
    bins = pairs.groupBy("lang", F.expr("grown div 1000").alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin")))
    reached = F.max(F.when(F.col("above") >= width, F.col("bin")))
    return (
        bins.withColumn("above", above)
        .groupBy("lang")
        .agg((F.coalesce(reached, F.lit(0)) * 1000).alias("least"))
    )


def _grow(docs: DataFrame, pairs: DataFrame, levels: DataFrame, seed: int, least: int, share: int) -> DataFrame:
    """(lang, x, y, z, a, l, r, score): all phrases of two and three words that score at least their
    language's level and survive; exact, whatever the level."""
    known = pairs.join(levels.withColumnRenamed("least", "level"), "lang")
    whole = known.where("score >= level")
    filters = [
        bit_filter(known.where("grown >= level"), "x", "y"),
        bit_filter(known.where("ended >= level"), "x", "y"),
        bit_filter(whole, "x", "y"),
    ]
    counts = docs.mapInArrow(_triples(seed, *filters), "x bigint, y bigint, z bigint, n bigint")
    often = written(counts.groupBy("x", "y", "z").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    first = known.select("lang", "level", "x", "y", F.col("a").alias("fxy"), "fx")
    rest = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"), F.col("fy").alias("fz"))
    cut = often.join(first, ["x", "y"]).join(rest, ["y", "z"])
    cut = cut.withColumn("one", _score("a", "fx", "fyz")).withColumn("two", _score("a", "fxy", "fz"))
    early = F.col("one") <= F.col("two")
    triples = cut.where(F.least("one", "two") >= F.col("level")).select(
        "lang", "x", "y", "z", "a",
        F.when(early, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
        F.when(early, F.col("fyz")).otherwise(F.col("fz")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    holds = often.select("x", "y", "a").unionByName(often.select(F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    longest = holds.groupBy("x", "y").agg(F.max("a").alias("longer"))
    stay = F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    doubles = (
        whole.join(longest, ["x", "y"], "left")
        .where(stay)
        .select("lang", "x", "y", F.lit(None).cast("bigint").alias("z"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    )
    return doubles.unionByName(triples)


def collocations(
    docs: DataFrame,
    depth: int = DEPTH,
    least: int = LEAST,
    share: int = SHARE,
    widths: tuple[int, ...] = WIDTHS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``depth`` best phrases of two or three words of each language.

    Words are counted whole. Pairs of words that occur often enough are counted next; all of them
    are needed, as candidates, as parts of longer ones and as prefixes. Three words are counted only
    below prefixes (and above endings) whose bound reaches the level of their language, or where they
    may drop a pair that does. A level is the bound of a language's best ``widths[i] * depth`` prefixes;
    a language whose survivors at or above its level are ``depth`` or more is settled, ties included,
    and leaves; the others widen, at last to all prefixes. The level decides the work, not the result.

    Tasks count in numpy and shuffle keys of 64 bits; filters of fixed size tell them what to count
    and err only by counting more. Counts and scores are exact (decimals of 38 digits). No group is
    gathered: a language's order is cut to ``depth`` rows per task before one task sorts it.

    Defined cases: a null text is empty, a null language is ``und``; rows repeat as they are; a
    language without a candidate has no row; an empty table gives an empty result.
    """
    rows = ship(docs).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    )
    every, seed = words(rows)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(every.where(F.col("n") >= least))
    pairs = word_pairs(rows, frequent, seed, least)
    open_pairs, settled = pairs, []
    for factor in (*widths, None):
        levels = written(_levels(open_pairs, factor and factor * depth))
        texts = rows.join(levels.select("lang"), "lang", "left_semi")
        grown = written(_grow(texts, open_pairs, levels, seed, least, share))
        done = (
            levels.join(grown.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
            .where((F.col("found") >= depth) | (F.col("least") == 0))
            .select("lang")
        )
        done = written(done)
        settled.append(grown.join(done, "lang", "left_semi"))
        open_pairs = open_pairs.join(done, "lang", "left_anti")
        if levels.join(done, "lang", "left_anti").isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, settled)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = written(found.withColumn("place", F.rank().over(best)).where(F.col("place") <= depth).drop("place"))
    for name in ("x", "y", "z"):
        word = frequent.select(F.col("key").alias(f"key_{name}"), F.col("word").alias(f"word_{name}"))
        near = near.join(word, F.coalesce(F.col(name), F.col("x")) == F.col(f"key_{name}"))
    phrase = F.concat_ws(" ", "word_x", "word_y", F.when(F.col("z").isNotNull(), F.col("word_z")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        near.withColumn("phrase", phrase)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= depth)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


SQL = rf"""
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{terms.UPPER}', '{terms.LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), g as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) t(k))
), f as (
  select lang, k, phrase, count(*) as f from g group by lang, k, phrase
), n as (
  select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang
), c as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10
), parts as (
  select lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:], ' ') as tail
  from (select c.*, unnest(range(1, k)) as cut from c)
), cuts as (
  select parts.*, l.f as l, r.f as r, cast((1000000 * a::hugeint * a) // (l.f::hugeint * r.f) as bigint) as score
  from parts join f l on l.lang = parts.lang and l.phrase = parts.head
  join f r on r.lang = parts.lang and r.phrase = parts.tail
), lowest as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as o from cuts) where o = 1
), longer as (
  select lang, part, max(a) as a
  from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from c where k = 3)
  group by lang, part
), kept as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score
  from lowest b left join longer on b.lang = longer.lang and b.phrase = longer.part
  where longer.a is null or 100 * longer.a < 50 * b.a
)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
join n using (lang)
where rank <= 2000
"""


def op12_collocations(spark, sf_dir):
    """The 2000 best phrases of each language of the whole documents table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

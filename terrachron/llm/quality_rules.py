"""Quality rules: fixed base rules, then thresholds from mergeable sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import ship, tidy, written

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Statistics in thousandths: name, numerator, denominator, percent of texts in a tail, reach, whether
#: low values fail. Repeated lines and words are common in sound texts, so their tail is a hundredth.
STATISTICS = (
    ("symbols", "n_symbols", "word_chars", 10, 2, False),
    ("dup_lines", "n_dup_lines", "n_lines", 1, 1, False),
    ("repeats", "n_repeat_words", "n_words", 1, 1, False),
    ("word_length", "word_chars", "n_words", 10, 2, True),
)
#: Thousandths that a value may always lie beyond the tail, so that a group of equal texts has room.
FLOOR = 10
#: A group's tail must hold this many texts; otherwise the sketch of its language is used, and of
#: languages that of the table.
LEAST_TAIL = 5


def features_of(block: spans.Block) -> dict[str, np.ndarray]:
    """The base features of each text of a block."""
    n = len(block)
    first, last, doc = block.words()
    hashes = block.hashed()
    words = hashes(first, last)
    out = {"n_words": np.bincount(doc, minlength=n)}
    point = (block.data & 0xC0) != 0x80
    out["word_chars"] = block.per_doc(point & ~spans.BLANK[block.data])
    out["n_symbols"] = block.per_doc(_SYMBOL[block.data])

    a, b, line_doc = block.lines()
    solid = np.concatenate(([0], np.cumsum(~spans.BLANK[block.data])))
    full = solid[b] > solid[a]
    keys, docs = spans.keyed(hashes(a[full], b[full]), line_doc[full]), line_doc[full]
    _, once = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(docs, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(docs[once], minlength=n)

    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :])
        at = at[spans.repeated(spans.keyed(spans.sequences(words, WINDOW)[at], doc[at]))]
        covered[at] += 1
        np.subtract.at(covered, at + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features_of(b) for b in spans.blocks(batch.column("text"))]
        if parts:
            found = [pa.array(np.concatenate([p[f] for p in parts]).astype(np.int64)) for f in FEATURES]
            rest = [batch.column(c) for c in ("id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(rest + found, ["id", "lang", "source", *FEATURES])


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(id, lang, source, features, base_failed) of every row; one scan, no shuffle."""
    rows = ship(docs).select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("text"),
    )
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, lang string, source string, " + ", ".join(f"{f} bigint" for f in FEATURES)
    return rows.mapInArrow(_measure, schema).withColumn(
        "base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    )


def _thousandths(top: str, bottom: str) -> Column:
    return F.expr(f"case when {bottom} > 0 then 1000 * {top} div {bottom} else 0 end")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, statistic, value, n): a histogram of thousandths per language and source.

    Histograms add up, so a sketch merges with any other; a quantile read from it is exact to one
    thousandth. Rows that the base rules reject are left out.
    """
    values = F.array(
        *[F.struct(F.lit(s).alias("statistic"), _thousandths(a, b).alias("value")) for s, a, b, *_ in STATISTICS]
    )
    return (
        rows.where("not base_failed")
        .select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", "v.statistic", "v.value")
        .agg(F.count("*").alias("n"))
    )


def _per_statistic(column: int) -> Column:
    """A column of ``STATISTICS``, looked up by the row's statistic."""
    return F.create_map(*[F.lit(x) for s in STATISTICS for x in (s[0], s[column])])[F.col("statistic")]


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, level, statistic, docs, low, high) for sources, languages and the whole table.

    Limits come from the sketch's tails: the quantile that leaves the statistic's tail percent
    outside, and beyond it ``reach`` times its distance from the median, and ``FLOOR``.
    """
    parts = []
    tail, reach = _per_statistic(3), _per_statistic(4)
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        group = [*keys, "statistic"]
        merged = sketch.groupBy(*group, "value").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*group).orderBy("value")
        seen = merged.select(
            *group,
            "value",
            F.sum("n").over(upto).alias("seen"),
            F.sum("n").over(Window.partitionBy(*group)).alias("docs"),
        )
        quantile = lambda p: F.min(F.when(F.col("seen") * 100 >= F.col("docs") * p, F.col("value")))
        parts.append(
            seen.groupBy(*group)
            .agg(
                F.max("docs").alias("docs"),
                quantile(tail).alias("lower"),
                quantile(50).alias("middle"),
                quantile(100 - tail).alias("upper"),
            )
            .select(
                *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in ("lang", "source")],
                F.lit(level).alias("level"),
                "statistic",
                "docs",
                "lower",
                "middle",
                "upper",
            )
        )
    limits = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return limits.select(
        "lang",
        "source",
        "level",
        "statistic",
        "docs",
        F.when(_per_statistic(5), F.col("lower") - reach * (F.col("middle") - F.col("lower")) - FLOOR).alias("low"),
        (F.col("upper") + reach * (F.col("upper") - F.col("middle")) + FLOOR).alias("high"),
    )


def _limits(table: DataFrame, level: int, name: str) -> DataFrame:
    """One row per key of a level: its limits as a map from statistic, without those of too few texts."""
    enough = F.col("docs") * _per_statistic(3) >= 100 * LEAST_TAIL if level < 2 else F.lit(True)
    return (
        table.where((F.col("level") == level) & enough)
        .groupBy(F.col("lang").alias(f"{name}_lang"), F.col("source").alias(f"{name}_source"))
        .agg(
            F.map_from_entries(F.collect_list(F.struct("statistic", F.struct("low", "high")))).alias(name)
        )
    )


def judged(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``measured`` with ``kept``: false if the base rules or a limit reject the text."""
    own = _limits(table, 0, "own")
    tongue = _limits(table, 1, "tongue")
    every = _limits(table, 2, "every").withColumn("one", F.lit(1))
    joined = (
        rows.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
        .join(tongue, F.col("lang").eqNullSafe(F.col("tongue_lang")), "left")
        .withColumn("one", F.when(~F.col("base_failed"), 1))
        .join(F.broadcast(every.select("one", "every")), "one", "left")
    )
    good = F.lit(True)
    for name, a, b, *_ in STATISTICS:
        value, at = _thousandths(a, b), F.coalesce(*[F.col(c)[name] for c in ("own", "tongue", "every")])
        good = good & (value <= at["high"]) & (at["low"].isNull() | (value >= at["low"]))
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(good, F.lit(True)))).select(
        *rows.columns, "kept"
    )


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Features, ``base_failed`` and ``kept`` of every row of ``docs``.

    Texts are scanned once; the short rows are written to the shared folder, since sketches and
    filter both read them. Sketches are histograms added up per task before the shuffle, so a
    source with a third of all rows adds a few hundred rows per task; limits come back by a join
    on (language, source), null counting as a value of its own.

    Defined cases: a null or empty text has only zeros and fails the base rules; ``id``, ``lang``
    and ``source`` may be null or repeated, every row is judged by itself; empty table, empty result.
    """
    rows = written(measured(docs, **columns))
    return judged(rows, thresholds(sketches(rows)))


def op4_quality_rules(spark, sf_dir):
    """Quality rules over the whole documents table."""
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


SQL = r"""
with t as (
  select doc_id, lang, source, coalesce(text, '') as s,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents
), win as (
  select doc_id, i, ws[i:i + 4] as w
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) as i from t)
), rep as (
  select doc_id, count(distinct k) as n from (
    select doc_id, i + unnest(range(0, 5)) as k
    from (select doc_id, i, count(*) over (partition by doc_id, w) as c from win) where c > 1
  ) group by doc_id
), lines as (
  select doc_id, sum(c) as n_lines, sum(c - 1) as n_dup from (
    select doc_id, l, count(*) as c from (select doc_id, unnest(string_split(s, chr(10))) as l from t)
    where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l
  ) group by doc_id
), f as (
  select t.doc_id, lang, source, len(ws)::bigint as n_words,
         length(array_to_string(ws, ''))::bigint as word_chars,
         (length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0)::bigint as n_lines
  from t left join rep using (doc_id) left join lines using (doc_id)
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f
), v as (
  select doc_id, lang, source, 'symbols' as st, 10 as tail, 2 as reach,
         case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as x
  from b where not base_failed
  union all
  select doc_id, lang, source, 'dup_lines', 1, 1, case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end
  from b where not base_failed
  union all
  select doc_id, lang, source, 'repeats', 1, 1, 1000 * n_repeat_words // n_words from b where not base_failed
  union all
  select doc_id, lang, source, 'word_length', 10, 2, 1000 * word_chars // n_words from b where not base_failed
), own as (
  select lang, source, st, quantile_disc(x, 0.1) as a, quantile_disc(x, 0.5) as m,
         case when tail = 10 then quantile_disc(x, 0.9) else quantile_disc(x, 0.99) end as z
  from v group by lang, source, st, tail having count(*) * tail >= 500
), tongue as (
  select lang, st, quantile_disc(x, 0.1) as a, quantile_disc(x, 0.5) as m,
         case when tail = 10 then quantile_disc(x, 0.9) else quantile_disc(x, 0.99) end as z
  from v group by lang, st, tail having count(*) * tail >= 500
), every as (
  select st, quantile_disc(x, 0.1) as a, quantile_disc(x, 0.5) as m,
         case when tail = 10 then quantile_disc(x, 0.9) else quantile_disc(x, 0.99) end as z
  from v group by st, tail
), lim as (
  select v.doc_id, v.st, x, reach,
         case when own.st is not null then own.a when tongue.st is not null then tongue.a else every.a end as a,
         case when own.st is not null then own.m when tongue.st is not null then tongue.m else every.m end as m,
         case when own.st is not null then own.z when tongue.st is not null then tongue.z else every.z end as z
  from v
  left join own on v.lang is not distinct from own.lang and v.source is not distinct from own.source and v.st = own.st
  left join tongue on v.lang is not distinct from tongue.lang and v.st = tongue.st
  left join every on v.st = every.st
), ok as (
  select doc_id, bool_and(x <= z + reach * (z - m) + 10 and (st <> 'word_length' or x >= a - reach * (m - a) - 10)) as good
  from lim group by doc_id
)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and good as kept
from b left join ok using (doc_id)
"""

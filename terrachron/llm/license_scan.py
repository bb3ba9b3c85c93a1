"""Licence passages by templates with optional and replaceable regions, run as token automata.

Markup: ``[[...]]`` may be left out, ``{{name:1-12}}`` stands for one to twelve words of any kind, and
regions nest. All other words are mandatory and must stand there exactly, in order, with nothing between.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans, terms
from .common import ship, tidy

#: Fixed values of the registered query: (label, phrase).
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

_HOLDER = "[[Copyright [[(c)]] {{holder:1-16}}]] [[All rights reserved.]]"
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY {{author:1-12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
 BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD = f"""{_HOLDER} Redistribution and use in source and binary forms, with or without modification, are permitted
 [[(subject to the limitations in the disclaimer below)]] provided that the following conditions are met:
 [[{{{{mark:0-1}}}}]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
 following disclaimer. [[{{{{mark:0-1}}}}]] Redistributions in binary form must reproduce the above copyright notice, this list of
 conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """[[[[This {{work:1-6}} is]] free software: [[you can]] redistribute it and/or modify it]] [[[[licensed]] under]] [[the terms of]]
 [[the]]"""

#: Wording of well-known licences and notices, (label, template).
TEMPLATES = (
    ("mit", f"""[[[[The]] MIT License [[(MIT)]]]] {_HOLDER} Permission is hereby granted, free of charge, to any person obtaining a
 copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
 without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
 and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
 and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the
 Software."""),
    ("mit", "[[[[is]] {{verb:1-1}}]] under the terms of the MIT license"),
    ("isc", f"""[[ISC License]] {_HOLDER} Permission to use, copy, modify, and/or distribute this software for any purpose with or
 without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2", f"{_BSD} {_AS_IS_BSD}"),
    ("bsd-3", f"""{_BSD} [[{{{{mark:0-1}}}}]] Neither the name of {{{{organisation:1-12}}}} nor the names of its contributors may be used to
 endorse or promote products derived from this software without specific prior written permission. [[{_AS_IS_BSD}]]"""),
    ("apache-2", """[[Copyright {{holder:1-16}}]] [[Licensed under the]] Apache License, Version 2.0 [[(the "License"); you may not use
 this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0]]"""),
    ("gpl-2", f"""{_GNU} GNU General Public License [[as published by the Free Software Foundation]] [[; either]] version 2
 [[of the License]] [[, or (at your option) any later version]]"""),
    ("gpl-3", f"""{_GNU} GNU General Public License [[as published by the Free Software Foundation]] [[, either]] version 3
 [[of the License]] [[, or (at your option) any later version]]"""),
    ("lgpl-2.1", f"""{_GNU} GNU Lesser General Public License [[as published by the Free Software Foundation]] [[; either]]
 version 2.1 [[of the License]] [[, or (at your option) any later version]]"""),
    ("lgpl-3", f"""{_GNU} GNU Lesser General Public License [[as published by the Free Software Foundation]] [[, either]] version 3
 [[of the License]] [[, or (at your option) any later version]]"""),
    ("agpl-3", f"""{_GNU} GNU Affero General Public License [[as published by the Free Software Foundation]] [[, either]] version 3
 [[of the License]] [[, or (at your option) any later version]]"""),
    ("mpl-2", """[[This Source Code Form is]] subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not
 distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.]]"""),
    ("zlib", f"""{_HOLDER} This software is provided 'as-is', without any express or implied warranty. In no event will the
 [[{{{{who:1-4}}}}]] authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
 this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. [[Anyone is free to copy, modify,
 publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
 commercial or non-commercial, and by any means.]]"""),
    ("cc-by", "[[This work is]] licensed under [[a]] [[the]] Creative Commons Attribution 4.0 [[{{port:1-3}}]] License"),
    ("cc-by", "[[This work is]] licensed under [[a]] [[the]] Creative Commons Attribution 3.0 [[{{port:1-3}}]] License"),
    ("cc-by-sa", """[[This work is]] licensed under [[a]] [[the]] Creative Commons Attribution-ShareAlike {{version:1-2}}
 [[{{port:1-3}}]] License"""),
    ("cc-by-nc", """[[This work is]] licensed under [[a]] [[the]] Creative Commons Attribution-NonCommercial [[ShareAlike]]
 [[NoDerivatives]] {{version:1-2}} [[{{port:1-3}}]] License"""),
    ("cc-by-nc", "[[[[This work is]] licensed under]] CC BY-NC [[SA]] [[ND]] {{version:1-2}}"),
    ("cc0", "[[To the extent possible under law, {{person:1-12}} has waived all copyright and related]] CC0 1.0 Universal"),
)

#: Words of the mandatory run by which a template is looked for.
ANCHOR_WORDS = 4


def parse(markup: str) -> list:
    """A template as nested lists: a word, ("any", least, most), or ("maybe", [...])."""
    stack: list[list] = [[]]
    for m in re.finditer(r"\[\[|\]\]|\{\{\w+:(\d+)-(\d+)\}\}|(?:(?!\[\[|\]\]|\{\{).)+", markup, re.S):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            inner = stack.pop()
            if not stack:
                raise ValueError("a region ends that was not begun")
            stack[-1].append(("maybe", inner))
        elif m[1]:
            stack[-1].append(("any", int(m[1]), int(m[2])))
        else:
            stack[-1] += re.findall(terms.PATTERN, m[0].translate(str.maketrans(terms.UPPER, terms.LOWER)))
    if len(stack) > 1:
        raise ValueError("a region is not ended")
    return stack[0]


def pattern(nodes: list) -> str:
    """The same language as a regular expression over words written as " word "."""
    out = ""
    for node in nodes:
        if isinstance(node, str):
            out += f" {re.escape(node)} "
        elif node[0] == "any":
            out += f"(?: [^ ]+ ){{{node[1]},{node[2]}}}"
        else:
            out += f"(?:{pattern(node[1])})?"
    return out


class Automaton:
    """Position automaton of a template: sets of positions are bits of one number."""

    def __init__(self, nodes: list):
        self.symbols: list[bytes | None] = []
        self.follow: list[int] = []
        self.nullable, self.first, self.last = self._sequence(nodes)
        self.any = sum(1 << i for i, s in enumerate(self.symbols) if s is None)
        self.masks: dict[bytes, int] = {}
        for i, s in enumerate(self.symbols):
            if s is not None:
                self.masks[s] = self.masks.get(s, self.any) | 1 << i

    def _sequence(self, nodes: list) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for node in nodes:
            nullable, begin, end = self._node(node)
            for i in _bits(last):
                self.follow[i] |= begin
            first |= begin if empty else 0
            last = end | (last if nullable else 0)
            empty = empty and nullable
        return empty, first, last

    def _node(self, node) -> tuple[bool, int, int]:
        if isinstance(node, str):
            return self._position(node.encode())
        if node[0] == "maybe":
            return True, *self._sequence(node[1])[1:]
        _, least, most = node
        tail: list = []
        for _ in range(most - least):
            tail = [("maybe", [("any", 1, 1), *tail])]
        if (least, most) == (1, 1):
            return self._position(None)
        return self._sequence([("any", 1, 1)] * least + tail)

    def _position(self, symbol: bytes | None) -> tuple[bool, int, int]:
        self.symbols.append(symbol)
        self.follow.append(0)
        return False, 1 << len(self.symbols) - 1, 1 << len(self.symbols) - 1

    def longest(self, word: Callable[[int], bytes | None]) -> int:
        """Words of the longest accepted beginning of word(0), word(1), ...; -1 if none is."""
        best, now, i = 0 if self.nullable else -1, self.first, 0
        while now and (w := word(i)) is not None:
            now &= self.masks.get(w, self.any)
            i += 1
            if now & self.last:
                best = i
            now = self._after(now)
        return best

    def _after(self, positions: int) -> int:
        out = 0
        for i in _bits(positions):
            out |= self.follow[i]
        return out


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _reversed(nodes: list) -> list:
    return [("maybe", _reversed(n[1])) if n[0] == "maybe" and not isinstance(n, str) else n for n in reversed(nodes)]


@dataclass
class Template:
    """A compiled template: what may stand before its first mandatory words, and all from there on."""

    label: str
    markup: str
    base: bool = False
    anchor: list[str] = field(init=False)

    def __post_init__(self):
        nodes = parse(self.markup)
        start = next((i for i, n in enumerate(nodes) if isinstance(n, str)), None)
        if start is None:
            raise ValueError(f"the template of {self.label} has no mandatory word")
        end = start
        while end < len(nodes) and isinstance(nodes[end], str) and end - start < ANCHOR_WORDS:
            end += 1
        self.anchor = nodes[start:end]
        self.before, self.after = Automaton(_reversed(nodes[:start])), Automaton(nodes[start:])


def compiled(base=BASE, templates=TEMPLATES) -> list[Template]:
    return [Template(a, b, True) for a, b in base] + [Template(a, b) for a, b in templates]


def _anchors(found: list[Template]) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """By number of words: the hashes of anchors in order, and the templates of each."""
    sizes: dict[int, dict[int, list[int]]] = {}
    for k, t in enumerate(found):
        data = np.frombuffer(" ".join(t.anchor).encode(), dtype=np.uint8)
        block = spans.Block(0, data, np.array([0]), np.array([len(data)]))
        first, last, _ = block.words(terms.APART)
        code = int(spans.sequences(spans.Hashes(data)(first, last), len(first))[0])
        sizes.setdefault(len(first), {}).setdefault(code, []).append(k)
    return {n: (np.array(sorted(c), dtype=np.uint64), [c[x] for x in sorted(c)]) for n, c in sizes.items()}


def passages(block: spans.Block, found: list[Template], anchors: dict) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Words of each text, and its (template, first word, word after the last) in order of template and place.

    Base phrases are reported at every place; of a template the longest passage at each place that
    lies outside the one before it.
    """
    data = terms.lower(block.data)
    first, last, doc = block.words(terms.APART)
    n_words = np.bincount(doc, minlength=len(block))
    begin = np.cumsum(n_words) - n_words
    hashes = spans.Hashes(data)(first, last)
    hits: list[tuple[int, int]] = []
    for size, (codes, which) in anchors.items():
        runs = spans.sequences(hashes, size)
        at = np.minimum(np.searchsorted(codes, runs), len(codes) - 1)
        for i in np.flatnonzero(codes[at] == runs).tolist():
            hits += [(k, i) for k in which[at[i]]]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
    free: dict[tuple[int, int], int] = {}
    for k, i in sorted(hits):
        d, t = int(doc[i]), found[k]
        low, high = int(begin[d]), int(begin[d] + n_words[d])
        word = lambda j: data[first[j] : last[j]].tobytes()
        length = t.after.longest(lambda j: word(i + j) if i + j < high else None)
        if length < 0:
            continue
        low = max(low, free.get((k, d), low))
        if i < low:
            continue
        back = t.before.longest(lambda j: word(i - 1 - j) if i - 1 - j >= low else None)
        if back < 0:
            continue
        if not t.base:
            free[k, d] = i + length
        out[d].append((k, i - back - int(begin[d]), i + length - int(begin[d])))
    return n_words, out


_MATCHES = pa.list_(
    pa.struct(
        [("label", pa.string()), ("template", pa.int32()), ("base", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64())]
    )
)


def _scan(found: list[Template]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors(found)
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                n, lists = passages(block, found, anchors)
                rows = [
                    [dict(label=found[k].label, template=k, base=found[k].base, first_word=a, end_word=b) for k, a, b in x]
                    for x in lists
                ]
                ids = batch.column("id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(rows, _MATCHES)], ["id", "n_words", "passages"])

    return tidy(run)


def scan_licenses(
    docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, passages) of every whole text: where licence wording stands, as ranges of words.

    Templates become position automata. Hashes of the first mandatory words of each are looked up
    at all places of a block at once; only there the automaton runs, forward over the words as they
    are (so a hash alone accepts nothing) and backward over the regions that may stand before.
    One scan, no shuffle, no state between rows.

    Defined cases: a null or empty text has no words and no passages; ids may be null or repeated;
    an empty table gives an empty result; a template without mandatory words is refused.
    """
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = "array<struct<label: string, template: int, base: boolean, first_word: bigint, end_word: bigint>>"
    schema = f"id {dict(rows.dtypes)['id']}, n_words bigint, passages {kind}"
    return rows.mapInArrow(_scan(compiled(base, templates)), schema).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of ``scan_licenses``; the score is the share of a text's words that its
    longest passage holds, so a licence text is near 1 and a mention in passing near 0."""
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    places = F.col("base_passages.first_word")
    longest = F.array_max(F.transform("passages", lambda p: p["end_word"] - p["first_word"]))
    return scanned.withColumn("base_passages", F.filter("passages", lambda p: p["base"])).select(
        id_col,
        "n_words",
        F.size("base_passages").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names(F.col("base_passages")).alias("base_labels"),
        names(F.col("passages")).alias("labels"),
        F.coalesce(longest / F.col("n_words"), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    def places(phrase: str) -> str:
        held = parse(phrase)
        same = " and ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(held))
        return f"list_filter(range(1, len(w) + 1), lambda i: {same})"

    base = ",\n         ".join(f"{places(p)} as b{k}" for k, (_, p) in enumerate(BASE))
    every = [(label, parse(m)) for label, m in (*BASE, *TEMPLATES)]
    rules = ",\n  ".join(f"({k}, '{label}', '{pattern(nodes)}')" for k, (label, nodes) in enumerate(every))
    joined = "list_concat(" * (len(BASE) - 1) + "b0" + "".join(f", b{k})" for k in range(1, len(BASE)))
    labels = " || ".join(f"case when len(b{k}) > 0 then ['{label}'] else [] end" for k, (label, _) in enumerate(BASE))
    return rf"""
with d as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{terms.UPPER}', '{terms.LOWER}'), '{terms.PATTERN}') as w
  from documents
), b as (
  select k, doc_id, len(w) as n_words, ' ' || array_to_string(w, '  ') || ' ' as s,
         {base}
  from d
), rules(rule, label, p) as (values
  {rules}
), m as (
  select k, label, unnest(regexp_extract_all(s, p)) as passage from b, rules
), found as (
  select k, string_agg(distinct label, ',' order by label) as labels,
         max(len(regexp_extract_all(passage, '[^ ]+'))) as longest
  from m group by k
)
select doc_id, n_words, cast(len({joined}) as bigint) as n_base,
       cast(list_min({joined}) - 1 as bigint) as first_word, cast(list_max({joined}) - 1 as bigint) as last_word,
       array_to_string(list_sort(list_distinct({labels})), ',') as base_labels,
       coalesce(labels, '') as labels, coalesce(longest / n_words, 0.0) as score
from b left join found using (k)
"""


SQL = _sql()


def op13_license_scan(spark, sf_dir):
    """Licence wording of every document of the whole table."""
    return digest(scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")))

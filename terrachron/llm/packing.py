"""Packing of tokenised documents: shortest pack first over the histogram of piece lengths."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, tidy, written

CAPACITY = 1024
#: Id that ends each document.
END_ID = 0
#: Words that a worker remembers; the table is emptied when full.
CACHED_WORDS = 100_000
#: Rows whose results are handed back together.
SLICE_ROWS = 256


class ByteTokens:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    The tokenizer's own pre-tokenisation never joins characters across a space that starts a word,
    so the ids of a word with the space before it do not depend on its neighbours and are
    remembered. Texts in which that does not hold (a space between two blanks or after a blank at
    the end, or a special token's text) are encoded as a whole.
    """

    _LOOSE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path = path
        self.special = [t["content"] for t in file["added_tokens"]]
        self.words: dict[str, bytes] = {}
        self._fast = _ranked(file["model"], self.special)

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> bytes:
        ids = self._fast.encode_ordinary(text) if self._fast else self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self._LOOSE.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known, out = self.words, [self._encode(first)] if first else []
        for word in rest:
            found = known.get(word)
            if found is None:
                found = self._encode(" " + word)
                if len(word) <= 64:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = found
            out.append(found)
        return b"".join(out)


def _ranked(model: dict, special: list[str]):
    """The same vocabulary as byte ranks for tiktoken, if ids are merge ranks; else nothing."""
    import public_tokenizers
    import tiktoken

    # Fixed rule of byte-level BPE: printable bytes stand for themselves, the rest follow from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [vocab[m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_tokens: dict[str, ByteTokens] = {}


def _cutter(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = ByteTokens(path)
        tokens, end = _tokens[path], array("I", [END_ID]).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    raw = tokens(text or "") + end
                    n = len(raw) // 4
                    for a in range(0, n, capacity):
                        piece = raw[4 * a : 4 * (a + capacity)]
                        row.append(i)
                        start.append(a)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if keep_ids:
                            ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                columns = [batch.column("id").take(pa.array(row, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return tidy(run)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Each document's ids and one end id, cut into full pieces and a rest; one scan."""
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return rows.mapInArrow(_cutter(tokenizer, capacity, keep_ids), schema + ", ids array<int>" * keep_ids)


def patterns_of(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs): lengths are placed longest first, each into the
    shortest open pack that has room; a new pack is opened if even that one has none."""
    if any(n <= 0 or n > capacity for n in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    open_packs: dict[int, list[list]] = {}  # fill -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fill = min(open_packs, default=capacity)
            if fill + length > capacity:
                per = capacity // length
                for many, count in ((per, left // per), (left % per, 1)):
                    if many and count:
                        open_packs.setdefault(many * length, []).append([(length,) * many, count])
                break
            packs = open_packs[fill]
            pattern, count = packs[-1]
            used = min(left, count)
            left -= used
            packs[-1][1] -= used
            if not packs[-1][1]:
                packs.pop()
                if not packs:
                    del open_packs[fill]
            open_packs.setdefault(fill + length, []).append([(*pattern, length), used])
    return [(p, n) for fill in sorted(open_packs, reverse=True) for p, n in open_packs[fill]]


def _slots(patterns) -> tuple[np.ndarray, ...]:
    """For each length, ranges of ranks in order: key of the first rank, first sequence, offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            ranks[length] = rank + count
            rows.append(((length << 48) + rank, sequence, offset))
            offset += length
        sequence += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def _placer(slots):
    keys, sequences, offsets = slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            key = (length << 48) + batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return tidy(run)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset.

    Pieces are counted by length; only that histogram (at most ``capacity`` numbers) comes to the
    driver, where patterns of packs are found. Pieces get a rank among those of their length from a
    count per (length, salt) and a row number within both, so no window holds a whole length, and
    the join of the two needs no further shuffle; a pattern's slot owns a range of ranks, and a piece
    finds its slot by binary search. ``tokenizer`` is a path that every executor has.

    Defined cases: a null or empty text is one piece, the end id; documents longer than the capacity
    are cut at its multiples; ids may be null or repeated, every row is packed; empty table, empty
    result.
    """
    pieces = written(pieces_of(docs, tokenizer, capacity, id_col, text_col, keep_ids))
    spark = docs.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    counts = written(pieces.groupBy("length", salt.alias("salt")).count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("length").alias("of"), F.col("salt").alias("part"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("salt", "length").orderBy("id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("salt", salt)
        .withColumn("row", F.row_number().over(within))
        .join(bases, (F.col("length") == F.col("of")) & (F.col("salt") == F.col("part")))
        .withColumn("rank", F.col("base") + F.col("row") - 1)
        .select(*pieces.columns, "rank")
    )
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    placed = ranked.mapInArrow(_placer(_slots(patterns_of(histogram, capacity))), schema)
    return placed.withColumnRenamed("id", id_col)


def op6_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 ids."""
    import public_tokenizers

    return pack_documents(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

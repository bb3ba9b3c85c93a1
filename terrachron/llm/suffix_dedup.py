"""Removal of repeated byte strings by suffix arrays over shards, merged by binary search.

Shards are cut so that equal strings meet. Each window of ``length`` bytes has an anchor, the gram
with the smallest hash in it, which depends on the window's bytes alone; neighbouring windows with
the same anchor form an extent. Extents whose bytes are equal stand for each other, so only the one
in the smallest document goes on, and only where an anchor has different extents are their bytes
fetched. Those bytes form the shards: suffix array by Larsson-Sadakane refinement, Kasai's common
prefixes, and of each run of equal windows all but those of the smallest document are removed.
Anchors with very many extents are split over shards, and the first windows of these shards are
merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import fresh, ship, tidy

LENGTH = 50
#: Bytes of a gram; a window of LENGTH bytes has LENGTH - GRAM + 1 of them.
GRAM = 20
#: Bytes of text whose anchors a task sorts and hands on together.
BATCH_BYTES = 8 << 20
#: One in so many extents is counted to find anchors with very many different ones.
PROBE = 256
#: Counted extents from which an anchor is split over shards.
HOT_PROBES = 16
#: Most anchors that are split: the list goes to every task, 8 bytes each.
HOT_ANCHORS = 1_000_000
#: Rows whose texts are unpacked together.
SLICE_ROWS = 512
#: Shards and buckets per shuffle partition.
SHARE = 8
_LARGEST = (1 << 63) - 1
_U = np.uint64


# --- extents -------------------------------------------------------------------------------------


def extents(block: spans.Block, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Anchor hash, extent hash, text, first byte (in the block) and size of every extent."""
    n = len(block.data)
    if n < length:
        return None
    hashes = block.hashed()
    at = np.arange(n - gram + 1)
    own = hashes(at, at + gram)
    # High half: hash; low half: position. The least value of a window is its leftmost smallest gram.
    least = (own & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    cut = np.zeros(len(least) + 1, dtype=np.int64)
    for end in block.ends[:-1]:  # windows that would reach into the next text
        a, b = max(0, min(end - length + 1, len(least))), min(end, len(least))
        if a < b:
            cut[a] += 1
            cut[b] -= 1
    good = np.flatnonzero(np.cumsum(cut[:-1]) == 0)
    if not len(good):
        return None
    anchor = (least[good] & _U(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first = good[heads]
    last = good[np.concatenate((heads[1:] - 1, [len(good) - 1]))] + length
    return own[anchor[heads]], hashes(first, last), block.doc_of(first), first, last - first


def _packed(h, e, ids, start, size) -> bytes:
    """Five arrays as compressed byte planes; the two lowest bytes of anchor hashes are dropped."""
    planes = [
        np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T[skip:])
        for a, skip in (
            (h.astype("<u8"), 2),
            (e.astype("<u8"), 0),
            (ids.astype("<i8"), 0),
            (start.astype("<u4"), 0),
            (size.astype("<u2"), 0),
        )
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(-1, n)
    out, at = [], 0
    for kind, width, skip in (("<u8", 8, 2), ("<u8", 8, 0), ("<i8", 8, 0), ("<u4", 4, 0), ("<u2", 2, 0)):
        full = np.zeros((n, width), dtype=np.uint8)
        full[:, skip:] = flat[at : at + width - skip].T
        out.append(full.reshape(-1).view(kind))
        at += width - skip
    return out


def _gathered(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[list[np.ndarray]]:
    """Anchor hash, extent hash, id, start and size of the extents of about BATCH_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        ids = batch.column("key").to_numpy(zero_copy_only=False)
        for block in spans.blocks(batch.column("text")):
            found = extents(block, length, gram)
            size += len(block.data)
            if found is not None:
                h, e, doc, first, n = found
                held.append((h & ~_U(0xFFFF), e, ids[block.first + doc], first - block.starts[doc], n))
            if size >= BATCH_BYTES and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _settled(h, e, ids, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted-by-h rows: which lie in a larger document than an equal extent, which repeat a row
    (same document and place), and which belong to an anchor with different extents and documents."""
    n = len(h)
    gone, again, mixed = (np.zeros(n, dtype=bool) for _ in range(3))
    same = h[1:] == h[:-1]
    several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if len(several):
        order = several[np.lexsort((start[several], ids[several], e[several], h[several]))]
        sh, se, si, st = h[order], e[order], ids[order], start[order]
        new_h = np.concatenate(([True], sh[1:] != sh[:-1]))
        new_e = new_h | np.concatenate(([True], se[1:] != se[:-1]))
        group = np.cumsum(new_e) - 1
        gone[order] = si > si[np.flatnonzero(new_e)][group]
        again[order[1:]] = ~new_e[1:] & (si[1:] == si[:-1]) & (st[1:] == st[:-1])
        anchor = np.cumsum(new_h) - 1
        heads = np.flatnonzero(new_h)
        docs = np.minimum.reduceat(si, heads) < np.maximum.reduceat(si, heads)
        mixed[order] = (docs & (np.bincount(anchor[new_e]) > 1))[anchor]
    return gone, again, mixed


def _place(start, size, a, b) -> np.ndarray:
    """Where an extent is in its text, and from where to where it is meant, as one number."""
    start, size, a, b = (np.asarray(x).astype(np.int64) for x in (start, size, a, b))
    return (((start << 10 | size) << 10) | a) << 10 | b


def _parts(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 30, place >> 20 & 1023, place >> 10 & 1023, place & 1023


def _rows(ids, start, size, e, h, ask) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids.astype(np.int64)),
            pa.array(_place(start, size, np.zeros(len(ids)), size)),
            pa.array(e.astype(np.uint64).view(np.int64)),
            pa.array(h.astype(np.uint64).view(np.int64)),
            pa.array(ask),
        ],
        ["key", "place", "e", "h", "ask"],
    )


_ROW = "key bigint, place bigint, e bigint, h bigint, ask boolean"
_SPAN = ["key", "place", "e"]


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def _bucket(h: np.ndarray, e: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Equal extents share a bucket, and so do all extents of an anchor that is not split."""
    key = np.where(_is_hot(h, hot), spans.mix(h ^ e), h)
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _extent_batches(length: int, gram: int, buckets: int, hot: np.ndarray):
    """Extents as compressed batches per bucket; those with an equal one in a smaller document of
    the same task are settled already, and their batches have a negative count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, e, ids, start, size in _gathered(batches, length, gram):
            to = _bucket(h, e, hot, buckets)
            order = np.lexsort((h, to)) if len(hot) else np.argsort(h, kind="stable")
            h, e, ids, start, size, to = (c[order] for c in (h, e, ids, start, size, to))
            if len(hot):
                by_h = np.argsort(h, kind="stable")
                gone = np.zeros(len(h), dtype=bool)
                again = np.zeros(len(h), dtype=bool)
                gone[by_h], again[by_h], _ = _settled(h[by_h], e[by_h], ids[by_h], start[by_h])
            else:
                gone, again, _ = _settled(h, e, ids, start)
            for sign, rows in ((1, ~gone & ~again), (-1, gone & ~again)):
                at = np.flatnonzero(rows)
                if not len(at):
                    continue
                own = to[at]
                cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                blobs = [_packed(*(c[at[x:y]] for c in (h, e, ids, start, size))) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[cuts[:-1]]), pa.array(sign * np.diff(cuts)), pa.array(blobs, pa.binary())],
                    ["bucket", "n", "blob"],
                )

    return tidy(run)


def _met(hot: np.ndarray):
    """Finished rows and rows whose bytes are needed, from all extents of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        counts, blobs = table.column("n").to_pylist(), table.column("blob").to_pylist()
        done = [_unpacked(b, -n) for n, b in zip(counts, blobs) if n < 0]
        parts = [_unpacked(b, n) for n, b in zip(counts, blobs) if n > 0]
        h, e, ids, start, size = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, e, ids, start, size = (c[order] for c in (h, e, ids, start, size))
        gone, again, mixed = _settled(h, e, ids, start)
        ask = (mixed | _is_hot(h, hot)) & ~gone & ~again
        out = gone & ~again | ask
        h, e, ids, start, size, ask = (c[out] for c in (h, e, ids, start, size, ask))
        out = [_rows(ids, start, size, e, h, ask)]
        for h, e, ids, start, size in done:
            out.append(_rows(ids, start, size, e, h, np.zeros(len(h), dtype=bool)))
        return pa.Table.from_batches(out)

    return run


def _probe(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, e, *_ in _gathered(batches, length, gram):
            some = (spans.mix(e) % _U(PROBE)) == 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some].view(np.int64)) for c in (h, e)], ["h", "e"])

    return tidy(run)


# --- suffix arrays -------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``.

    Larsson-Sadakane refinement: order positions by 8 bytes, then again and again split only the
    groups that are not yet singletons by the rank of the position as far on as is known, which
    doubles each time. A suffix that ends comes before its extensions.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << _U(8)) | padded[k : k + n]
    order = np.argsort(key)
    heads = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    known = 8
    while True:
        open_at = np.flatnonzero(~(heads & np.concatenate((heads[1:], [True]))))
        if not len(open_at):
            return order
        where = order[open_at]
        far = where + known  # past the end, the shorter suffix is the smaller
        pair = rank[where] * (n + known + 1) + known + np.where(far < n, rank[np.minimum(far, n - 1)], n - 1 - far)
        by = np.argsort(pair)
        where, pair = where[by], pair[by]
        order[open_at] = where
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        heads[open_at] = new
        rank[where] = np.maximum.accumulate(np.where(new, open_at, 0))
        known *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, lane: int = 512) -> np.ndarray:
    """For each position, bytes in common with the one before it in the suffix array, at most ``depth``.

    Kasai's scan, in lanes: a position shares at least one byte less than the position to its left,
    so each lane of ``lane`` positions moves on by one or compares one more byte, all lanes at once.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    at = np.arange(0, n, lane)
    stop = np.minimum(at + lane, n)
    have = np.zeros(len(at), dtype=np.int64)
    while len(at):
        other = before[at]
        far = np.maximum(at, other) + have
        more = (other >= 0) & (have < depth) & (far < n)
        more[more] = text[at[more] + have[more]] == text[other[more] + have[more]]
        have += more
        moved = ~more
        shared[at[moved]] = have[moved]
        have[moved] = np.maximum(have[moved] - 1, 0)
        at = at + moved
        live = at < stop
        if not live.all():
            at, stop, have = at[live], stop[live], have[live]
    return shared


def _judged(text: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int):
    """Windows of the regions of a shard: position, region, document, run of equal ones, and the
    smallest document of the run."""
    region = np.repeat(np.arange(len(begin)), size)
    usable = np.arange(len(text)) + length <= (begin + size)[region]
    order = suffix_order(text)
    shared = common_prefixes(text, order, length)[order]
    run = np.cumsum(shared < length) - 1
    keep = usable[order]
    at, run = order[keep], run[keep]
    doc = ids[region[at]]
    least = np.full(run.max() + 1 if len(run) else 0, _LARGEST)
    np.minimum.at(least, run, doc)
    return at, region[at], doc, least[run] if len(run) else run


def _ranges(at: np.ndarray, region: np.ndarray, begin: np.ndarray, length: int):
    """Maximal ranges of removed bytes per region: region, first, end (from the region's begin)."""
    order = np.argsort(at)
    at, region = at[order], region[order]
    head = np.concatenate(([True], (at[1:] > at[:-1] + length) | (region[1:] != region[:-1]))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.concatenate((first[1:] - 1, [len(at) - 1])) if len(at) else first
    return region[first], at[first] - begin[region[first]], at[last] + length - begin[region[first]]


def _shard(length: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blocks = list(spans_of(table.column("bytes")))
        text, begin, size = blocks
        ids = table.column("key").to_numpy()
        at, region, doc, least = _judged(text, begin, size, ids, length)
        start, e, h = (table.column(c).to_numpy() for c in ("start", "e", "h"))

        def rows(r, a, b, windows):
            place = _place(start[r], size[r], a, b)
            return pa.table([pa.array(ids[r]), pa.array(place), pa.array(e[r]), windows], [*_SPAN, "window"])

        gone = doc > least
        r, a, b = _ranges(at[gone], region[gone], begin, length)
        out = rows(r, a, b, pa.nulls(len(r), pa.binary()))
        first = ~gone & _is_hot(h.view(np.uint64), hot)[region]
        if first.any():
            at, r = at[first], region[first]
            windows = pa.array([w.tobytes() for w in text[at[:, None] + np.arange(length)]], pa.binary())
            out = pa.concat_tables([out, rows(r, at - begin[r], at - begin[r] + length, windows)])
        return out

    return run


def spans_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column one after another, and where each value begins and its size."""
    column = column.combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at[:-1] - at[0], np.diff(at)


def _merged(length: int):
    """First windows of split shards: those that another shard has in a smaller document are
    removed. Rows without a window are settled and pass."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(pc.is_null(table.column("window"))).select(_SPAN)
        table = table.filter(pc.is_valid(table.column("window"))).combine_chunks()
        if not table.num_rows:
            return settled
        text, _, _ = spans_of(table.column("window"))
        windows = text.reshape(-1, length).copy().view(f"S{length}").reshape(-1)
        ids = table.column("key").to_numpy()
        known = np.unique(windows)
        place = np.searchsorted(known, windows)
        least = np.full(len(known), _LARGEST)
        np.minimum.at(least, place, ids)
        gone = pa.array(ids > least[place])
        return pa.concat_tables([settled, table.select(_SPAN).filter(gone)])

    return run


# --- documents -----------------------------------------------------------------------------------


@tidy
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        i = batch.schema.get_field_index("text")
        zipped = [pack((t.as_py() or "").encode()) for t in batch.column(i)]
        columns = [pa.array(zipped, pa.binary()) if k == i else batch.column(k) for k in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _unzip(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())


def _right(data: np.ndarray, start: np.ndarray, size: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which extents are of this text (ids may repeat with other texts)."""
    good = start + size <= len(data)
    good[good] = spans.Hashes(data)(start[good], start[good] + size[good]).view(np.int64) == e[good]
    return good


def _listed(item, names) -> list[np.ndarray]:
    rows = item.values
    return [rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _fetched(shards: int, hot: np.ndarray):
    """The bytes of each extent that was asked for, with the shard they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch.column("asks")
            for i in np.flatnonzero(~np.asarray(asks.is_null())):
                data = np.frombuffer(_unzip(batch.column("text")[i]), dtype=np.uint8)
                place, e, h = _listed(asks[i], ("place", "e", "h"))
                start, size, _, _ = _parts(place)
                good = _right(data, start, size, e)
                start, size, e, h = start[good], size[good], e[good], h[good]
                n = len(start)
                if not n:
                    continue
                shard = _bucket(spans.mix(h.view(np.uint64)), e.view(np.uint64), _mixed(hot), shards)
                raw = [data[x : x + y].tobytes() for x, y in zip(start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard),
                        pa.array(np.full(n, batch.column("key")[i].as_py(), dtype=np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(e),
                        pa.array(h),
                        pa.array(raw, pa.binary()),
                    ],
                    ["shard", "key", "start", "e", "h", "bytes"],
                )

    return tidy(run)


def _mixed(hot: np.ndarray) -> np.ndarray:
    return np.sort(spans.mix(hot))


@tidy
def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its removed bytes."""
    for whole in batches:
        for piece in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(piece, SLICE_ROWS)
            found = batch.column("spans")
            absent = np.asarray(found.is_null())
            total, removed, runs, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = _unzip(batch.column("text")[i])
                n, gone, count = len(raw), 0, 0
                if not absent[i]:
                    data = np.frombuffer(raw, dtype=np.uint8)
                    place, e = _listed(found[i], ("place", "e"))
                    start, size, a, b = _parts(place)
                    good = _right(data, start, size, e)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, (start + a)[good], 1)
                    np.add.at(edge, (start + b)[good], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone = int(cover.sum())
                    count = int((cover & ~np.concatenate(([False], cover[:-1]))).sum())
                    raw = data[~cover].tobytes()
                total.append(n)
                removed.append(gone)
                runs.append(count)
                kept.append(raw)
            rest = [c for c in batch.schema.names if c not in ("key", "text", "spans")]
            columns = [batch.column(c) for c in rest] + [pa.array(c, pa.int64()) for c in (total, removed, runs)]
            columns += [pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot_probes: int = HOT_PROBES,
) -> DataFrame:
    """The columns of ``docs`` but the text, with n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte is removed when a string of ``length`` bytes covers it that also starts in a document
    with a smaller id; strings are those of the input and never cross documents. ``kept`` are the
    remaining bytes.

    What moves: about one extent per 15 bytes of text as some 16 compressed bytes, the compressed
    texts once (both joins read the same exchange), and the bytes of the few extents that differ at
    a shared anchor. Extents that are equal within a task go on as one, so a passage in a third of
    all documents costs a row per task; anchors with very many different extents (counted on a
    fixed share of all extents) are split over shards by their extents.

    Defined cases: a null or empty text has no bytes; a null id is larger than any other, and rows
    with equal ids never remove from each other, also when their texts differ; ids are integers;
    columns of any name are carried along; empty table, empty result.
    """
    if not 8 <= gram <= length <= 500:
        raise ValueError("a gram has 8 bytes at least and fits into the length, which is at most 500")
    spark = ship(docs).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARE * parts
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LARGEST))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))

    probes = texts.mapInArrow(_probe(length, gram), "h bigint, e bigint").distinct().groupBy("h").count()
    busiest = probes.where(F.col("count") >= hot_probes).orderBy(F.desc("count"), "h").limit(HOT_ANCHORS).collect()
    hot = np.sort(np.array([r["h"] for r in busiest], dtype=np.int64).view(np.uint64))

    blobs = texts.mapInArrow(_extent_batches(length, gram, shards, hot), "bucket bigint, n bigint, blob binary")
    met = blobs.groupBy("bucket").applyInArrow(_met(hot), _ROW)
    asks = (
        met.where("ask")
        .groupBy("key")
        .agg(F.collect_list(F.struct("place", "e", "h")).alias("asks"))
        .withColumnRenamed("key", "asked")
    )

    taken = ["key", "text", "spans", "asks", "asked", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    others = {c: fresh(f"c{i}", taken) for i, c in enumerate(c for c in docs.columns if c != text_col)}
    carried = docs.select(
        key.alias("key"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in others.items()]
    )
    kinds = dict(carried.dtypes) | {"text": "binary"}
    zipped = carried.mapInArrow(_zipped, ", ".join(f"`{c}` {kinds[c]}" for c in carried.columns))
    regions = zipped.join(asks, F.col("key") == F.col("asked"), "left").mapInArrow(
        _fetched(shards, hot), "shard bigint, key bigint, start int, e bigint, h bigint, bytes binary"
    )
    span = "key bigint, place bigint, e bigint"
    judged = regions.groupBy("shard").applyInArrow(_shard(length, hot), span + ", window binary")
    if len(hot):
        # Settled rows are dealt evenly, windows by their bytes.
        spread = F.when(F.col("window").isNull(), F.xxhash64("key", "place")).otherwise(F.xxhash64("window"))
        merged = judged.withColumn("part", F.pmod(spread, F.lit(shards)))
        judged = merged.groupBy("part").applyInArrow(_merged(length), span)
    found = met.where("not ask").select(*_SPAN).unionByName(judged.select(*_SPAN))
    spans_by = found.groupBy("key").agg(F.collect_list(F.struct("place", "e")).alias("spans"))
    joined = zipped.join(spans_by.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").drop("of")
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in others.values())
    out = joined.mapInArrow(
        _cleaned,
        f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    back = [F.col(n).alias(c) for c, n in others.items() if c.lower() not in added]
    return out.select(*back, *added)


def _decoded(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.as_py().decode("utf-8", "ignore") for k in batch.column("kept")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names
            )

    return tidy(run)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the remaining text in place of the text, and its code points in ``chars_col``.

    A character of which only some bytes remain is left out; a null text becomes the empty text.
    """
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    name = dict(zip(own, plain.columns))
    found = remove_repeats(plain, name[id_col], name[text_col])
    texts = found.mapInArrow(_decoded(plain.columns, name[text_col]), plain.schema)
    if chars_col in name:
        count = F.length(name[text_col]).cast(plain.schema[name[chars_col]].dataType)
        texts = texts.withColumn(name[chars_col], count)
    return texts.toDF(*own)


def op9_suffix_dedup(spark, sf_dir):
    """Repeated 50-byte strings of the whole documents table, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

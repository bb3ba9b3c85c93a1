"""Near duplicates by a token-group matrix: exact Jaccard links of word n-grams, and their components.

Sets that are equal are one node. Nodes are partitioned into groups of similar sets: a group is a
pivot with sets that link to it, found by equal min-hashes. For each group the union of its members'
prefix tokens is stored as rows (token, group), the matrix. A set and a group of linked sets share
at least so many prefix tokens; groups that share fewer with a query, or whose sizes are too far
off, stay closed. An open group is first compared by its pivot. If query and group are not in one
component then, its other members are compared only where the pivot leaves room: by the triangle
inequality, and by the tokens that query and member share outside the pivot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import fresh, ship, table_folder, tidy, written
from .components import components

WORDS = 5
#: Two sets link when 100 * intersection >= SHARE * union.
SHARE = 80
#: One text in so many is counted to find frequent tokens, which are put last in the order.
PROBE = 32
#: A token is frequent when that many counted texts, or this share of them, have it.
FREQUENT, FREQUENT_SHARE = 3, 4096
#: A set of n tokens has 1 + n / EXTRA prefix tokens more than a link needs.
EXTRA = 50
#: Prefix tokens that a task sorts and hands on together; buckets per shuffle partition.
BATCH_TOKENS = 1 << 19
BUCKETS = 8
#: Pairs whose texts are unpacked together.
SLICE_ROWS = 256
#: Rounds in which sets that have no group yet look for a pivot, each with its own min-hash.
ROUNDS = 2
_U = np.uint64
_KEYS = spans.mix(np.arange(11, 11 + 2 + ROUNDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def sets_of(block: spans.Block, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; texts with fewer words are one n-gram."""
    first, last, doc = block.words()
    hashes = block.hashed(lower=True)(first, last)
    runs = spans.sequences(hashes, words)
    at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(block)))))
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(spans.sequences(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def _columns(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for block in spans.blocks(batch.column("text")):
        yield block.first, sets_of(block, words)


def _described(words: int):
    """Size, two set hashes and min-hashes of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, found in _columns(batch, words) for s in found]
            keys = np.zeros((2 + ROUNDS, len(sets)), dtype=np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    keys[0, i] = spans.mix(s ^ _KEYS[0]).sum()
                    keys[1, i] = np.bitwise_xor.reduce(spans.mix(s ^ _KEYS[1]))
                    for k in range(2, 2 + ROUNDS):
                        keys[k, i] = spans.mix(s ^ _KEYS[k]).min()
            columns = [batch.column("id"), batch.column("body"), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(k.view(np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays(columns, ["id", "body", "n", "k1", "k2", *[f"m{k}" for k in range(ROUNDS)]])

    return tidy(run)


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _columns(batch, words):
                tokens, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    return tidy(run)


def _needed(n: int, share: int) -> int:
    """Least intersection of a linked set with a set of n tokens."""
    return -(-n * share // 100)


def prefix_of(tokens: np.ndarray, frequent: np.ndarray, share: int) -> np.ndarray:
    """The first tokens in the order (frequent, hash) among which linked sets must meet."""
    n = len(tokens)
    size = min(n, n - _needed(n, share) + 1 + n // EXTRA)
    late = _among(tokens, frequent)
    rare = tokens[~late]
    return rare[:size] if len(rare) >= size else np.concatenate((rare, tokens[late][: size - len(rare)]))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _zip_pairs(token: np.ndarray, key: np.ndarray) -> bytes:
    """Two arrays as compressed byte planes; tokens without their two lowest bytes."""
    planes = [token.view(np.uint8).reshape(-1, 8).T[2:], key.view(np.uint8).reshape(-1, 8).T]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def _unzip_pairs(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(14, n)
    token = np.zeros((n, 8), dtype=np.uint8)
    token[:, 2:] = flat[:6].T
    return token.reshape(-1).view("<u8"), np.ascontiguousarray(flat[6:].T).reshape(-1).view("<u8")


def _prefixes(words: int, share: int, frequent: np.ndarray, buckets: int):
    """Prefix tokens with their set's hash, compressed per bucket of tokens.

    Equal pairs go on once per task. Frequent tokens are known to be shared; their batches have a
    negative count and buckets that depend on token and set, so no bucket holds all of one.
    """

    def packed(token, key, to, sign):
        order = np.lexsort((token, to))
        token, key, to = token[order], key[order], to[order]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
        blobs = [_zip_pairs(token[a:b], key[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(to[cuts[:-1]]), pa.array(sign * np.diff(cuts)), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"]
        )

    def flushed(held):
        token, key = (np.concatenate(c) for c in zip(*held))
        late = _among(token, frequent)
        token = token & ~_U(0xFFFF)
        for rows, sign in ((~late, 1), (late, -1)):
            t, k = token[rows], key[rows]
            if len(t):
                spread = t if sign > 0 else spans.mix(t ^ k)
                yield packed(t, k, ((spread >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), sign)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()
        for batch in batches:
            for _, sets in _columns(batch, words):
                for s in sets:
                    if not len(s):
                        continue
                    key = int(spans.mix(s ^ _KEYS[0]).sum())
                    if key in known:
                        continue
                    known.add(key)
                    p = prefix_of(s, frequent, share)
                    held.append((p, np.full(len(p), key, dtype=np.uint64)))
                    size += len(p)
                if size >= BATCH_TOKENS:
                    yield from flushed(held)
                    held, size, known = [], 0, set()
        if held:
            yield from flushed(held)

    return tidy(run)


def _shared(table: pa.Table) -> pa.Table:
    """(token, k1) of the tokens of a bucket that two different sets have, and of frequent ones."""
    out = []
    counts, blobs = table.column("n").to_pylist(), table.column("blob").to_pylist()
    rare = [_unzip_pairs(b, n) for n, b in zip(counts, blobs) if n > 0]
    late = [_unzip_pairs(b, -n) for n, b in zip(counts, blobs) if n < 0]
    if rare:
        token, key = (np.concatenate(c) for c in zip(*rare))
        order = np.argsort(token)
        token, key = token[order], key[order]
        same = token[1:] == token[:-1]
        several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        token, key = token[several], key[several]
        if len(token):
            order = np.lexsort((key, token))
            token, key = token[order], key[order]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))
            token, key = token[new], key[new]
            head = np.concatenate(([True], token[1:] != token[:-1]))
            group = np.cumsum(head) - 1
            several = np.bincount(group)[group] > 1
            out.append((token[several], key[several]))
    out += late
    token, key = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return pa.table({"token": pa.array(token.view(np.int64)), "k1": pa.array(key.view(np.int64))})


@tidy
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts; rows that repeat id and text go on once per task."""
    pack, known = zstandard.ZstdCompressor(level=3).compress, set()
    for batch in batches:
        at = []
        for i, name in enumerate(zip(batch.column("id").to_pylist(), batch.column("body").to_pylist())):
            if name not in known:
                known.add(name)
                at.append(i)
        batch = batch.take(pa.array(at, pa.int64()))
        texts = [pack((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("body"), pa.array(texts, pa.binary())], ["id", "body", "text"]
        )


def _compared(words: int):
    """Sizes and intersection of the sets of the two compressed texts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                n = batch.num_rows
                raw = [unpack(v.as_py()) for c in ("x", "y") for v in batch.column(c)]
                sets = [s for b in spans.blocks(pa.array(raw, pa.binary())) for s in sets_of(b, words)]
                common = [int(_among(x, y).sum()) for x, y in zip(sets[:n], sets[n:])]
                rest = [c for c in batch.schema.names if c not in ("x", "y")]
                found = [common, [len(s) for s in sets[:n]], [len(s) for s in sets[n:]]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in rest] + [pa.array(c, pa.int64()) for c in found], [*rest, "common", "nx", "ny"]
                )

    return tidy(run)


class Texts:
    """Compressed texts of nodes, stored by node, so that joining them to a node moves only the pairs."""

    def __init__(self, nodes: DataFrame, words: int):
        self.spark, self.words, self.schema = nodes.sparkSession, words, nodes.schema
        self.name = f"texts_{uuid.uuid4().hex}"
        self.path = f"{table_folder(self.spark).rstrip('/')}/{self.name}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        stored = nodes.repartition(parts, "node").dropDuplicates(["node"]).write.bucketBy(parts, "node").sortBy("node")
        stored.format("parquet").option("path", self.path).saveAsTable(self.name)

    def compared(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``pairs`` with common, nx, ny: intersection and sizes of the sets of nodes a and b.

        ``b`` may be hot (a pivot of many): its join is one that adaptive execution can split.
        """
        kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
        return self._joined(pairs, a, b).mapInArrow(
            _compared(self.words), f"{kinds}, common bigint, nx bigint, ny bigint"
        )

    def outside(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``pairs`` with ``token``: a row per token of the set of a that the set of b does not have."""
        kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
        return self._joined(pairs, a, b).mapInArrow(_outside(self.words), f"{kinds}, token bigint")

    def _joined(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        left = self.spark.table(self.name).select(F.col("node").alias(a), F.col("text").alias("x"))
        right = self.spark.read.schema(self.schema).parquet(self.path).select(F.col("node").alias(b), F.col("text").alias("y"))
        return pairs.join(left, a).join(right, b).select(*pairs.columns, "x", "y")

    def close(self) -> None:
        """Forget the table; its files stay in the shared folder."""
        self.spark.sql(f"drop table if exists {self.name}")


def _outside(words: int):
    """The tokens of the first compressed text of each row that the second does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                n = batch.num_rows
                raw = [unpack(v.as_py()) for c in ("x", "y") for v in batch.column(c)]
                sets = [s for b in spans.blocks(pa.array(raw, pa.binary())) for s in sets_of(b, words)]
                own = [x[~_among(x, y)] for x, y in zip(sets[:n], sets[n:])]
                row = pa.array(np.repeat(np.arange(n), [len(x) for x in own]))
                rest = [c for c in batch.schema.names if c not in ("x", "y")]
                token = pa.array(np.concatenate(own).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in rest], token], [*rest, "token"])

    return tidy(run)


def _linked(share: int) -> Column:
    return F.expr(f"100 * common >= {share} * (nx + ny - common)")


def _distance() -> Column:
    return F.expr("1 - common / (nx + ny - common)")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: int = SHARE
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Scans write short rows per text; texts move once, compressed, and only those of nodes that share
    a prefix token with another are stored for comparison. Pairs are made between a node and pivots of open
    groups, not within groups; a family of many near copies costs one comparison per node and
    group, and groups whose component the node is in are never opened further.

    Defined cases: null and empty texts have the empty set, no link, and their own id as component;
    rows that share an id count as one document, whose links are those of all its texts; rows
    without an id are each a document of their own, larger than any id, and a component of such rows
    alone is null; empty table, empty result.
    """
    rows = _component_rows(docs, id_col, text_col, words, share, by_id=True)
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id")
    )


def _hashed_text(text_col: str) -> Column:
    """What tells rows that share an id (or have none) apart."""
    return F.xxhash64(F.col(text_col))


def _component_rows(docs: DataFrame, id_col: str, text_col: str, words: int, share: int, by_id: bool) -> DataFrame:
    """(id, body, n, first) of every row: ``first`` (none, id, body) is the smallest row of its component,
    null for empty sets. Sets are linked, and with ``by_id`` also the sets of rows that share an id."""
    spark = ship(docs).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), _hashed_text(text_col).alias("body"), F.col(text_col).alias("text")
    )
    marks = [f"m{k}" for k in range(ROUNDS)]
    kinds = "id bigint, body bigint, n bigint, k1 bigint, k2 bigint, " + ", ".join(f"{m} bigint" for m in marks)
    node = F.xxhash64("n", "k1", "k2")
    described = written(texts.mapInArrow(_described(words), kinds).withColumn("node", node))
    none = F.col("id").isNull().alias("none")
    classes = written(
        described.where("n > 0")
        .groupBy("n", "k1", "k2")
        .agg(F.min(F.struct(none, "id", "body")).alias("first"), *[F.min(m).alias(m) for m in marks])
        .withColumn("node", node)
    )

    probe = texts.where(F.pmod(F.xxhash64("text"), F.lit(PROBE)) == 0)
    total = described.count()
    least = max(FREQUENT, total // PROBE // FREQUENT_SHARE)
    counts = probe.mapInArrow(_counted(words), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(1_000_000).select("token").collect()
    frequent = np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))

    blobs = texts.mapInArrow(_prefixes(words, share, frequent, BUCKETS * parts), "bucket bigint, n bigint, blob binary")
    shared = blobs.groupBy("bucket").applyInArrow(_shared, "token bigint, k1 bigint")
    tokens = written(shared.join(classes.select("k1", "node", "n"), "k1").select("token", "node", "n").distinct())
    met = tokens.groupBy("node").agg((F.count("*") / F.max("n")).alias("met"))
    nodes = written(
        classes.join(met, "node").groupBy("node").agg(F.max("met").alias("met"), F.min("first").alias("first"), *[F.min(m).alias(m) for m in marks])
    )
    # One text stands for a node; several rows may repeat its id and text.
    named = nodes.select("node", F.col("first.id").alias("of"), F.col("first.body").alias("like"))
    zipped = texts.mapInArrow(_zipped, "id bigint, body bigint, text binary")
    chosen = zipped.join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("like")))
    stored = Texts(chosen.select("node", "text"), words)

    # Groups: a pivot and the sets linked to it. The pivot is the set with the largest share of
    # tokens that others have: of a text and its edited copies, the text.
    found = nodes.select("node").where("false").select("node", F.col("node").alias("pivot"))
    linked = found.withColumns({"apart": F.lit(0.0), "common": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
    left = pool = nodes
    for mark in marks:
        central = F.max_by("node", F.struct("met", F.bitwise_not("node")))
        pivots = pool.groupBy(mark).agg(central.alias("pivot"), F.count("*").alias("c")).where("c > 1")
        pairs = left.join(pivots, mark).where("node <> pivot").select("node", "pivot")
        joined = written(
            stored.compared(pairs, "node", "pivot")
            .where(_linked(share))
            .groupBy("node", "pivot")
            .agg(F.min(_distance()).alias("apart"), F.max("common").alias("common"), F.min("nx").alias("size"))
        )
        linked = linked.unionByName(joined)
        pool = written(nodes.join(linked.select("node"), "node", "left_anti"))
        left = pool.join(linked.select(F.col("pivot").alias("node")).distinct(), "node", "left_anti")
    own = pool.select("node", F.col("node").alias("pivot"), F.lit(0.0).alias("apart"))
    sizes = classes.groupBy("node").agg(F.min("n").alias("size"), F.max("n").alias("common"))
    members = written(linked.unionByName(own.join(sizes, "node")))

    # The matrix, and the groups that a node's prefix tokens open. Of two groups the smaller one asks:
    # a family of thousands is not compared one by one with each set beside it.
    held = members.groupBy("pivot").agg(F.count("*").alias("held"))
    named = tokens.join(members.select("node", "pivot").join(held, "pivot"), "node")
    matrix = named.groupBy("token", "pivot").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("held").alias("holds")
    )
    query = named.select(
        "token", F.col("node").alias("query"), F.col("n").alias("own"), F.col("pivot").alias("home"), "held"
    )
    opened = (
        query.join(matrix, "token")
        .where("held < holds or held = holds and home > pivot")
        .where("100 * most >= {0} * own and 100 * own >= {0} * least".format(share))
        .groupBy("query", "home", "pivot", "own")
        .agg(F.count("*").alias("met"))
        .where(f"met >= 1 + {share} * own div {100 * EXTRA}")
        .select("query", "home", "pivot")
        .distinct()
    )
    by_pivot = written(
        stored.compared(opened, "query", "pivot").withColumn("far", _distance()).withColumn("link", _linked(share))
    )
    edges = by_pivot.where("link").select(F.col("home").alias("u"), F.col("pivot").alias("v"))
    first = components(edges)

    # Other members of open groups in another component, where the triangle inequality leaves room.
    of = lambda name, to: first.select(F.col("u").alias(name), F.col("component").alias(to))
    apart = (
        by_pivot.groupBy("query", "home", "pivot")
        .agg(
            F.min("far").alias("far"),
            F.max("link").alias("linked"),
            F.max("common").alias("shares"),
            F.min("nx").alias("length"),
        )
        .where("not linked")
        .join(of("home", "ch"), "home", "left")
        .join(of("pivot", "cp"), "pivot", "left")
        .where("coalesce(ch, home) <> coalesce(cp, pivot)")
        .select("query", "home", "pivot", "far", "shares", "length")
    )
    reach = 1 - share / 100 + 1e-9
    others = members.where("node <> pivot").withColumnRenamed("node", "member")
    open_still = written(
        apart.where(F.col("far") <= 2 * reach).join(others.select("pivot").distinct(), "pivot", "left_semi")
    )
    # A link needs share / (100 + share) of both sizes in common; at most ``shares`` of these lie in
    # the pivot, so the rest must be tokens that query and member share outside it. Members of one
    # band are equally far from the pivot, so a query meets bands, and the members of fitting ones.
    band = ["pivot", "size", "common"]
    bands = others.groupBy(*band).agg(F.min("apart").alias("near"), F.max("apart").alias("apart"))
    fitting = (
        open_still.join(bands, "pivot")
        .where((F.col("far") - F.col("apart") <= reach) & (F.col("near") - F.col("far") <= reach))
        .where(f"{100 + share} * least(shares, common) >= {share} * (length + size)")
    )
    direct = fitting.join(others.select("member", *band), band).select("query", "home", "pivot", "member")
    asked = stored.outside(open_still.select("query", "home", "pivot", "shares", "length"), "query", "pivot")
    wanted = others.join(open_still.select("pivot").distinct(), "pivot", "left_semi").select("member", "pivot", "size")
    offered = stored.outside(wanted, "member", "pivot")
    beside = (
        asked.join(offered, ["pivot", "token"])
        .groupBy("query", "home", "pivot", "member", "shares", "length", "size")
        .agg(F.count("*").alias("more"))
        .where(f"{100 + share} * (shares + more) >= {share} * (length + size)")
        .select("query", "home", "pivot", "member")
    )
    pairs = direct.unionByName(beside).distinct()
    further = stored.compared(pairs, "query", "member").where(_linked(share))
    links = edges.unionByName(further.select(F.col("home").alias("u"), F.col("pivot").alias("v"))).unionByName(
        members.select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    )
    found = written((links.unionByName(_versions(described)) if by_id else links).distinct())
    stored.close()
    return _labelled(described, classes, components(found))


def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; all columns as they were.

    Rows are linked by their texts alone, and go by id and hash of the text, from a written table
    whose size the planner knows: what a row shares its id with does not matter, null or not.
    """
    mark, of, own = (fresh(name, docs.columns) for name in ("gone", "gone_body", "own_body"))
    rows = written(_component_rows(docs, id_col, text_col, WORDS, SHARE, by_id=False).where("n > 0"))
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("body") == F.col("first.body"))
    pair = F.col("id").alias(mark), F.col("body").alias(of)
    losers = written(rows.where(~kept).select(*pair).distinct())
    again = written(rows.where(kept).groupBy(*pair).count().where("count > 1").select(mark, of))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(mark)) & (F.col(own) == F.col(of))
    stay = docs.withColumn(own, _hashed_text(text_col)).join(losers, same, "left_anti")
    if again.isEmpty():  # no row repeats the id and text of a kept one
        return stay.select(*docs.columns)
    once = stay.join(again, same, "left")
    single = once.where(F.col(of).isNull()).select(*docs.columns)
    first = once.where(F.col(of).isNotNull()).dropDuplicates([id_col, of]).select(*docs.columns)
    return single.unionByName(first)


def _versions(described: DataFrame) -> DataFrame:
    """Edges between the nodes of rows that share an id."""
    named = described.where("n > 0 and id is not null")
    least = named.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last")
    return named.select("id", F.col("node").alias("u")).join(least, "id").select("u", "v")


def _labelled(described: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = written(
        classes.join(found.withColumnRenamed("u", "node"), "node", "left").select(
            "n", "k1", "k2", "first", F.coalesce("component", "node").alias("component")
        )
    )
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    of_class = named.drop("first").join(least, "component").drop("component")
    return described.join(of_class, ["n", "k1", "k2"], "left").select("id", "body", "n", "first")


def op1_jaccard_join(spark, sf_dir):
    """Components of near duplicates of the whole documents table."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

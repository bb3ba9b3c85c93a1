"""Tables of posterior draws and of simulated histories."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.chronology import side_by_side_hashes
from ..functions.physics import softplus
from ..sources.storage import stored, unweighed_batches
from . import metrics, ordering
from .scoring import weighted_density


# --- temporal whitening ------------------------------------------------------


def apply_age_matrix(
    series: DataFrame,
    matrix: np.ndarray,
    keys: Sequence[str],
    value: str = "value",
    age_idx: str = "age_idx",
) -> DataFrame:
    """Multiply every series over the age list by a square matrix.

    The ages of a series become one sum per age (merged on the map side), then each
    output age is one inner product with a literal matrix row: one shuffle of the
    input, none of the products. The result is null when an age is missing.
    """
    n = matrix.shape[0]
    slots = [
        F.sum(F.when(F.col(age_idx) == k, F.col(value))).alias(f"_s{k}") for k in range(n)
    ]
    packed = series.groupBy(*keys).agg(*slots).select(
        *keys, F.array(*[f"_s{k}" for k in range(n)]).alias("_x")
    )
    rows = F.transform(
        temporal.matrix_literal(matrix),
        lambda row: F.aggregate(
            F.zip_with(row, "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
        ),
    )
    return packed.select(*keys, F.posexplode(rows).alias(age_idx, value))


def whiten(
    series: DataFrame,
    ages: Sequence[float],
    lengthscale: float,
    keys: Sequence[str] = ("history_id", "dim"),
    amplitude: float = 1.0,
) -> DataFrame:
    matrix = temporal.whitening_matrix(ages, lengthscale, amplitude)
    return apply_age_matrix(series, matrix, keys)


def unwhiten(
    series: DataFrame,
    ages: Sequence[float],
    lengthscale: float,
    keys: Sequence[str] = ("history_id", "dim"),
    amplitude: float = 1.0,
) -> DataFrame:
    return apply_age_matrix(series, temporal.gp_cholesky(ages, lengthscale, amplitude), keys)


def latent_prior_nll(white: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half the mean square of whitened cores."""
    v = F.col("value")
    return white.groupBy(*by).agg((0.5 * F.avg(v * v)).alias("latent_gp_nll"))


def train_normalisation(white: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Mean and population spread per dimension, from training histories only."""
    return (
        white.where(F.col("split") == "train")
        .groupBy("dim")
        .agg(
            F.avg("value").alias("mean"),
            F.greatest(F.stddev_pop("value"), F.lit(float(floor))).alias("scale"),
        )
    )


def normalise(white: DataFrame, statistics: DataFrame) -> DataFrame:
    joined = white.join(statistics, "dim")
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale")).drop(
        "mean", "scale"
    )


# --- decoding ----------------------------------------------------------------


def core_at(cores: DataFrame, ages: DataFrame, step: float, n_anchors: int, keys=("r", "s")):
    """Cores interpolated linearly to the ages of ``ages`` (column ``age``)."""
    weights = ages.select(
        "age", F.explode(temporal.anchor_weights("age", step, n_anchors)).alias("w")
    ).select("age", F.col("w.anchor").alias("age_idx"), F.col("w.w").alias("_w"))
    return (
        cores.join(weights, "age_idx")
        .groupBy("age", *keys)
        .agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    )


def tucker_value(
    spatial="spatial", context="context", core="core", base="base", *, scale_km: float, epsilon: float
) -> Column:
    """Positive thickness from factor arrays: softplus(base + scaled bilinear form) + eps.

    ``core`` is an array of rows, one per spatial factor.
    """
    ranks = F.size(spatial) * F.size(context)
    inner = F.zip_with(
        spatial,
        core,
        lambda a, row: a
        * F.aggregate(
            F.zip_with(row, context, lambda c, b: c * b), F.lit(0.0), lambda x, v: x + v
        ),
    )
    raw = F.aggregate(inner, F.lit(0.0), lambda x, v: x + v)
    return softplus(F.col(base) + raw * scale_km / F.sqrt(ranks)) + epsilon


# --- draws -------------------------------------------------------------------


def posterior_summary(
    draws: DataFrame, keys: Sequence[str], value: str = "value", alpha: float = 0.1
) -> DataFrame:
    """Mean and central interval over all chains and draws of every key."""
    q = ordering.exact_quantiles(
        draws, keys, value, {"lower": alpha / 2, "upper": 1 - alpha / 2}
    )
    mean = draws.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(q, list(keys))


def split_rhat(draws: DataFrame) -> DataFrame:
    """Largest split R-hat over dimensions (one row, null when it is not defined).

    ``draws`` has (chain, draw, dim, value), draws numbered from 0 in every chain.
    Each chain gives its first and its last half; only moments are shuffled.
    """
    shape = draws.agg(
        (F.floor((F.max("draw") + 1) / 2)).alias("n"),
        (F.max("draw") + 1).alias("draws"),
        F.count_distinct("chain").alias("chains"),
    )
    info = shape.select(F.struct("n", "draws", "chains").alias("s")).scalar()
    marked = draws.withColumn("_s", info)
    half = F.when(F.col("draw") < F.col("_s.n"), 0).when(
        F.col("draw") >= F.col("_s.draws") - F.col("_s.n"), 1
    )
    halves = (
        marked.withColumn("_half", half)
        .where(F.col("_half").isNotNull())
        .groupBy("dim", "chain", "_half")
        .agg(
            F.avg("value").alias("m"),
            F.var_samp("value").alias("v"),
            F.first("_s.n").alias("n"),
            F.first("_s.chains").alias("chains"),
        )
    )
    n = F.col("n")
    per_dim = halves.groupBy("dim").agg(
        F.avg("v").alias("within"),
        (F.first("n") * F.var_samp("m")).alias("between"),
        F.first("n").alias("n"),
        F.first("chains").alias("chains"),
    )
    variance = (n - 1) / n * F.col("within") + F.col("between") / n
    usable = (F.min("chains") >= 2) & (F.min("n") >= 2) & (F.min("within") > 0)
    return per_dim.withColumn("_r", F.sqrt(variance / F.col("within"))).agg(
        F.when(usable, F.max("_r")).alias("max_split_rhat")
    )


def _record_blocks():
    """``blocks(batches, column, rows)``: whole records from batches in which a record's rows follow each other.

    Gives (table, starts) with the row where each record begins. Records must come in the order of
    their keys, nulls first, so rows of a record that are apart are noticed; then the task fails.
    Nested and without globals, so that executors need no copy of this library.
    """

    def blocks(batches, column, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def parted(held, before, ended):
            """(records that are whole, the other rows, the last key of the whole ones)."""
            table = pa.Table.from_batches(held).combine_chunks()
            runs = pc.run_end_encode(table.column(column).combine_chunks(), run_end_type=pa.int64())
            ends, keys = runs.run_ends.to_numpy(), runs.values
            n = len(ends) if ended else len(ends) - 1
            if not n:
                return None, table.to_batches(), before
            seen = keys[:n] if before is None else pa.concat_arrays([before, keys[:n]])
            nulls = seen.null_count > 1 or seen.null_count and seen[0].is_valid
            if nulls or pc.any(pc.greater_equal(seen[:-1], seen[1:])).as_py():
                raise ValueError(f"rows are not laid out by {column}")
            end = int(ends[n - 1])
            whole = table.slice(0, end).combine_chunks(), np.concatenate(([0], ends[: n - 1]))
            return whole, table.slice(end).to_batches(), keys[n - 1 : n]

        held, more, before = [], 0, None
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                more += batch.num_rows
            if more >= rows:
                block, held, before = parted(held, before, False)
                more = 0
                if block:
                    yield block
        if held:
            yield parted(held, before, True)[0]

    return blocks


def _score_records(blocks):
    """Averages the draws of many records at once; a row for each record."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for table, starts in blocks(batches, "observation_id", 32768):
            n = len(starts)
            record = np.repeat(np.arange(n), np.diff([*starts, table.num_rows]))
            draws = pc.dictionary_encode(table.column("draw").combine_chunks(), null_encoding="encode")
            width = len(draws.dictionary)
            group = record * width + draws.indices.to_numpy()

            def mean(name):
                """Mean of the draws' sums that are not null, and which records have one."""
                column = table.column(name)
                good = column.is_valid().to_numpy() if column.null_count else slice(None)
                sums = np.bincount(group[good], column.to_numpy()[good], n * width).reshape(n, width)
                there = (np.bincount(group[good], minlength=n * width) > 0).reshape(n, width).sum(axis=1)
                return sums.sum(axis=1) / np.maximum(there, 1), there > 0

            (p, has_p), (e, has_e) = mean("p"), mean("e")
            with np.errstate(all="ignore"):
                nll = -np.log(p)
            first = table.select(["observation_id", "y"]).take(starts).combine_chunks()
            columns = [first.column("observation_id"), pa.array(nll, mask=~has_p | (p <= 0)), pa.array(e, mask=~has_e), first.column("y")]
            yield from pa.table(columns, ["observation_id", "nll", "expected", "y"]).to_batches()

    return run


def predictive_scores(nodes: DataFrame, laid_out: bool = False) -> DataFrame:
    """Per record: predictive NLL over draws and the expected value.

    ``nodes`` has ``observation_id, draw, node_weight, mu, y, sigma``. A record has
    nodes x draws rows; densities are averaged over draws after the node mixture. Rows are summed
    as they pass by, in arrays of many records; ``laid_out`` as for ``predictive_samples``.
    """
    rows = nodes if laid_out else ordering.laid_out(nodes, "observation_id")
    terms = rows.select(
        "observation_id",
        "draw",
        weighted_density().cast("double").alias("p"),
        (F.col("node_weight") * F.col("mu")).cast("double").alias("e"),
        "y",
    )
    types = {c: t for c, t in terms.dtypes}
    return unweighed_batches(terms).mapInArrow(
        _score_records(_record_blocks()),
        f"observation_id {types['observation_id']}, nll double, expected double, y {types['y']}",
    )


def _sample_records(n_draws: int, picks: int, seed: int, hashes, blocks):
    """Picks a draw, a node and a deviate ``picks`` times for many records at once; a row for each record.

    ``hashes`` has a tail for each pick.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def uniforms(name, letters, lengths, wanted):
            """The 32-bit numbers of every pick of the wanted records; keys of one length are hashed together."""
            out = np.empty((len(lengths), picks), dtype=np.uint32)
            for length in np.unique(lengths[wanted]):
                rows = np.flatnonzero(wanted & (lengths == length))
                middles = np.frombuffer(b"".join([letters[i] for i in rows]), dtype=np.uint8)
                out[rows] = hashes(f"{seed}-{name}-".encode(), middles.reshape(len(rows), length))
            return out

        def deviates(word):
            """``t4_quantile`` of half-open 32-bit uniforms moved to bin centres, which keeps it finite."""
            p = word / 4294967296.0
            p += 0.5 / 4294967296.0
            root = 1.0 - p
            root *= p
            root *= 4.0
            np.sqrt(root, out=root)
            q = np.minimum(root, 1.0)
            np.arccos(q, out=q)
            q /= 3.0
            np.cos(q, out=q)
            q /= root
            q -= 1.0
            np.maximum(q, 0.0, out=q)
            np.sqrt(q, out=q)
            q *= 2.0
            p -= 0.5
            return np.copysign(q, p, out=q)

        def complete(starts, sizes, record, draw, node):
            """If every record has each draw of its nodes 0, 1, ... once: node counts and rows by draw and node."""
            m = np.maximum.reduceat(node, starts) + 1
            if (m > sizes).any() or (m * n_draws != sizes).any() or (node < 0).any() or (draw < 0).any() or (draw >= n_draws).any():
                return None
            rows = np.full(len(record), -1)
            rows[starts[record] + draw * m[record] + node] = np.arange(len(record))
            return None if (rows < 0).any() else (m, rows)

        def tables(table, starts):
            """Nodes per record, their weights, and mu, sigma and whether it is there of every draw and node."""
            size = table.num_rows
            sizes = np.diff([*starts, size])
            record = np.repeat(np.arange(len(starts)), sizes)
            values, known = {}, {}
            for name in ("draw", "node_idx", "mu", "sigma", "node_weight"):
                column = table.column(name)
                known[name] = column.is_valid().to_numpy() if column.null_count else np.ones(size, dtype=bool)
                values[name] = column.fill_null(pa.scalar(0, column.type)).to_numpy()
            draw, node, weight = values["draw"], values["node_idx"], np.where(known["node_weight"], values["node_weight"], np.nan)
            good = known["mu"] & known["sigma"]
            plain = known["draw"].all() and known["node_idx"].all() and draw.dtype == node.dtype == np.int64
            simple = complete(starts, sizes, record, draw, node) if plain else None
            if simple:
                m, rows = simple
                before = np.cumsum(m) - m
                heads = weight[rows[np.repeat(starts - before, m) + np.arange(m.sum())]]
                return m, heads, values["mu"][rows], values["sigma"][rows], good[rows]

            # In the order of draw, node, mu, sigma and weight, null first, some may be missing or there twice.
            order = [x for name in reversed(values) for x in (values[name], known[name])]
            order = np.lexsort([*order, record])
            draw, node, weight, good = draw[order], node[order], weight[order], good[order]
            mu, sigma = values["mu"][order], values["sigma"][order]
            has_draw, has_node = known["draw"][order], known["node_idx"][order]
            # A record's nodes in their order, null last, each with the weight of its first row.
            by_node = np.lexsort((node, ~has_node, record))
            parts = np.stack((record, has_node, np.where(has_node, node, 0)))[:, by_node]
            new = np.concatenate(([True], (parts[:, 1:] != parts[:, :-1]).any(axis=0)))
            m = np.bincount(record[by_node[new]], minlength=len(starts))
            number = np.empty(size, dtype=np.int64)
            number[by_node] = np.cumsum(new) - 1
            number -= (np.cumsum(m) - m)[record]
            heads = np.where(has_node, weight, np.nan)[by_node[new]]
            # The first row of each draw and node, or one that is where it would be if there were no others.
            cells = m * n_draws
            base = np.cumsum(cells) - cells
            usable = has_draw & has_node & (draw >= 0) & (draw < n_draws) & (draw == np.floor(draw))
            cell = np.where(usable, base[record] + np.where(usable, draw, 0).astype(np.int64) * m[record] + number, -1)
            rows = np.full(cells.sum(), -1)
            rows[cell[usable][::-1]] = np.flatnonzero(usable)[::-1]
            place = np.arange(len(rows)) + np.repeat(starts - base, cells)
            there = np.flatnonzero(place < np.repeat(starts + sizes, cells))
            there = there[cell[place[there]] == there]
            rows[there] = place[there]
            return m, heads, mu[rows], sigma[rows], good[rows] & (rows >= 0)

        for table, starts in blocks(batches, "observation_id", 32768):
            n = len(starts)
            m, weights, mu, sigma, good = tables(table, starts)
            at_node, at_cell = np.cumsum(m) - m, (np.cumsum(m) - m) * n_draws
            ids = table.column("observation_id").take(starts).combine_chunks()
            texts = table.column("_text").take(starts) if "_text" in table.column_names else ids.cast(pa.string())
            # A key that is null is left out of the text.
            letters = [b"" if t is None else t.encode() + b"-" for t in texts.to_pylist()]
            lengths = np.array([len(t) for t in letters])
            everyone = np.ones(n, dtype=bool)
            draw = uniforms("draw", letters, lengths, everyone) / 4294967296.0 * n_draws
            node = uniforms("node", letters, lengths, m > 1)  # a lone node is picked anyway
            samples = deviates(uniforms("noise", letters, lengths, everyone))
            there = None if good.all() else np.empty((n, picks), dtype=bool)
            for nodes in np.unique(m):
                some = np.flatnonzero(m == nodes)
                pick = np.zeros((len(some), picks), dtype=np.int64)
                if nodes > 1:
                    u, total = node[some] / 4294967296.0, np.zeros(len(some))
                    for j in range(nodes):
                        total = total + weights[at_node[some] + j]  # null or NaN is reached by no pick
                        pick += total[:, None] <= u
                    np.minimum(pick, nodes - 1, out=pick)
                pick += draw[some].astype(np.int64) * nodes
                pick += at_cell[some][:, None]
                samples[some] = mu[pick] + sigma[pick] * samples[some]
                if there is not None:
                    there[some] = good[pick]
            values = pa.array(samples.ravel(), mask=None if there is None else ~there.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(picks)), values)
            yield pa.RecordBatch.from_arrays([ids, lists], ["observation_id", "samples"])

    return run


def predictive_samples(
    nodes: DataFrame, n_draws: int, predictive_draws: int = 256, seed: int = 42, laid_out: bool = False
) -> DataFrame:
    """Reproducible predictive sample per record: (observation_id, samples array).

    For every record and k: a draw by hash, a node by its cumulative weight, and a
    Student-t(4) deviate by the closed-form quantile. ``nodes`` has (observation_id,
    draw, node_idx, node_weight, mu, sigma); draws are numbered from 0 to n_draws - 1.
    A record's rows (nodes times draws) are read once as they pass by; the hashes and picks of many records
    are worked out side by side in arrays, as ``hash_uniform`` and ``t4_quantile`` would: no row is made,
    joined or shuffled for a pick. A pick whose row is missing gives a null sample.
    ``laid_out``: the rows come from records on which ``ordering.laid_out`` was called before they were
    spread, so that they need not be shuffled and sorted here.
    """
    rows = nodes if laid_out else ordering.laid_out(nodes, "observation_id")
    types = dict(nodes.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    for c in ("draw", "node_idx"):
        if types[c] not in (*whole, "float", "double") and not types[c].startswith("decimal"):
            raise ValueError(f"{c} must be a number")
    key = types["observation_id"]
    text = [] if key in (*whole, "string") else [F.col("observation_id").cast("string").alias("_text")]
    columns = rows.select(
        "observation_id",
        *text,
        *[F.col(c).cast("long" if types[c] in whole else "double").alias(c) for c in ("draw", "node_idx")],
        *[F.col(c).cast("double").alias(c) for c in ("node_weight", "mu", "sigma")],
    )
    hashes = side_by_side_hashes([str(k).encode() for k in range(predictive_draws)])
    run = _sample_records(n_draws, predictive_draws, seed, hashes, _record_blocks())
    return unweighed_batches(columns).mapInArrow(run, f"observation_id {key}, samples array<double>")


def _list_quantiles(levels: dict[str, float]):
    """Linear quantiles of every list, null before numbers; lists of one length are sorted together."""

    import pyarrow

    def run(lists):
        import math

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = pc.list_value_length(lists).fill_null(0).to_numpy()
        starts = np.cumsum(lengths) - lengths
        flat = lists.flatten()
        null = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        flat = flat.fill_null(-math.inf).to_numpy()
        out = {name: np.zeros(len(lists)) for name in levels}
        there = {name: np.zeros(len(lists), dtype=bool) for name in levels}
        for length in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == length)
            at = starts[rows][:, None] + np.arange(length)
            values, nulls = np.sort(flat[at], axis=1), 0 if null is None else null[at].sum(axis=1)
            for name, level in levels.items():
                place = (int(length) - 1) * level
                low, high = values[:, math.floor(place)], values[:, math.ceil(place)]
                with np.errstate(all="ignore"):
                    out[name][rows] = low + (high - low) * (place - math.floor(place))
                there[name][rows] = nulls <= math.floor(place)
        return pa.StructArray.from_arrays([pa.array(out[name], mask=~there[name]) for name in levels], list(levels))

    run.__annotations__ = {"lists": pyarrow.Array, "return": pyarrow.Array}  # Spark asks for them
    return run


def predictive_intervals(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Central interval per record, read from its sorted sample; no shuffle."""
    levels = {"lower": alpha / 2, "upper": 1 - alpha / 2}
    quantiles = F.arrow_udf(_list_quantiles(levels), "lower double, upper double")
    found = samples.select("observation_id", quantiles(F.col("samples").cast("array<double>")).alias("_q"))
    return found.select("observation_id", "_q.lower", "_q.upper")


# --- history checks ----------------------------------------------------------


def history_split_report(histories: DataFrame) -> DataFrame:
    """One row of violation counts; ``passed`` only when every rule holds.

    ``histories`` has one row per history: ``history_id, group_id, split``.
    """
    h = histories.select(
        F.trim("history_id").alias("history_id"),
        F.trim("group_id").alias("group_id"),
        F.trim("split").alias("split"),
    )
    empty = F.coalesce((F.col("history_id") == "") | (F.col("group_id") == ""), F.lit(True))
    base = h.agg(
        F.count_if(empty).alias("empty_ids"),
        (F.count("*") - F.count_distinct("history_id")).alias("repeated_ids"),
        F.count_if(
            ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))
        ).alias("bad_splits"),
    )
    groups = h.groupBy("group_id").agg(
        *[
            F.max((F.col("split") == s).cast("int")).alias(s)
            for s in ("train", "validation", "test")
        ]
    )
    sides = F.col("train") + F.col("validation") + F.col("test")
    crossing = groups.agg(
        F.count_if(sides > 1).alias("crossing_groups"),
        F.sum("train").alias("train_groups"),
        F.sum("validation").alias("validation_groups"),
    )
    row = base.withColumn("_g", crossing.select(F.struct("*").alias("s")).scalar())
    row = row.select("empty_ids", "repeated_ids", "bad_splits", "_g.*")
    clean = (
        F.col("empty_ids") + F.col("repeated_ids") + F.col("bad_splits") + F.col("crossing_groups")
    ) == 0
    enough = (F.col("train_groups") >= 2) & (F.col("validation_groups") >= 1)
    return row.withColumn("passed", clean & enough)


def row_digest(columns: Sequence[str]) -> Column:
    """Three 60-bit slices of a row's SHA-256, as decimals.

    Sums of them over a set of rows do not depend on row order and need no gathering.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)

    def word(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    return F.struct(word(1).alias("a"), word(17).alias("b"), word(33).alias("c"))


def content_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fingerprint of a set of rows: SHA-256 of the row count and of digest sums.

    Sums merge on the map side, so even one huge group is one row per task.
    """
    d = df.withColumn("_d", row_digest(columns))
    grouped = d.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.sum(f"_d.{w}").alias(f"_{w}") for w in "abc"],
    )
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_{w}").cast("string") for w in "abc"])
    return grouped.select(*by, "n_rows", F.sha2(text, 256).alias("fingerprint"))


def repeated_histories(cores: DataFrame) -> DataFrame:
    """Fingerprints shared by more than one history (must be empty)."""
    prints = content_fingerprint(cores, ["age_idx", "dim", "value"], ["history_id"])
    return (
        prints.groupBy("fingerprint")
        .agg(F.count("*").alias("copies"), F.min("history_id").alias("first_history"))
        .where(F.col("copies") > 1)
    )


def core_problems(cores: DataFrame, ages: Sequence[float]) -> DataFrame:
    """(history_id, problem) of core histories that do not fit the ages or each other; must be empty.

    ``cores`` has ``history_id, age_idx, dim, value``. Each history needs one finite number for every
    age and dimension, and all histories have the same dimensions. The ages must be two or more,
    finite and rising; otherwise the call itself is refused.
    """
    numbers = [float(a) for a in ages]
    rising = all(a < b for a, b in zip(numbers, numbers[1:]))
    if len(numbers) < 2 or not all(map(math.isfinite, numbers)) or not rising:
        raise ValueError("a history needs two or more finite ages in rising order")
    n = len(numbers)
    whole = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    each = cores.groupBy("history_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("age_idx", "dim").alias("places"),
        F.count_distinct("dim").alias("dims"),
        F.count_if(~F.coalesce(F.col("age_idx").between(0, n - 1), F.lit(False))).alias("outside"),
        F.count_if(~whole).alias("not_finite"),
        F.sum(F.when(F.col("age_idx") == 0, F.xxhash64("dim").cast("decimal(38,0)"))).alias("mark"),
    )
    # The dimensions of most histories count as right; ties fall to the smaller mark.
    usual = each.groupBy("mark").count().agg(F.max_by("mark", F.struct("count", -F.col("mark")))).scalar()
    problem = (
        F.when(F.col("not_finite") > 0, "value is not finite")
        .when(F.col("outside") > 0, "age outside the anchors")
        .when((F.col("n") != F.col("places")) | (F.col("n") != n * F.col("dims")), "ages and dimensions incomplete")
        .when(~F.col("mark").eqNullSafe(usual), "other dimensions")
    )
    return each.select("history_id", problem.alias("problem")).where("problem is not null")


def field_problems(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """(history_id, problem) of field histories that break the contract; must be empty.

    ``fields`` has ``history_id, age_idx, i, j, value, observed`` with a mask of 0 and 1 (or booleans);
    ``expected`` lists the cells ``age_idx, i, j`` every history must have, once each. Cells are
    compared by an order-free fingerprint, so no history is gathered or joined to the grid.
    """
    cells = ["age_idx", "i", "j"]
    keys = [F.col(c).cast("int").alias(c) for c in cells]
    wanted = content_fingerprint(expected.select(*keys), cells).select("fingerprint").scalar()
    mask = F.col("observed").cast("double")
    seen = F.coalesce(mask == 1, F.lit(False))
    v = F.col("value")
    good = F.coalesce((v > 0) & (v < float("inf")) & ~F.isnan("value"), F.lit(False))
    counts = fields.groupBy("history_id").agg(
        F.count_if(~F.coalesce(mask.isin(0.0, 1.0), F.lit(False))).alias("bad_mask"),
        F.count_if(seen).alias("n_observed"),
        F.count_if(seen & ~good).alias("n_bad"),
    )
    prints = content_fingerprint(fields.select("history_id", *keys), cells, ["history_id"])
    problem = (
        F.when(F.col("fingerprint") != wanted, "other grid")
        .when(F.col("bad_mask") > 0, "mask is not 0 or 1")
        .when(F.col("n_observed") == 0, "nothing observed")
        .when(F.col("n_bad") > 0, "observed value is not positive and finite")
    )
    joined = counts.join(prints, counts["history_id"].eqNullSafe(prints["history_id"])).drop(prints["history_id"])
    return joined.select("history_id", problem.alias("problem")).where("problem is not null")


def observed_report(fields: DataFrame) -> DataFrame:
    """Per history: observed cells, and observed cells that are not positive and finite."""
    v = F.col("value")
    bad = F.coalesce(~((v > 0) & (v < float("inf")) & ~F.isnan("value")), F.lit(True))
    return fields.groupBy("history_id").agg(
        F.count_if("observed").alias("n_observed"),
        F.count_if(F.col("observed") & bad).alias("n_bad"),
    ).withColumn("passed", (F.col("n_observed") > 0) & (F.col("n_bad") == 0))


def observed_rmse(fields: DataFrame) -> DataFrame:
    """RMSE over observed cells per history (``value`` against ``prediction``)."""
    e = F.col("prediction") - F.col("value")
    seen = F.col("observed").cast("boolean")
    return fields.where(seen).groupBy("history_id").agg(F.sqrt(F.avg(e * e)).alias("rmse_km"))


def posterior_report(scores: DataFrame, intervals: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: predictive NLL, mean MAE and interval metrics."""
    # Read by two aggregations; a row a record.
    joined = stored(scores.join(intervals, "observation_id"))
    part = metrics.interval_metrics(joined, 1 - alpha)
    core = joined.agg(
        F.avg("nll").alias("posterior_predictive_nll"),
        F.avg(F.abs(F.col("expected") - F.col("y"))).alias("posterior_mean_mae_km"),
    )
    extra = part.select(F.struct("coverage", "mean_width", "interval_score", "n").alias("s")).scalar()
    return core.withColumn("_s", extra).select("*", "_s.*").drop("_s")

"""Age intervals: labels, quadrature nodes and the age-mixture density."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sphere import clip
from .units import AGE_DOMAIN_MA, as_column

# Interval classes and node counts.
WIDE_MYR = 30.0
NARROW_MYR = 5.0
NODES_POINT, NODES_NARROW, NODES_WIDE = 1, 3, 8

# Student-t with four degrees of freedom: Gamma(5/2) / (Gamma(2) sqrt(4 pi)) = 3/8.
T4_NORMALISER = 3.0 / 8.0


def age_semantics(lower, upper, domain=AGE_DOMAIN_MA) -> Column:
    """Class of an age interval with ordered bounds."""
    lo, hi = as_column(lower), as_column(upper)
    d0, d1 = domain
    width = hi - lo
    return (
        F.when((width == 0) & lo.between(d0, d1), "point_inside")
        .when(width == 0, "point_outside")
        .when((lo <= d0) & (hi >= d1), "coarse_full_domain")
        .when(width >= WIDE_MYR, "wide_interval")
        .when(width <= NARROW_MYR, "narrow_interval")
        .otherwise("interval")
    )


def node_count(lower, upper) -> Column:
    """1 node for a point age, 3 up to 5 Myr, 8 beyond."""
    width = F.abs(as_column(upper) - as_column(lower))
    return (
        F.when(width <= 0, NODES_POINT).when(width <= NARROW_MYR, NODES_NARROW).otherwise(NODES_WIDE)
    )


def node_count_of_label(semantics, narrow=NODES_NARROW, wide=NODES_WIDE) -> Column:
    """Node count from the interval class instead of the width."""
    s = as_column(semantics)
    return F.when(s.startswith("point"), 1).when(s == "narrow_interval", narrow).otherwise(wide)


def _triangular_cdf(x: Column, lo: Column, hi: Column) -> Column:
    h = hi - lo
    rising = 2.0 * F.pow((x - lo) / h, 2)
    falling = 1.0 - 2.0 * F.pow((hi - x) / h, 2)
    return F.when(x <= (lo + hi) / 2.0, rising).otherwise(falling)


def _triangular_quantile(u: Column, lo: Column, hi: Column) -> Column:
    h = hi - lo
    return F.when(u <= 0.5, lo + h * F.sqrt(u / 2.0)).otherwise(
        hi - h * F.sqrt(F.greatest(1.0 - u, F.lit(0.0)) / 2.0)
    )


def clipped_mass(lower, upper, domain=AGE_DOMAIN_MA, distribution="uniform") -> Column:
    """Share of the interval's probability that falls inside the age domain."""
    a0, b0 = as_column(lower), as_column(upper)
    lo, hi = F.least(a0, b0), F.greatest(a0, b0)
    a, b = F.greatest(lo, F.lit(domain[0])), F.least(hi, F.lit(domain[1]))
    if distribution == "uniform":
        inside = (b - a) / (hi - lo)
    elif distribution == "triangular":
        inside = _triangular_cdf(b, lo, hi) - _triangular_cdf(a, lo, hi)
    else:
        raise ValueError(f"unknown age distribution {distribution!r}")
    eps = 1e-12
    point = lo.between(domain[0] - eps, domain[1] + eps).cast("double")
    return F.when(lo == hi, point).when(b <= a, 0.0).otherwise(inside)


def age_nodes(lower, upper, count, domain=AGE_DOMAIN_MA, distribution="uniform") -> Column:
    """``array<struct<age, weight>>``: equal-mass nodes of the interval inside the domain.

    Intervals outside the domain, or only touching it, give an empty array.
    Weights of a non-empty array sum to one, so a record stays one unit of
    evidence whatever its node count.
    """
    a0, b0, k = as_column(lower), as_column(upper), as_column(count)
    lo, hi = F.least(a0, b0), F.greatest(a0, b0)
    d0, d1 = F.lit(float(domain[0])), F.lit(float(domain[1]))
    a, b = F.greatest(lo, d0), F.least(hi, d1)

    def node(age: Column, weight: Column) -> Column:
        return F.struct(age.alias("age"), weight.cast("double").alias("weight"))

    if distribution == "uniform":

        def centre(x):
            return a + (x + 0.5) * (b - a) / k

    elif distribution == "triangular":
        ua, ub = _triangular_cdf(a, lo, hi), _triangular_cdf(b, lo, hi)

        def centre(x):
            left = _triangular_quantile(ua + (ub - ua) * x / k, lo, hi)
            right = _triangular_quantile(ua + (ub - ua) * (x + 1) / k, lo, hi)
            return (left + right) / 2.0

    else:
        raise ValueError(f"unknown age distribution {distribution!r}")
    spread = F.transform(
        F.sequence(F.lit(0), k.cast("int") - 1), lambda x: node(centre(x), 1.0 / k)
    )
    empty = F.slice(F.array(node(lo, F.lit(1.0))), 1, 0)
    inside = lo.between(domain[0] - 1e-12, domain[1] + 1e-12)
    return (
        F.when((lo == hi) & inside, F.array(node(lo, F.lit(1.0))))
        .when(b <= a, empty)
        .otherwise(spread)
    )


def t4_log_density(y, mu, scale) -> Column:
    z = (as_column(y) - as_column(mu)) / as_column(scale)
    return math.log(T4_NORMALISER) - F.log(as_column(scale)) - 2.5 * F.log1p(z * z / 4.0)


def t4_density(y, mu, scale) -> Column:
    z = (as_column(y) - as_column(mu)) / as_column(scale)
    return T4_NORMALISER / as_column(scale) * F.pow(1.0 + z * z / 4.0, -2.5)


def t4_quantile(p) -> Column:
    """Closed-form inverse of the Student-t(4) distribution function."""
    p = as_column(p)
    a = 4.0 * p * (1.0 - p)
    q = F.cos(F.acos(clip(F.sqrt(a), 0.0, 1.0)) / 3.0) / F.sqrt(a)
    return F.signum(p - 0.5) * 2.0 * F.sqrt(F.greatest(q - 1.0, F.lit(0.0)))


def combined_scale(record_sigma, source_sigma) -> Column:
    """Error scales added in quadrature."""
    return F.hypot(as_column(record_sigma), as_column(source_sigma))


def hash_uniform(*parts) -> Column:
    """Reproducible uniform in [0, 1) from the text of its arguments (md5, 32 bits)."""
    text = F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def side_by_side_hashes(tails):
    """The 32 bits behind ``hash_uniform``, for many texts at once; for use inside Python tasks.

    Gives ``hashes(head, middles)``: one row per middle (a matrix of bytes, so all are equally long),
    one column per tail, each the first eight hex digits of the MD5 of the joined text. What the tails
    don't reach yet is worked out once per middle; steps that the first digits don't need are left
    out. Nested and without globals, so that executors need no copy of this library.
    """
    plans = {}

    def plan(before):
        """What texts have in common whose tails begin after so many bytes."""
        import math

        import numpy as np

        number = lambda v: np.array(v % 2**32, dtype=np.uint32)  # noqa: E731  quicker than a scalar
        last = np.zeros((len(tails), 64), dtype=np.uint8)
        for row, t in zip(last, tails):
            end = before + len(t)
            row[before : end + 1] = [*t, 0x80]
            row[56:64] = np.frombuffer((8 * end).to_bytes(8, "little"), dtype=np.uint8)
        last = last.view("<u4")
        low = before // 4  # the first word with bytes of a tail
        high = max(i for i in range(14) if i <= low or last[:, i].any())
        bits = last[:, 14] if (last[:, 14] != last[0, 14]).any() else last[:1, 14]
        steps = []
        for i in range(61):
            k = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]
            sine = number(int(abs(math.sin(i + 1)) * 2**32))
            steps.append((k, number(turn), number(32 - turn), bits + sine if k == 14 else sine))
        return low, high, last, steps

    def hashes(head, middles):
        import hashlib

        import numpy as np

        n, length = middles.shape
        out = np.empty((n, len(tails)), dtype=np.uint32)
        before = len(head) + length
        if before + max(map(len, tails)) > 55:  # more than one block of MD5
            for row, middle in zip(out, middles):
                text = head + middle.tobytes()
                row[:] = np.frombuffer(b"".join(hashlib.md5(text + t).digest()[:4] for t in tails), dtype=">u4")
            return out

        if before not in plans:
            plans[before] = plan(before)
        low, high, last, steps = plans[before]
        first = np.zeros((n, 64), dtype=np.uint8)
        first[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
        first[:, len(head) : before] = middles
        first = first.view("<u4")
        start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
        add, both, either = np.add, np.bitwise_and, np.bitwise_or
        differ, flip, up, down = np.bitwise_xor, np.invert, np.left_shift, np.right_shift

        def mix(i, a, b, c, d, f, g, term, more=None):
            """Step ``i``: what becomes of ``a``, in place. ``g`` keeps b ^ c from an even step of round 3 on."""
            if i < 16:
                differ(c, d, f)
                both(f, b, f)
                differ(f, d, f)
            elif i < 32:
                differ(b, c, f)
                both(f, d, f)
                differ(f, c, f)
            elif i < 48 and i % 2:
                differ(g, b, f)
            elif i < 48:
                differ(b, c, g)
                differ(g, d, f)
            else:
                flip(d, f)
                either(f, b, f)
                differ(f, c, f)
            add(a, f, a)
            add(a, term, a)
            if more is not None:
                add(a, more, a)
            _, left, right, _ = steps[i]
            down(a, right, f)
            up(a, left, a)
            either(a, f, a)
            add(a, b, a)

        size = max(1, 32768 // len(tails))
        blocks = -(-n // size)
        for block in range(blocks):
            rows = slice(block * n // blocks, (block + 1) * n // blocks)
            own = first[rows]
            shape = (len(own), len(tails))
            state = [np.full((len(own), 1), v, dtype=np.uint32) for v in start]
            f, g = np.empty((len(own), 1), dtype=np.uint32), None
            for i in range(low):
                mix(i, *state, f, g, own[:, i, None] + steps[i][3])
                state = [state[3], *state[:3]]
            state = [np.repeat(v, len(tails), axis=1) for v in state]
            f, g = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
            joint = {i: own[:, i, None] | last[None, :, i] for i in range(low, high + 1)}
            for i in range(low, 61):
                k, _, _, term = steps[i]
                mix(i, *state, f, g, own[:, k, None] + term if k < low else term, joint.get(k))
                state = [state[3], *state[:3]]
            add(state[1], np.array(start[0], dtype=np.uint32), f)
            f.byteswap(inplace=True)
            out[rows] = f
        return out

    return hashes

"""Student-t tail probability and critical value as native expressions.

The two-sided p-value is the regularised incomplete beta function
``I_x(df/2, 1/2)`` at ``x = df / (df + t*t)``.  It is evaluated as a continued
fraction, bottom-up: with a fixed depth that needs one running number and no
guard against vanishing denominators.  The depth grows with ``sqrt(df)``.
These run per row of a *result* table, never per row of the data.

The expressions are written as SQL text: their lambdas nest, and one parsed
text costs the driver far less than a tree of Column calls.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
LOG_GAMMA_HALF = 0.5 * math.log(math.pi)

BASE_DEPTH = 30
DEPTH_PER_ROOT_DF = 2.0
NEWTON_STEPS = 12


def _number(value: float) -> str:
    return f"({value!r}D)"


def _let(value: str, name: str, body: str) -> str:
    """Name an intermediate value so that it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def log_gamma_sql(z: str) -> str:
    """Lanczos approximation, for arguments of at least one half."""
    series = " + ".join(
        [_number(LANCZOS[0])] + [f"{_number(c)} / (z - 1 + {i})" for i, c in enumerate(LANCZOS[1:], start=1)]
    )
    shift = _number(LANCZOS_G + 0.5)
    body = (f"{_number(0.5 * math.log(2 * math.pi))} + (z - 0.5D) * ln(z - 1 + {shift}) "
            f"- (z - 1 + {shift}) + ln({series})")
    return _let(z, "z", body)


#: From here on the series of the log beta function is exact to double precision.
SERIES_FROM = 200
#: Degrees of freedom that stand for any larger number of them.
MANY = 1e5


def _setup(df: str, extra: str = "") -> str:
    """Degrees of freedom, log of the beta function and fraction depth."""
    half = f"cast({df} as double) / 2"
    exact = f"{log_gamma_sql(half)} - {log_gamma_sql(half + ' + 0.5D')}"
    # of two large logarithms only the difference is wanted, which has a series of its own
    series = _let(half, "h", "-ln(h) / 2 + 1 / (8 * h) - 1 / (192 * pow(h, 3)) + 1 / (640 * pow(h, 5))")
    log_beta = f"{_number(LOG_GAMMA_HALF)} + if({half} > {SERIES_FROM}, {series}, {exact})"
    depth = f"cast({BASE_DEPTH} + ceil({DEPTH_PER_ROOT_DF} * sqrt({df})) as int)"
    return f"named_struct('df', cast({df} as double), 'lb', {log_beta}, 'depth', {depth}{extra})"


def _tail(t: str, s: str) -> str:
    """Two-sided tail at t, given the name of a set-up struct.

    The fraction converges fast on one side of a point; beyond it the
    complementary function is evaluated with the arguments swapped.
    """
    square = f"{t} * {t}"
    whole = (f"named_struct('x', {s}.df / ({s}.df + {square}), 'y', {square} / ({s}.df + {square}), "
             f"'a', {s}.df / 2)")
    swap = "o.x >= (o.a + 1) / (o.a + 2.5D)"
    oriented = (
        f"named_struct('swap', {swap}, 'a', if({swap}, 0.5D, o.a), 'b', if({swap}, o.a, 0.5D), "
        f"'x', if({swap}, o.y, o.x), 'y', if({swap}, o.x, o.y))"
    )
    even = "m * (v.b - m) * v.x / ((v.a + 2 * m - 1) * (v.a + 2 * m))"
    odd = "(v.a + m) * (v.a + v.b + m) * v.x / ((v.a + 2 * m) * (v.a + 2 * m + 1))"
    levels = f"aggregate(sequence({s}.depth, 1, -1), 1D, (below, m) -> 1 + {even} / (1 - {odd} / below))"
    fraction = f"(1 - (v.a + v.b) * v.x / (v.a + 1) / {levels})"
    part = f"exp(v.a * ln(v.x) + v.b * ln(v.y) - {s}.lb) / v.a / {fraction}"
    value = _let(part, "p", "if(v.swap, 1 - p, p)")
    return _let(_let(whole, "o", oriented), "v", value)


def _to_normal(t: str, df: str) -> str:
    """The normal quantile with the same tail as t, for many degrees of freedom."""
    return f"{t} * (1 - ({t} * {t} + 1) / (4 * {df}) + (13 * pow({t}, 4) + 8 * {t} * {t} + 3) / (96 * {df} * {df}))"


def _from_normal(z: str, df: str) -> str:
    return f"{z} * (1 + ({z} * {z} + 1) / (4 * {df}) + (5 * pow({z}, 4) + 16 * {z} * {z} + 3) / (96 * {df} * {df}))"


def two_sided_p(t: str, df: str) -> Column:
    """P(|T| >= |t|) from SQL terms; NULL for a missing t or a df below one.

    Beyond ``MANY`` degrees of freedom the point is moved to where ``MANY``
    of them give the same tail, which bounds the work.
    """
    many = f"{_number(MANY)}"
    moved = _let(_to_normal(f"cast({t} as double)", f"cast({df} as double)"), "z", _from_normal("z", many))
    state = _setup(f"least(cast({df} as double), {many})", f", 't', if({df} > {many}, {moved}, cast({t} as double))")
    return F.expr(
        f"CASE WHEN {df} >= 1 THEN CASE WHEN {t} = 0 THEN 1D "
        f"WHEN {t} IS NOT NULL THEN {_let(state, 's', _tail('s.t', 's'))} END END"
    )


def critical_value(df: str, confidence: float = 0.95) -> Column:
    """t with two-sided tail ``1 - confidence``.

    Newton steps on the logarithm of the tail, from the normal quantile.  A
    power-law tail (few degrees of freedom) is convex in it and approached
    from below; a near-normal one is concave and approached from above after
    the first step.  Either way few steps do.
    """
    alpha, many = 1 - confidence, _number(MANY)
    start = NormalDist().inv_cdf(1 - alpha / 2)
    density = "exp(-s.lb - (s.df + 1) / 2 * ln(1 + t * t / s.df)) / sqrt(s.df)"
    move = f"t + (ln(p) - {_number(math.log(alpha))}) * p / (2 * {density})"
    step = _let(_tail("t", "s"), "p", move)
    root = f"aggregate(sequence(1, {NEWTON_STEPS}), {_number(start)}, (t, i) -> {step})"
    found = _let(_setup(f"least(cast({df} as double), {many})"), "s", root)
    moved = _let(found, "r", _let(_to_normal("r", many), "z", f"if({df} > {many}, {_from_normal('z', f'cast({df} as double)')}, r)"))
    return F.expr(f"CASE WHEN {df} >= 1 THEN {moved} END")

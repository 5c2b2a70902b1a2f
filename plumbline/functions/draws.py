"""Binomial draws from a counter: SQL text that gives the same numbers in Spark and in any other engine with lambdas, and the same draws for arrays.

A draw is a function of its key alone, so it can be made anywhere and again.
Small means are drawn by inversion, others by transformed rejection (Hoermann,
1993, algorithm BTRS); both are exact but for the 52 bits of a uniform number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Dialect(NamedTuple):
    """How an engine writes numbers from hexadecimal digits, lambdas, folds and structs."""

    hex_number: str
    lambda_1: str
    lambda_2: str
    transform: str
    fold: str
    steps: str
    struct_field: str
    struct: str
    first: str
    array: str


SPARK = Dialect("CAST(conv({}, 16, 10) AS BIGINT)", "{0} -> {1}", "({0}, {1}) -> {2}", "transform({}, {})", "aggregate({list}, {start}, {step})", "sequence({}, {})",
                "'{}', {}", "named_struct({})", "element_at({}, 1)", "array({})")
DUCKDB = Dialect("CAST('0x' || {} AS BIGINT)", "lambda {0}: {1}", "lambda {0}, {1}: {2}", "list_transform({}, {})", "", "range({}, {} + 1)", "{}: {}", "{{{}}}", "({})[1]", "[{}]")
#: Mean below which a draw is made by inversion; steps of it (most draws end after a few, more than all are needed with probability under 1e-15); attempts at rejection (each fails in about one of eight cases).
SMALL_MEAN, FEW_STEPS, STEPS, ATTEMPTS = 10, 4, 48, 24
#: What Stirling's formula leaves of the logarithm of k! for k of 0 to 9.
STIRLING = [math.lgamma(k + 1) - 0.5 * math.log(2 * math.pi) - (k + 0.5) * math.log(k + 1) + k + 1 for k in range(10)]


def uniform(key: str, first: int, d: Dialect) -> str:
    """A number in (0, 1) from 13 hexadecimal digits of the md5 of a text expression."""
    return f"((CAST({d.hex_number.format(f'substr(md5({key}), {first}, 13)')} AS DOUBLE) + 0.5E0) / 4503599627370496E0)"


def _struct(d: Dialect, **fields: str) -> str:
    return d.struct.format(", ".join(d.struct_field.format(k, v) for k, v in fields.items()))


def _let(d: Dialect, name: str, value: str, use: str) -> str:
    """``use`` of a value under a name, computed once."""
    return d.first.format(d.transform.format(d.array.format(value), d.lambda_1.format(name, use)))


def _fold(d: Dialect, lo: int, hi: int, start: str, step: str, element: str, number: str) -> str:
    """``step`` of a (so far) and {i} (lo to hi). For engines that fold lists of one type, ``element`` is a value of the type of ``start`` that holds i, and ``number`` gets i from such an x."""
    if d.fold:
        return d.fold.format(list=d.steps.format(lo, hi), start=start, step=d.lambda_2.format("a", "i", step.replace("{i}", "i")))
    items = f"list_prepend({start}, {d.transform.format(d.steps.format(lo, hi), d.lambda_1.format('i', element))})"
    return f"list_reduce({items}, {d.lambda_2.format('a', 'x', step.replace('{i}', number))})"


def _inversion(t: str, p: str, key: str, d: Dialect) -> str:
    first = f"exp({t} * ln(1E0 - {p}))"
    more = f"a.f * (s.t - {{i}} + 1) / {{i}} * (s.p / (1E0 - s.p))"
    step = f"CASE WHEN s.u < a.c THEN a ELSE {_struct(d, f=more, c=f'a.c + {more}', k='CAST({i} AS BIGINT)')} END"
    element = _struct(d, f="s.f", c="s.f", k="CAST(i AS BIGINT)")
    few = _fold(d, 1, FEW_STEPS, _struct(d, f="s.f", c="s.f", k="CAST(0 AS BIGINT)"), step, element, "x.k")
    rest = _fold(d, FEW_STEPS + 1, STEPS, "b", step, element, "x.k")
    found = _let(d, "b", few, f"CASE WHEN s.u < b.c THEN b.k ELSE ({rest}).k END")
    return _let(d, "s", _struct(d, t=t, p=p, u=uniform(f"{key} || '|0'", 1, d), f=first), f"CASE WHEN s.u < s.f THEN CAST(0 AS BIGINT) ELSE least({found}, s.t) END")


def _stirling(k: str, d: Dialect) -> str:
    table = "CASE " + " ".join(f"WHEN {k} = {i} THEN {v!r}E0" for i, v in enumerate(STIRLING))
    square = f"(({k} + 1E0) * ({k} + 1E0))"
    return f"{table} ELSE (1E0 / 12E0 - (1E0 / 360E0 - 1E0 / 1260E0 / {square}) / {square}) / ({k} + 1E0) END".replace("e-05E0", "E-5").replace("E0E0", "E0")


def _rejection(t: str, p: str, key: str, d: Dialect) -> str:
    """Constants of the published algorithm are fixed values."""
    us, k = "(0.5E0 - abs(w.u))", "w.k"
    odds = "(s.p / (1E0 - s.p))"
    bound = (f"(s.m + 0.5E0) * ln((s.m + 1E0) / ({odds} * (s.t - s.m + 1E0))) + (s.t + 1E0) * ln((s.t - s.m + 1E0) / (s.t - {k} + 1E0))"
             f" + ({k} + 0.5E0) * ln({odds} * (s.t - {k} + 1E0) / ({k} + 1E0)) + {_stirling('s.m', d)} + {_stirling('(s.t - s.m)', d)} - {_stirling(k, d)} - {_stirling(f'(s.t - {k})', d)}")
    scaled = f"ln(w.v * (2.83E0 + 5.1E0 / s.b) * s.sd / (s.a / ({us} * {us}) + s.b))"
    taken = f"CASE WHEN {us} >= 0.07E0 AND w.v <= 0.92E0 - 4.2E0 / s.b THEN {k} WHEN {k} < 0 OR {k} > s.t THEN CAST(-1 AS BIGINT) WHEN {scaled} <= {bound} THEN {k} ELSE CAST(-1 AS BIGINT) END"
    place = "CAST(floor((2E0 * s.a / (0.5E0 - abs(z.u)) + s.b) * z.u + s.t * s.p + 0.5E0) AS BIGINT)"
    text = f"{key} || '|' || CAST({{i}} AS VARCHAR(20))"
    pair = _struct(d, u=f"{uniform(text, 1, d)} - 0.5E0", v=uniform(text, 14, d))
    attempt = _let(d, "z", pair, _let(d, "w", _struct(d, u="z.u", v="z.v", k=place), taken))
    step = f"CASE WHEN a >= 0 THEN a ELSE {attempt} END"
    folded = _fold(d, 1, ATTEMPTS, "CAST(-1 AS BIGINT)", step, "CAST(i AS BIGINT)", "x")
    sd = "sqrt(y.t * y.p * (1E0 - y.p))"
    b = f"(1.15E0 + 2.53E0 * {sd})"
    inner = _struct(d, t="y.t", p="y.p", sd=sd, b=b, a=f"(-0.0873E0 + 0.0248E0 * {b} + 0.01E0 * y.p)", m="floor((y.t + 1E0) * y.p)")
    mode = _let(d, "q", folded, "CASE WHEN q >= 0 THEN q ELSE CAST(s.m AS BIGINT) END")
    return _let(d, "y", _struct(d, t=t, p=p), _let(d, "s", inner, mode))


def binomial(t: str, p: str, key: str, d: Dialect) -> str:
    """SQL of a draw: successes among ``t`` (bigint) trials of probability ``p`` (double); ``key``: a text expression that names the draw."""
    def of(t: str, p: str) -> str:
        return f"CASE WHEN {t} * {p} < {SMALL_MEAN} THEN {_inversion(t, p, key, d)} ELSE {_rejection(t, p, key, d)} END"

    return f"CASE WHEN {t} <= 0 OR {p} <= 0E0 THEN CAST(0 AS BIGINT) WHEN {p} >= 1E0 THEN {t} WHEN {p} > 0.5E0 THEN {t} - {of(t, f'(1E0 - {p})')} ELSE {of(t, p)} END"


def uniforms(names: list[bytes], number: int, digest: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers that ``uniform`` takes from the first and the next 13 digits of the md5 of each name and '|number'."""
    tail = b"|%d" % number
    halves = np.frombuffer(b"".join([digest(name + tail).digest() for name in names]), ">u8").reshape(-1, 2).astype("u8")
    first, second = halves[:, 0] >> np.uint64(12), (halves[:, 0] & np.uint64(0xFFF)) << np.uint64(40) | halves[:, 1] >> np.uint64(24)
    return (first.astype(float) + 0.5) / 2.0 ** 52, (second.astype(float) + 0.5) / 2.0 ** 52


def _inverted(t: np.ndarray, p: float, pairs: Callable) -> np.ndarray:
    u, f = pairs(np.arange(len(t)), 0)[0], np.exp(t * math.log(1 - p))
    c, k, odds = f.copy(), np.zeros(len(t), dtype="i8"), p / (1 - p)
    on = np.flatnonzero(u >= c)
    for i in range(1, STEPS + 1):
        if not len(on):
            break
        f[on] = f[on] * (t[on] - i + 1) / i * odds
        c[on] += f[on]
        k[on] = i
        on = on[u[on] >= c[on]]
    return np.minimum(k, t)


def _stirlings(k: np.ndarray) -> np.ndarray:
    square = (k + 1) * (k + 1)
    return np.where(k < len(STIRLING), np.take(STIRLING, np.clip(k, 0, len(STIRLING) - 1).astype(int)), (1 / 12 - (1 / 360 - 1 / 1260 / square) / square) / (k + 1))


def _rejected(t: np.ndarray, p: float, pairs: Callable) -> np.ndarray:
    sd, odds = np.sqrt(t * p * (1 - p)), p / (1 - p)
    b = 1.15 + 2.53 * sd
    a, m = -0.0873 + 0.0248 * b + 0.01 * p, np.floor((t + 1) * p)
    out, on = np.full(len(t), -1, dtype="i8"), np.arange(len(t))
    for i in range(1, ATTEMPTS + 1):
        if not len(on):
            return out
        u, v = pairs(on, i)
        u = u - 0.5
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a[on] / us + b[on]) * u + t[on] * p + 0.5)
        taken = (us >= 0.07) & (v <= 0.92 - 4.2 / b[on])
        test = np.flatnonzero(~taken & (k >= 0) & (k <= t[on]))
        at, kt = on[test], k[test]
        tt, mt = t[at], m[at]
        bound = ((mt + 0.5) * np.log((mt + 1) / (odds * (tt - mt + 1))) + (tt + 1) * np.log((tt - mt + 1) / (tt - kt + 1)) + (kt + 0.5) * np.log(odds * (tt - kt + 1) / (kt + 1))
                 + _stirlings(mt) + _stirlings(tt - mt) - _stirlings(kt) - _stirlings(tt - kt))
        taken[test] = np.log(v[test] * (2.83 + 5.1 / b[at]) * sd[at] / (a[at] / (us[test] * us[test]) + b[at])) <= bound
        out[on[taken]] = k[taken].astype("i8")
        on = on[out[on] < 0]
    out[on] = m[on].astype("i8")
    return out


def binomials(t: np.ndarray, p: float, pairs: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The draws of ``binomial`` for an array of trials and one probability. ``pairs``: places in the array and a number -> ``uniforms`` of their names."""
    if p <= 0:
        return np.zeros_like(t)
    if p >= 1:
        return t.copy()
    if p > 0.5:
        return t - binomials(t, 1 - p, pairs)
    out = np.zeros_like(t)
    for at, draw in ((np.flatnonzero((t > 0) & (t * p < SMALL_MEAN)), _inverted), (np.flatnonzero(t * p >= SMALL_MEAN), _rejected)):
        if len(at):
            out[at] = draw(t[at], p, lambda places, number, at=at: pairs(at[places], number))
    return out

"""Numeric kernels as SQL text: the same expression runs inside whole-stage codegen and in any ANSI engine."""

from __future__ import annotations

import math

# W. J. Cody's rational approximations of erf and erfc on three ranges (Math. Comp. 23, 1969).
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_C = (
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
_D = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
    3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def number(x: float) -> str:
    """A DOUBLE literal that both dialects read as a double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _horner(first: float, rest: tuple[float, ...], z: str) -> str:
    out = number(first)
    for c in rest:
        out = f"({out} * {z} + {number(c)})"
    return out


def normal_sf(x: str, z: str | None = None, z2: str | None = None) -> str:
    """P(Z > x) of a standard normal, absolute error about 1e-16; NULL stays NULL.

    z and z2 may name columns that hold |x| / sqrt(2) and its square; else they are written out, some hundred times.
    """
    x = f"CAST({x} AS DOUBLE)" if z is None else x
    z = z or f"(abs({x}) / {number(math.sqrt(2))})"
    z2 = z2 or f"({z} * {z})"
    low = f"(1 - {z} * {_horner(_A[4], _A[:4], z2)} / {_horner(1.0, _B, z2)})"
    mid = f"(exp(-{z2}) * {_horner(_C[8], _C[:8], z)} / {_horner(1.0, _D, z)})"
    inv = f"(1 / {z2})"
    far = f"(exp(-{z2}) * ({number(1 / math.sqrt(math.pi))} - {inv} * {_horner(_P[5], _P[:5], inv)} / {_horner(1.0, _Q, inv)}) / {z})"
    # The last range divides by z: its branch is only reached for z above 4.
    tail = f"(CASE WHEN {z} <= 0.46875 THEN {low} WHEN {z} <= 4 THEN {mid} ELSE {far} END) / 2"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def log_factorial(n: str) -> str:
    """ln(n!) for whole n >= 0: Stirling's series at n + 8, eight factors taken off again; error about 1e-13."""
    n = f"CAST({n} AS DOUBLE)"
    m = f"({n} + 8)"
    series = f"(({m} + 0.5) * ln({m}) - {m} + {number(0.5 * math.log(2 * math.pi))} + 1 / (12 * {m}) - 1 / (360 * {m} * {m} * {m}) + 1 / (1260 * {m} * {m} * {m} * {m} * {m}))"
    shift = " * ".join(f"({n} + {k})" for k in range(1, 9))
    return f"({series} - ln({shift}))"


def log_choose(n: str, k: str) -> str:
    return f"({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n}) - ({k})')})"


def hypergeometric_pmf(i: str, background: str, successes: str, draws: str) -> str:
    """P(X = i) of ``draws`` without replacement; i must be possible."""
    return f"exp({log_choose(successes, i)} + {log_choose(f'(({background}) - ({successes}))', f'(({draws}) - ({i}))')} - {log_choose(background, draws)})"

"""DuckDB spellings of the md5-seeded draws in :mod:`clicktrail.operators.stats`."""

from __future__ import annotations

import math

from clicktrail.operators.stats import GAMMA_ATTEMPTS, poisson1_cdf


def dlit(x: float) -> str:
    """Exact double literal."""
    return format(x, ".17e")


def uniform(seed: str, slot: int = 0) -> str:
    return hex_uniform(f"md5({seed})", slot)


def hex_uniform(digest: str, slot: int) -> str:
    return (
        f"((cast(cast('0x' || substr({digest}, {8 * slot + 1}, 8) AS BIGINT) AS DOUBLE) + 0.5e0) / 4294967296.0e0)"
    )


def gamma_ctes(src: str, name: str, shape: str, seed: str, attempts: int = GAMMA_ATTEMPTS) -> str:
    """CTEs ``{name}_0 .. {name}`` adding column ``{name}`` ~ Gamma(shape) to ``src`` (same draws as Spark)."""
    p = f"_{name}"
    d, c = f"{p}d", f"{p}c"
    hs = ", ".join(f"md5({seed} || ':{a}') AS {p}h{a}" for a in range(attempts))
    zs = ", ".join(
        f"sqrt(-2.0e0 * ln({hex_uniform(f'{p}h{a}', 0)})) * cos({dlit(2.0 * math.pi)} * {hex_uniform(f'{p}h{a}', 1)})"
        f" AS {p}z{a}, {hex_uniform(f'{p}h{a}', 2)} AS {p}u{a}"
        for a in range(attempts)
    )
    ts = ", ".join(f"1.0e0 + {c} * {p}z{a} AS {p}t{a}" for a in range(attempts))
    vs = ", ".join(f"{p}t{a} * {p}t{a} * {p}t{a} AS {p}v{a}" for a in range(attempts))
    vals = ", ".join(
        f"CASE WHEN {p}v{a} > 0 AND ln({p}u{a}) < 0.5e0 * {p}z{a} * {p}z{a} + {d} - {d} * {p}v{a}"
        f" + {d} * ln(CASE WHEN {p}v{a} > 0 THEN {p}v{a} END) THEN {d} * {p}v{a} END"
        for a in range(attempts)
    )
    return f"""{name}_1 AS (SELECT *, {shape} - {dlit(1.0 / 3.0)} AS {d} FROM {src}),
{name}_2 AS (SELECT *, 1.0e0 / sqrt(9.0e0 * {d}) AS {c}, {hs} FROM {name}_1),
{name}_3 AS (SELECT *, {zs} FROM {name}_2),
{name}_4 AS (SELECT *, {ts} FROM {name}_3),
{name}_5 AS (SELECT *, {vs} FROM {name}_4),
{name} AS (SELECT *, coalesce({vals}) AS {name} FROM {name}_5)"""


def beta_interval_ctes(counts: str, k: str, n: str, draws: int = 5000, seed: str = "beta") -> str:
    """CTEs ending in ``beta_q(_k, _nn, lower, upper)`` for the distinct (k, n) of ``counts``."""
    base = f"'{seed}/' || cast(_k AS VARCHAR) || '/' || cast(_nn AS VARCHAR) || '/' || cast(_d AS VARCHAR)"
    return f"""
beta_cells AS (SELECT DISTINCT cast({k} AS BIGINT) AS _k, cast({n} AS BIGINT) AS _nn FROM {counts}),
beta_rows AS (SELECT _k, _nn, _d FROM beta_cells, range(1, {draws} + 1) r(_d)),
{gamma_ctes("beta_rows", "gx", "cast(_k + 1 AS DOUBLE)", base + " || '/x'")},
{gamma_ctes("gx", "gy", "cast(_nn - _k + 1 AS DOUBLE)", base + " || '/y'")},
beta_q AS (
  SELECT _k, _nn, q[1] AS lower, q[2] AS upper FROM (
    SELECT _k, _nn, quantile_cont(gx / (gx + gy), [0.025, 0.975]) AS q FROM gy GROUP BY _k, _nn))
"""


def poisson1(u: str) -> str:
    cdf = poisson1_cdf()
    arms = " ".join(f"WHEN {u} <= {dlit(t)} THEN {i}" for i, t in enumerate(cdf))
    return f"CASE {arms} ELSE {len(cdf)} END"

"""Plans of parameter sweeps: one factor at a time, trade-offs, ablations, budgets and depths."""

from __future__ import annotations

from dataclasses import replace

from tessera.operators.packing import PackPlan

# The grids.
GRIDS = {"beta": (0.3, 0.6, 1.2, 1.8, 2.4), "title_bonus": (0.0, 0.15, 0.3, 0.45, 0.6), "delta": (0.0, 0.075, 0.15, 0.225, 0.3), "gamma": (0.0, 0.15, 0.3, 0.6, 0.9)}
TRADES = (0.3, 0.5, 0.7, 0.9)
ABLATIONS = ("full", "no_query_coverage", "no_title_gain", "no_redundancy", "no_token_penalty")
BUDGETS, DEPTHS = (64, 96, 128, 160, 192), (3, 5, 10)


def one_factor(base: PackPlan) -> list[PackPlan]:
    """Twenty plans: each grid value of each factor, the others at base."""
    return [replace(base, config_id=f"ofat-{name}-{v:g}", **{name: v}) for name, grid in GRIDS.items() for v in grid]


def sweep(base: PackPlan | None = None) -> list[PackPlan]:
    """Twenty-nine plans: one factor at a time, trade-offs, ablations."""
    base = base or PackPlan("base")
    trades = [replace(base, config_id=f"mmr-{v:g}", method="mmr", trade=v) for v in TRADES]
    ablations = [replace(base.variant(v), config_id=f"ablation-{v}") for v in ABLATIONS]
    return [*one_factor(base), *trades, *ablations]


def budgets(base: PackPlan | None = None, methods: tuple[str, ...] = ("cover", "relevance")) -> list[PackPlan]:
    """A plan for each method and budget."""
    base = base or PackPlan("base")
    return [replace(base, config_id=f"{m}-b{b}", method=m, budget=b) for m in methods for b in BUDGETS]

"""Weighted, explainable scores: configuration compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Fixed values of the default scoring policy; the four weights make 100."""

    compatibility: float = 35
    time: float = 25
    balance: float = 25
    simplicity: float = 15
    unknown_credit: float = 0.35
    optional_share: float = 0.05
    unknown_main: float = 0.7
    active_share: float = 0.65
    unknown_total: float = 0.75
    both_unknown: float = 0.75
    advance: float = 0.7
    active_bands: tuple = ((15, 1), (30, 0.8), (45, 0.6), (120, 0.4))
    total_bands: tuple = ((30, 1), (45, 0.9), (60, 0.75), (120, 0.5), (100000, 0.3))
    effort: tuple = (("Easy", 0.8), ("Moderate", 0.65), ("Involved", 0.45))
    protein: float = 0.45
    vegetable: float = 0.35
    staple: float = 0.15
    both: float = 0.05
    processed: tuple = (0.25, 0.7)
    rich: tuple = (0.35, 0.75)
    fat: float = 0.85
    caps: tuple = (39, 59)
    minimum: float = 60

    def __post_init__(self):
        if self.compatibility + self.time + self.balance + self.simplicity != 100:
            raise ValueError("weights must make 100")


def falling(value: Column, good: float, bad: float) -> Column:
    """1 up to good, 0 from bad on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(bad)) - value) / F.lit(float(max(1, bad - good)))))


def banded(value: Column, bands) -> Column:
    """The credit of the first band whose limit the value doesn't exceed; the last one's beyond; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for limit, credit in bands[:-1]:
        out = out.when(value <= limit, float(credit))
    return out.otherwise(float(bands[-1][1]))


def compatibility_score(required: Column, optional: Column, has_optional: Column, unknown_main: Column, w: Weights) -> Column:
    """required, optional: mean credits of the items (null: none)."""
    share = F.when(has_optional, w.optional_share).otherwise(0.0)
    base = (1 - share) * F.coalesce(required, F.lit(0.0)) + share * F.coalesce(optional, F.lit(0.0))
    return w.compatibility * base * F.when(unknown_main, w.unknown_main).otherwise(1.0)


def time_score(active: Column, total: Column, effort: Column, advance: Column, w: Weights) -> Column:
    estimate = F.lit(float(w.effort[-1][1]))
    for label, credit in w.effort[:-1]:
        estimate = F.when(effort == label, float(credit)).otherwise(estimate)
    quick = active.isNull() & F.coalesce(total <= 15, F.lit(False)) & (effort == "Easy")
    first = F.when(quick, 1.0).otherwise(F.coalesce(banded(active, w.active_bands), estimate))
    mixed = w.active_share * first + (1 - w.active_share) * F.coalesce(banded(total, w.total_bands), F.lit(w.unknown_total))
    mixed = F.when(active.isNull() & total.isNull(), F.least(F.lit(w.both_unknown), estimate)).otherwise(mixed)
    return w.time * mixed * F.when(advance, w.advance).otherwise(1.0)


def balance_score(protein: Column, vegetable: Column, staple: Column, processed: Column, rich: Column, fatty: Column, w: Weights) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    base = w.protein * one(protein) + w.vegetable * one(vegetable) + w.staple * one(staple) + w.both * one(protein & vegetable)
    cut = F.when(processed >= w.processed[0], w.processed[1]).otherwise(1.0) * F.when(rich >= w.rich[0], w.rich[1]).otherwise(1.0) * F.when(fatty, w.fat).otherwise(1.0)
    return w.balance * base * cut


def simplicity_score(items: Column, steps: Column, vessels: Column, one_vessel: Column, servings: Column, w: Weights) -> Column:
    cleanup = F.when(one_vessel, 1.0).otherwise(F.greatest(F.lit(0.3), F.lit(0.9) - 0.15 * vessels))
    batch = F.when(servings >= 4, 1.0).otherwise(0.5)
    return w.simplicity * (0.4 * falling(items, 8, 22) + 0.35 * falling(steps, 6, 18) + 0.2 * cleanup + 0.05 * batch)


def capped(total: Column, eligible: Column, structural: Column, w: Weights) -> Column:
    """The rounded score; what isn't eligible is held to a cap, the lower one for structural issues."""
    return F.round(F.when(eligible, total).otherwise(F.least(total, F.when(structural, float(w.caps[0])).otherwise(float(w.caps[1])))), 3)


def band(score: Column) -> Column:
    return F.when(score >= 90, "90+").when(score >= 80, "80s").when(score >= 70, "70s").when(score >= 60, "60s").otherwise("<60")


def status(score: Column, eligible: Column, structural: Column, w: Weights) -> Column:
    return F.when(eligible & (score >= w.minimum), "approved").when(structural, "rejected").otherwise("needs-review")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(text)) for c, text in pairs)), lambda x: x.isNotNull())

"""Scoring weight profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..functions.tolerant_json import json_dict


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Every component between 0 and 1, the sum 1 within a thousandth."""
    missing = [c for c in lx.COMPONENTS if c not in weights]
    if missing or any(not 0 <= weights[c] <= 1 for c in lx.COMPONENTS):
        raise ValueError(f"weights need every component between 0 and 1, missing {missing}")
    total = sum(weights[c] for c in lx.COMPONENTS)
    if abs(total - 1.0) > lx.WEIGHT_TOLERANCE:
        raise ValueError(f"weights must sum to 1.0, got {total:.4f}")
    return {c: float(weights[c]) for c in lx.COMPONENTS}


def effective_weights(profiles: DataFrame) -> DataFrame:
    """Stored profiles (``name, payload, is_default``) as weight columns.

    Gaps take the default weight; a profile that then does not sum to 1 is
    renormalised, one that sums to nothing falls back to the defaults.
    """
    raw = {
        c: F.coalesce(
            F.try_element_at(F.col("_p"), F.lit(c)).try_cast("double"),
            F.lit(lx.DEFAULT_WEIGHTS[c]),
        )
        for c in lx.COMPONENTS
    }
    staged = profiles.withColumn("_p", json_dict("payload")).select(
        "name", "is_default", *[raw[c].alias(c) for c in lx.COMPONENTS]
    )
    total = F.lit(0.0)
    for c in lx.COMPONENTS:
        total = total + F.col(c)
    staged = staged.withColumn("_total", total)
    return staged.select(
        "name",
        "is_default",
        *[
            F.when(F.col("_total") <= 0, F.lit(lx.DEFAULT_WEIGHTS[c]))
            .when(F.abs(F.col("_total") - 1.0) > lx.WEIGHT_TOLERANCE, F.col(c) / F.col("_total"))
            .otherwise(F.col(c))
            .alias(c)
            for c in lx.COMPONENTS
        ],
    )


def resolve_weights(
    profiles: DataFrame | None = None, explicit: Mapping[str, float] | None = None,
    name: str | None = None,
) -> dict[str, float]:
    """Explicit weights, else the named profile, else the stored default, else the built-in ones."""
    if explicit is not None:
        return check_weights(explicit)
    if profiles is None:
        return dict(lx.DEFAULT_WEIGHTS)
    wanted = profiles.where(F.col("name") == name) if name else profiles.where("is_default")
    row = effective_weights(wanted).orderBy("name").limit(1).collect()
    if not row:
        if name:
            raise ValueError(f"unknown weight profile {name!r}")
        return dict(lx.DEFAULT_WEIGHTS)
    return {c: row[0][c] for c in lx.COMPONENTS}


def single_default(profiles: DataFrame, name: str) -> DataFrame:
    """Exactly one default profile."""
    return profiles.withColumn("is_default", F.col("name") == name)

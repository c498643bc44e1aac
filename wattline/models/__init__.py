"""Forecasters and their registry."""

from __future__ import annotations

from .base import Fitted, Forecaster
from .baseline import ProfileMean, SeasonalNaive
from .boosted import BoostedTrees
from .leafwise import LeafwiseTrees
from .linear import Ridge

MODEL_REGISTRY = {m.kind: m for m in (SeasonalNaive, ProfileMean, Ridge, LeafwiseTrees, BoostedTrees)}


def build_model(name: str = "lightgbm", **params) -> Forecaster:
    """A forecaster by its registry name."""
    if name not in MODEL_REGISTRY:
        raise KeyError(f"No forecaster is registered as {name!r}; there are {', '.join(sorted(MODEL_REGISTRY))}")
    return MODEL_REGISTRY[name](**params)


__all__ = [
    "MODEL_REGISTRY",
    "BoostedTrees",
    "Fitted",
    "Forecaster",
    "LeafwiseTrees",
    "ProfileMean",
    "Ridge",
    "SeasonalNaive",
    "build_model",
]

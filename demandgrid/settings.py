"""Run settings: which columns play which role and which features to derive."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Roll:
    """Statistics of ``col`` over the previous ``windows`` rows of its series."""

    col: str
    windows: tuple[int, ...]
    aggs: tuple[str, ...] = ("mean",)


@dataclass(frozen=True)
class FeatureSettings:
    date_col: str = "date"
    store_col: str = "store_nbr"
    family_col: str = "family"
    promo_col: str = "onpromotion"
    target: str = "sales"
    date_features: tuple[str, ...] = ()
    lags: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    rolls: tuple[Roll, ...] = ()
    fourier: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    drop_cols: tuple[str, ...] = ()
    trim_pre_activation: bool = False

    @property
    def keys(self) -> list[str]:
        return [self.store_col, self.family_col]

    def lag_names(self) -> list[str]:
        return [f"{c}_lag_{k}" for c, ks in self.lags.items() for k in ks]

    def roll_names(self) -> list[str]:
        return [f"{r.col}_roll_{w}_{a}" for r in self.rolls for w in r.windows for a in r.aggs]

    def history_names(self) -> list[str]:
        """Columns computed from earlier target values."""
        return self.lag_names() + self.roll_names()

    def lookback(self) -> int:
        """Longest lag or window: how much history a forecast step can see."""
        reach = [k for ks in self.lags.values() for k in ks]
        reach += [w for r in self.rolls for w in r.windows]
        return max(reach, default=1)


def from_config(cfg: Mapping[str, Any]) -> FeatureSettings:
    """Settings from the nested mapping of a YAML run file.

    ``timeseries.min_train_date`` / ``max_train_date`` are ignored on purpose: only
    ``subsample.min_train_date`` limits the training range.
    """
    feat = cfg.get("features", {})
    prep = cfg.get("preprocessing", {})
    lags: dict[str, tuple[int, ...]] = {}
    for col, ks in feat.get("lag_features") or []:
        lags[col] = lags.get(col, ()) + tuple(ks)
    return FeatureSettings(
        date_col=feat.get("date_col", "date"),
        store_col=feat.get("store_col", "store_nbr"),
        family_col=feat.get("family_col", "family"),
        promo_col=feat.get("onpromotion_col", "onpromotion"),
        target=cfg.get("competition", {}).get("target", "sales"),
        date_features=tuple(feat.get("date_features") or ()),
        lags=lags,
        rolls=tuple(
            Roll(r["col"], tuple(r.get("windows", ())), tuple(r.get("aggs", ("mean",))))
            for r in feat.get("rolling_features") or []
        ),
        fourier={k: tuple(v) for k, v in (feat.get("fourier_features") or {}).items()},
        drop_cols=tuple(feat.get("drop_cols") or ()),
        trim_pre_activation=bool(prep.get("trim_pre_activation_zeros", False)),
    )

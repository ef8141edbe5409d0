"""Stop distances as columns of the entry row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class StopConfig:
    mode: str = "constant"
    constant_stop_loss_pct: float = 0.075
    atr_stop_k: float = 1.8
    atr_stop_min_pct: float = 0.04
    atr_stop_max_pct: float = 0.10
    swing_lookback_days: int = 10
    swing_atr_buffer_k: float = 0.75


def stop_config(mode=None, constant=None, return_threshold=None, legacy=None, **tuning) -> StopConfig:
    """Constant distance: given, else the legacy stop's size, else half the target, else 7.5%."""
    if constant is None:
        constant = abs(legacy) if legacy is not None else abs(return_threshold) / 2 if return_threshold is not None else 0.075
    return StopConfig(mode or "constant", constant, **{k: v for k, v in tuning.items() if v})


def stop_columns(config: StopConfig, columns, entry: str = "open") -> dict[str, Column]:
    """stop_loss_pct and, for the swing mode, how it was found."""
    have = {c.lower() for c in columns}
    number = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    if config.mode == "constant":
        return {"stop_loss_pct": F.lit(config.constant_stop_loss_pct)}
    lo, hi = F.lit(config.atr_stop_min_pct), F.lit(config.atr_stop_max_pct)
    clamp = lambda x: F.greatest(lo, F.least(hi, x))
    atr = number("atr14_normalized")
    by_range = F.when(atr.isNull(), lo).otherwise(clamp(config.atr_stop_k * atr))
    if config.mode == "adaptive_atr":
        return {"stop_loss_pct": by_range}
    if config.mode != "swing_atr":
        raise ValueError(f"unknown stop mode {config.mode}")
    swing = F.coalesce(number(f"swing_low_{config.swing_lookback_days}d"), number("swing_low_10d"))
    distance = F.try_divide(F.col(entry) - swing, F.col(entry))
    priced = F.coalesce(F.col(entry) > 0, F.lit(False))
    used = priced & F.coalesce((swing > 0) & (distance > 0), F.lit(False))
    buffer = F.coalesce(config.swing_atr_buffer_k * atr, F.lit(0.0))
    return {
        "stop_loss_pct": F.when(used, clamp(distance + buffer)).otherwise(by_range),
        "used_swing_low": F.when(priced, used),
        "swing_distance_pct": F.when(used, distance),
        "buffer_pct": F.when(used, buffer),
    }

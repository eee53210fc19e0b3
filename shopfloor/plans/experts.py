"""Training sets of the experts: label, split, scaling and windows of one machine type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import apply_scaler, fit_scaler
from ..operators.series import Series, ordinal
from ..operators.timeseries import lookahead_max
from ..operators.windows import sequences
from ..session import materialize


def expert_dataset(
    df: DataFrame, s: Series, dynamic: Sequence[str], static: Sequence[str], target: str, time_steps: int, lookahead: int,
    share: float = 0.8, keep: Sequence[str] = (),
) -> DataFrame:
    """Scaled windows of ``time_steps`` rows with the static values and the label of their last row.

    The label is the maximum of ``target`` over the next ``lookahead`` rows, 0 at the end of a series. The first ``share`` of
    every series trains, the rest validates; no window crosses the split, and all values are scaled by the mean and deviation
    of the training rows. A part shorter than a window has none.
    """
    cols = list(dict.fromkeys([*dynamic, *static]))
    labelled = lookahead_max(df.select(*dict.fromkeys([*s.keys, *s.order, *cols, target, *keep])), s, target, lookahead, "label")
    placed = ordinal(labelled, s, "_at", "_total").withColumn("is_train", F.col("_at") < F.floor(F.col("_total") * F.lit(share)))
    # Read twice, for the scaler and for the windows.
    split = materialize(placed.drop("_at", "_total"), "expert-split")
    scaled = apply_scaler(split, fit_scaler(split.filter("is_train"), cols), cols)
    return sequences(scaled, replace(s, keys=(*s.keys, "is_train")), dynamic, time_steps, keep=[*static, "label", *keep])

"""Model scores: any object with `predict_proba` and `classes_`, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import get

#: The features a model was trained on, in order.
FEATURES = ("size_um", "confidence", "circularity", "support_over_area", "edge_distance_px", "tile_border_dist_px", "n_neighbors_48", "local_peak_snr", "radial_inner", "radial_mid", "radial_outer")
DEFAULT_THRESHOLD = 0.35
#: Fixed value: the kind of models that is scored.
KIND = "residual"


def admit(artifact: Any) -> dict[str, Any]:
    """Checks an artifact: a map with a model of the only kind that is scored here, over these very features."""
    if not isinstance(artifact, dict) or "model" not in artifact:
        raise ValueError("an artifact is a map with a model")
    kind = str(artifact.get("kind") or KIND)
    if kind in ("cascade", "patch") or artifact.get("cnn") is not None:
        raise ValueError(f"{'patch' if kind == 'patch' else 'cascade'} models aren't supported any more")
    if kind != KIND:
        raise ValueError(f"unknown kind of model {kind!r}")
    if tuple(artifact.get("feature_names") or FEATURES) != FEATURES:
        raise ValueError("the model was trained on other features")
    return artifact | {"kind": kind}


def load(path: str) -> dict[str, Any]:
    """A pickled artifact from a file that the driver sees, checked; FileNotFoundError without it."""
    import pickle

    try:
        import joblib
    except ImportError:
        joblib = None
    with open(path, "rb") as f:
        return admit(joblib.load(f) if joblib else pickle.load(f))


def enabled(config: Mapping[str, Any]) -> bool:
    return bool(get(config, "ml.enabled", False))


def before_structure(config: Mapping[str, Any]) -> bool:
    """Whether scores come before the structure filters: yes, unless the settings say otherwise."""
    return enabled(config) and bool(get(config, "ml.score_before_structure", True))


def threshold(config: Mapping[str, Any]) -> float | None:
    found = get(config, "ml.threshold")
    return None if found is None else float(found)


def positive(model: Any, x: np.ndarray) -> np.ndarray:
    """Chance of class 1; 0 for all if the model doesn't know it."""
    classes = [int(c) for c in model.classes_]
    return np.asarray(model.predict_proba(x))[:, classes.index(1)] if 1 in classes else np.zeros(len(x))


def score(rows: DataFrame, artifact: dict[str, Any], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """`rows` with the calibrated score.  The artifact is a fixed-size model and is broadcast once."""
    shared = rows.sparkSession.sparkContext.broadcast(admit(artifact))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        a = shared.value
        for part in parts:
            p = positive(a["model"], part.to_numpy(float))
            calibrator = a.get("calibrator")
            yield pd.Series(np.asarray(calibrator.predict(p)) if calibrator is not None else p)

    udf = F.pandas_udf(run, "double")
    return rows.withColumn("score", udf(F.struct(*(F.col(f).cast("double") for f in features))))


def keep_scored(rows: DataFrame, artifact: dict[str, Any], least: float | None = None) -> DataFrame:
    """Rows that reach the least score: the caller's, else the artifact's, else the default."""
    least = float(artifact.get("threshold", DEFAULT_THRESHOLD)) if least is None else least
    return score(rows, artifact).where(F.col("score") >= least)

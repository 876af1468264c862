"""Damped Newton steps for one small model per key, over rows of any number.

A pass joins the current parameters to the rows, turns Arrow batches into partial
gradients and curvatures, and adds them up by key in the JVM. All keys step together, and a
key with very many rows is only ever seen in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.plans.scale import broadcast_if_small, cut_lineage

Terms = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def newton_by_key(
    rows: DataFrame,
    start: DataFrame,
    keys: Sequence[str],
    n_params: int,
    terms: Terms,
    *,
    prior: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None,
    max_iter: int = 40,
    tol: float = 1e-9,
    max_step: float = 4.0,
) -> DataFrame:
    """Maximise a sum of row terms for each key.

    ``terms(frame, theta)`` gives value, gradient and Hessian of every row; ``start`` holds
    the keys and ``theta``. Returns keys, ``theta``, ``ll``, the Hessian at the optimum
    (flat) and ``converged``. A step that does not raise the objective is halved; a key whose
    steps have shrunk to nothing, or that is still moving after ``max_iter`` passes, stays
    where it is and is not marked as converged.
    """
    keys = list(keys)
    p = n_params
    width = 1 + p + p * p

    def partial(frames):
        for frame in frames:
            if not len(frame):
                continue
            ll, grad, hess = terms(frame, np.stack(frame["_trial"].to_numpy()))
            parts = np.column_stack([ll, grad, hess.reshape(len(frame), -1)])
            code = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            sums = np.zeros((code.max() + 1, width))
            np.add.at(sums, code, parts)
            first = np.unique(code, return_index=True)[1]
            out = frame[keys].iloc[first].copy()
            out["_part"] = list(sums)
            yield out

    def step(frames):
        for frame in frames:
            theta = np.stack(frame["theta"].to_numpy()).astype(float)
            trial = np.stack(frame["_trial"].to_numpy()).astype(float)
            hold = np.stack(frame["hessian"].to_numpy()).astype(float)
            ll = frame["ll"].to_numpy(dtype=float)
            settled = frame["converged"].to_numpy(dtype=bool)
            done = frame["_stopped"].to_numpy(dtype=bool)
            sums = np.array(
                [s if s is not None else np.full(width, np.nan) for s in frame["_sum"]], dtype=float
            )
            value, grad = sums[:, 0].copy(), sums[:, 1 : 1 + p].copy()
            hess = sums[:, 1 + p :].reshape(-1, p, p).copy()
            if prior is not None:
                v, g, h = prior(trial)
                value, grad, hess = value + v, grad + g, hess + h
            fine = np.isfinite(value) & np.isfinite(grad).all(1) & np.isfinite(hess).all((1, 2))
            better = fine & ~(value < ll - 1e-12 * (1 + np.abs(ll))) & ~done
            # ascent direction: flip and floor the curvature in its eigenbasis
            safe = np.where(better[:, None, None], -hess, np.eye(p))
            lam, vec = np.linalg.eigh((safe + safe.transpose(0, 2, 1)) / 2)
            lam = np.maximum(np.abs(lam), 1e-8 * np.maximum(np.abs(lam).max(1), 1e-8)[:, None])
            g = np.where(better[:, None], grad, 0.0)
            move = np.einsum("bij,bj->bi", vec, np.einsum("bji,bj->bi", vec, g) / lam)
            gain = np.einsum("bi,bi->b", move, g)
            size = np.abs(move).max(1)
            move *= np.minimum(1.0, max_step / np.maximum(size, 1e-300))[:, None]
            halved = theta + 0.5 * (trial - theta)
            stuck = ~better & ~done & (np.abs(trial - theta).max(1) < 1e-10)
            now = better & (gain < tol * (1 + np.abs(value)))
            new_theta = np.where(better[:, None], trial, theta)
            out = frame[keys].copy()
            out["theta"] = list(new_theta)
            out["_trial"] = list(
                np.where(better[:, None], trial + move, np.where(done[:, None], theta, halved))
            )
            out["hessian"] = list(np.where(better[:, None], hess.reshape(-1, p * p), hold))
            out["ll"] = np.where(better, value, ll)
            out["converged"] = settled | now
            out["_stopped"] = done | now | stuck
            yield out

    key_schema = _schema(start, keys)
    state_schema = (
        f"{key_schema}, theta array<double>, _trial array<double>, hessian array<double>, "
        "ll double, converged boolean, _stopped boolean"
    )
    state = cut_lineage(
        start.select(
            *keys,
            "theta",
            F.col("theta").alias("_trial"),
            F.array_repeat(F.lit(0.0), p * p).alias("hessian"),
            F.lit(float("-inf")).alias("ll"),
            F.lit(False).alias("converged"),
            F.lit(False).alias("_stopped"),
        )
    )
    for _ in range(max_iter):
        open_keys = state.where(~F.col("_stopped")).select(*keys, "_trial")
        if open_keys.isEmpty():
            break
        joined = rows.join(broadcast_if_small(open_keys), keys)
        parts = joined.mapInPandas(partial, f"{key_schema}, _part array<double>")
        sums = parts.groupBy(*keys).agg(
            F.array(*[F.sum(F.col("_part")[i]) for i in range(width)]).alias("_sum")
        )
        state = cut_lineage(
            state.join(sums, keys, "left").mapInPandas(step, state_schema), replaces=state
        )
    return state.drop("_trial", "_stopped")

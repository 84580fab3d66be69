"""Georegistration of drawings: fits, robust selection with quality gates, and the policy for world plans."""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, MAX_RMSE, MAX_RESIDUAL, MIN_INLIERS = 1.25, 1.25, 3.5, 3
MAX_SCALE_ERROR, MAX_ANISOTROPY, MAX_SHEAR, SAMPLES = 0.22, 0.08, 0.08, 600


def similarity(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """2 x 3 matrix of the weighted least-squares rotation, scale and shift; None for coincident points."""
    total = w.sum()
    if total <= 0:
        return None
    ms, md = w @ src / total, w @ dst / total
    p, q = src - ms, dst - md
    spread = (w * (p**2).sum(axis=1)).sum()
    if spread <= 1e-12:
        return None
    a = (w * (p * q).sum(axis=1)).sum() / spread
    b = (w * (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0])).sum() / spread
    m = np.array([[a, -b], [b, a]])
    return np.c_[m, md - m @ ms] if np.hypot(a, b) >= 1e-12 else None


def affine(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """2 x 3 matrix of the weighted least-squares affine map; None for points on a line."""
    x = np.c_[src, np.ones(len(src))] * np.sqrt(w)[:, None]
    if np.linalg.matrix_rank(x) < 3:
        return None
    return np.linalg.lstsq(x, dst * np.sqrt(w)[:, None], rcond=None)[0].T


def residuals(m: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return np.hypot(*(src @ m[:, :2].T + m[:, 2] - dst).T)


def robust(src, dst, w, fit=similarity, size=2, threshold=THRESHOLD) -> tuple[np.ndarray, np.ndarray] | None:
    """(matrix, inliers): the sample of ``size`` points with the most inliers, then up to three refits with a tolerance that follows their spread."""
    best = None
    for pick in islice(combinations(range(len(src)), size), SAMPLES):
        m = fit(src[list(pick)], dst[list(pick)], w[list(pick)])
        if m is None or np.linalg.det(m[:, :2]) <= 0:
            continue
        r = residuals(m, src, dst)
        own = r <= threshold
        rank = (own.sum(), -float(np.sqrt((r[own] ** 2).mean())) if own.any() else 0.0)
        if best is None or rank > best[0]:
            best = rank, own
    if best is None or best[1].sum() < size:
        return None
    own = best[1]
    m = fit(src[own], dst[own], w[own])
    for _ in range(3):
        if m is None:
            return None
        r = residuals(m, src, dst)
        middle = np.median(r[own])
        wide = max(threshold, middle + 2.5 * 1.4826 * np.median(np.abs(r[own] - middle)))
        after = r <= wide
        if after.sum() < size or (after == own).all():
            break
        own, m = after, fit(src[after], dst[after], w[after])
    return m, own


def solve(src, dst, w, expected_scale: float | None = None, model: str = "similarity") -> dict:
    """Transform, measures, and the reasons for which it is rejected, if any."""
    src, dst, w = (np.asarray(x, float) for x in (src, dst, w))
    found = robust(src, dst, w, affine if model == "affine" else similarity, 3 if model == "affine" else 2) if len(src) >= 2 else None
    if found is None:
        return {"pass": False, "reasons": ["insufficient-control-points" if len(src) < 2 else "unsolved-transform"]}
    m, own = found
    r = residuals(m, src, dst)[own]
    sx, sy = np.hypot(m[0, 0], m[1, 0]), np.hypot(m[0, 1], m[1, 1])
    scale, det = (sx + sy) / 2, float(np.linalg.det(m[:, :2]))
    shear = abs(m[:, 0] @ m[:, 1]) / (sx * sy or 1.0)
    reasons = [
        name
        for name, bad in (
            ("inliers", own.sum() < max(3 if model == "affine" else 2, MIN_INLIERS)), ("rmse", np.sqrt((r**2).mean()) > MAX_RMSE), ("residual", r.max() > MAX_RESIDUAL),
            ("scale", expected_scale is not None and abs(scale - expected_scale) / expected_scale > MAX_SCALE_ERROR), ("anisotropy", abs(sx - sy) / scale > MAX_ANISOTROPY), ("shear", shear > MAX_SHEAR), ("reflected", det <= 0),
        )
        if bad
    ]
    return {"pass": not reasons, "reasons": reasons, "matrix": m.ravel().tolist(), "inliers": int(own.sum()), "rmse": float(np.sqrt((r**2).mean())), "max_residual": float(r.max()), "scale": float(scale), "rotation": float(np.degrees(np.arctan2(m[1, 0], m[0, 0])))}


REGISTRATION = "page string, pass boolean, reasons array<string>, matrix array<double>, inliers int, rmse double, max_residual double, scale double, rotation double"


def register_pages(controls: DataFrame, model: str = "similarity") -> DataFrame:
    """One row per page of controls (page, sx, sy, tx, ty, weight, expected_scale); a page has a few dozen points."""

    def run(key, t):
        d = t.to_pydict()
        e = next((x for x in d["expected_scale"] if x is not None), None)
        # order is part of the definition: the sampling takes the first combinations
        rows = sorted(zip(d["sx"], d["sy"], d["tx"], d["ty"], d["weight"]))
        got = solve([r[:2] for r in rows], [r[2:4] for r in rows], [1.0 if r[4] is None else r[4] for r in rows], e, model)
        names = [c.split()[0] for c in REGISTRATION.split(", ")]
        kinds = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int32(), *[pa.float64()] * 4]
        return pa.table({n: pa.array([key[0].as_py() if n == "page" else got.get(n)], k) for n, k in zip(names, kinds)})

    return controls.select("page", "sx", "sy", "tx", "ty", "weight", "expected_scale").groupBy("page").applyInArrow(run, REGISTRATION)


def apply_transform(points: DataFrame, registrations: DataFrame) -> DataFrame:
    """Points (page, x, y) in world metres (wx, wy); pages that did not pass give nothing."""
    m = registrations.where("pass").select("page", "matrix")
    x, y, k = F.col("x"), F.col("y"), F.col("matrix")
    return points.join(m, "page").withColumns({"wx": k[0] * x + k[1] * y + k[2], "wy": k[3] * x + k[4] * y + k[5]}).drop("matrix")


def page_policy(passed: Column, world_plan: Column, explicit: Column, sources: Column, targets: Column, least: int = 3) -> Column:
    """World plans need an explicit control, or ``least`` independent matches."""
    enough = (explicit > 0) | ((sources >= least) & (targets >= least))
    return F.when(~passed, "rejected").when(~world_plan | enough, "registered").otherwise("unregistered")


def shape_matches(fits: DataFrame, limit: int = 12, max_rmse: float = 1.8) -> DataFrame:
    """One-to-one matches per page, greedily by rmse, from hypotheses (page, source, target, rmse, coverage). A page has at most 120 x 400 of them by contract."""

    def run(key, t):
        rows = sorted(t.select(["rmse", "coverage", "source", "target"]).to_pylist(), key=lambda r: (r["rmse"], -r["coverage"], r["source"], r["target"]))
        used_s, used_t, out = set(), set(), []
        for r in rows:
            if r["rmse"] <= max_rmse and r["source"] not in used_s and r["target"] not in used_t and len(out) < limit:
                used_s.add(r["source"])
                used_t.add(r["target"])
                out.append(r)
        return pa.table({"page": pa.array([key[0].as_py()] * len(out), pa.string()), "source": pa.array([r["source"] for r in out], pa.string()), "target": pa.array([r["target"] for r in out], pa.string()), "rmse": pa.array([r["rmse"] for r in out], pa.float64())})

    return fits.groupBy("page").applyInArrow(run, "page string, source string, target string, rmse double")

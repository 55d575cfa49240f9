"""Distances and interpolation along surfaces (M4-M7, M9, M10), map by map.

A map is the natural unit: Spark deals maps to tasks, and numpy helpers solve one map (at most some 10^5 vertices) at a time.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite
from atriaflow.operators.spatial import nn_join
from atriaflow.shared import stored


def _neighbours(a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int):
    """Adjacency as (bounds, neighbour, length)."""
    frm, to, w = np.r_[a, b], np.r_[b, a], np.r_[length, length]
    order = np.argsort(frm, kind="stable")
    return np.searchsorted(frm[order], np.arange(n + 1)), to[order], w[order]


def _spread(bounds, to, w, sources: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and source of every vertex: least path length, ties to the lowest source."""
    dist, src = np.full(n, np.inf), np.full(n, -1)
    heap = [(0.0, int(s), int(s)) for s in sources]
    while heap:
        d, s, v = heapq.heappop(heap)
        if src[v] >= 0:
            continue
        dist[v], src[v] = d, s
        for k in range(bounds[v], bounds[v + 1]):
            if src[to[k]] < 0:
                heapq.heappush(heap, (d + w[k], s, int(to[k])))
    return dist, src


def _paths(edges: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    if edges.empty:
        return pd.DataFrame(columns=["map_id", "vertex_id", "distance", "source"])
    ids = np.unique(np.r_[edges["a"], edges["b"]])
    adj = _neighbours(np.searchsorted(ids, edges["a"]), np.searchsorted(ids, edges["b"]), edges["length"].to_numpy(), len(ids))
    own = sources["vertex_id"].to_numpy() if len(sources) else np.zeros(0, int)
    start = np.searchsorted(ids, np.intersect1d(own, ids))
    dist, src = _spread(*adj, start, len(ids))
    return pd.DataFrame({"map_id": edges["map_id"].iloc[0], "vertex_id": ids, "distance": dist, "source": np.where(src >= 0, ids[src], -1)})


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """M4: least path length along edges from the nearest source, and that source; unreachable: infinite and -1.

    edges(map_id, a, b, length), sources(map_id, vertex_id).
    """
    return edges.groupBy("map_id").cogroup(sources.groupBy("map_id")).applyInPandas(_paths, "map_id long, vertex_id int, distance double, source int")


def nearest_source(edges: DataFrame, distances: DataFrame, sources: DataFrame) -> DataFrame:
    """M6: labels spread outward: in the order of distance (then id) each vertex takes the label of that labelled neighbour which lies nearest to the
    sources; -1 if it has none. Sources are labelled from the start.

    edges(map_id, a, b), distances(map_id, vertex_id, distance), sources(map_id, vertex_id). Every vertex points to the neighbour that it takes its label from, as joins;
    vertices without any leave, and those that pointed to them choose again, until all that are left point on; then pointers jump to their sources, in as many rounds as
    the longest way has binary digits.
    """
    far = F.lit(float("inf"))
    at = F.when(F.isnan("distance"), far).otherwise(F.coalesce("distance", far))
    own = distances.groupBy("map_id", "vertex_id").agg(F.min(at).alias("d")).join(sources.select("map_id", "vertex_id", F.lit(True).alias("source")).distinct(), ["map_id", "vertex_id"], "left")
    own = stored(own.withColumn("source", F.coalesce("source", F.lit(False))), "labels")
    ways = edges.select("map_id", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("map_id", "e.*")
    v = own.filter("NOT source").select("map_id", F.col("vertex_id").alias("v"), F.col("d").alias("vd"))
    w = own.filter(F.col("d") < far).select("map_id", F.col("vertex_id").alias("w"), F.col("d").alias("wd"), F.col("source").alias("ws"))
    near = ways.join(v, ["map_id", "v"]).join(w, ["map_id", "w"])
    near = stored(near.filter(F.col("ws") | (F.struct("wd", "w") < F.struct("vd", "v"))).select("map_id", "v", "w", "wd", "ws"), "near")
    while True:
        has = near.select("map_id", F.col("v").alias("w")).distinct().withColumn("has", F.lit(True))
        kept = near.join(has, ["map_id", "w"], "left").withColumn("stays", F.col("ws") | F.col("has").isNotNull()).drop("has")
        kept = stored(kept, "near")
        if kept.filter("NOT stays").isEmpty():
            break
        near = kept.filter("stays").drop("stays")
    roots = own.filter("source").select("map_id", F.col("vertex_id").alias("v"), F.col("vertex_id").alias("to"), F.lit(True).alias("done"))
    best = F.min(F.struct("wd", "w", "ws"))
    now = stored(near.groupBy("map_id", "v").agg(best.alias("p")).select("map_id", "v", F.col("p.w").alias("to"), F.col("p.ws").alias("done")).unionByName(roots), "pointers")
    while not now.filter("NOT done").isEmpty():
        on = now.select("map_id", F.col("v").alias("to"), F.col("to").alias("next"), F.col("done").alias("then"))
        now = stored(now.join(on, ["map_id", "to"]).select("map_id", "v", F.when(F.col("done"), F.col("to")).otherwise(F.col("next")).alias("to"), (F.col("done") | F.col("then")).alias("done")), "pointers")
    labels = now.select("map_id", F.col("v").alias("vertex_id"), F.col("to").alias("label"))
    return own.select("map_id", "vertex_id").join(labels, ["map_id", "vertex_id"], "left").select("map_id", "vertex_id", F.coalesce("label", F.lit(-1)).cast("int").alias("source"))


def geodesic_delta(edges: DataFrame, a: DataFrame, b: DataFrame, max_distance: float | None = None) -> DataFrame:
    """M5: the value of b's nearest vertex along the surface, a - b, and the distance; beyond max_distance (or unreached) null.

    a(map_id, vertex_id, a_value); b(map_id, vertex_id, b_value): b's values on vertices of a's mesh (nearest vertex, J2).
    """
    paths = shortest_paths(edges, b.select("map_id", "vertex_id"))
    met = a.join(paths, ["map_id", "vertex_id"]).join(b.select("map_id", F.col("vertex_id").alias("source"), "b_value"), ["map_id", "source"], "left")
    far = F.col("distance") > (F.lit(float("inf")) if max_distance is None else F.lit(float(max_distance)))
    value = F.when(~far, F.col("b_value"))
    return met.select("map_id", "vertex_id", F.when(F.col("distance") < float("inf"), F.col("distance")).alias("distance"), value.alias("b_value"), (F.col("a_value") - value).alias("delta"))


class _Surface:
    """Cotangent Laplacian and lumped mass of one map, from vertex and triangle arrays."""

    def __init__(self, xyz: np.ndarray, tri: np.ndarray):
        self.xyz, self.tri, n = xyz, tri, len(xyz)
        p = xyz[tri]
        self.normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        self.twice = np.maximum(np.linalg.norm(self.normal, axis=1), 1e-12)
        self.mass = np.maximum(np.bincount(tri.ravel(), np.repeat(self.twice / 6, 3), n), 1e-12)
        i, j, w = [], [], []
        for at, a, b in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            cot = ((p[:, a] - p[:, at]) * (p[:, b] - p[:, at])).sum(axis=1) / self.twice / 2
            i += [tri[:, a], tri[:, b]]
            j += [tri[:, b], tri[:, a]]
            w += [cot, cot]
        self.i, self.j, self.w = np.concatenate(i), np.concatenate(j), np.concatenate(w)
        self.diagonal = np.bincount(self.i, self.w, n)

    def stiffness(self, u: np.ndarray) -> np.ndarray:
        """-L u: symmetric, positive on all but constants."""
        return self.diagonal * u - np.bincount(self.i, self.w * u[self.j], len(u))

    def solve(self, mass_weight: float, step: float, right: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
        """(mass_weight M - step L) u = right by conjugate gradients; vertices that are not free stay 0 (rows and columns out)."""
        mask = np.ones(len(right)) if free is None else free.astype(float)
        apply = lambda u: mask * (mass_weight * self.mass * u + step * self.stiffness(u))
        scale = np.maximum(mass_weight * self.mass + step * np.abs(self.diagonal), 1e-12)
        u, r = np.zeros_like(right), mask * right
        z = r / scale
        p, rz, stop = z.copy(), r @ z, 1e-20 * max(1e-30, r @ (r / scale))
        for _ in range(4 * len(right) + 50):
            if rz <= stop:
                break
            ap = apply(p)
            alpha = rz / max(p @ ap, 1e-300)
            u, r = u + alpha * p, r - alpha * ap
            z = r / scale
            rz, before = r @ z, rz
            p = z + rz / before * p
        return u


def _arrays(v: pd.DataFrame, t: pd.DataFrame) -> tuple[np.ndarray, _Surface]:
    v = v.sort_values("vertex_id")
    ids = v["vertex_id"].to_numpy()
    return ids, _Surface(v[["x", "y", "z"]].to_numpy(float), np.searchsorted(ids, t[["v0", "v1", "v2"]].to_numpy()))


def _heat(v: pd.DataFrame, t: pd.DataFrame, m: float) -> pd.DataFrame:
    cols = ["map_id", "vertex_id", "distance"]
    if v.empty or t.empty or not v["is_source"].any():
        return pd.DataFrame({"map_id": v["map_id"], "vertex_id": v["vertex_id"], "distance": np.nan}, columns=cols)
    v = v.sort_values("vertex_id")
    ids, s = _arrays(v, t)
    source = v["is_source"].to_numpy(bool)
    edge = np.linalg.norm(s.xyz[s.tri[:, 1]] - s.xyz[s.tri[:, 0]], axis=1).mean()
    u = s.solve(1.0, m * edge * edge, source.astype(float))
    p = s.xyz[s.tri]
    # gradient of u on a face: sum over corners of u times (normal x opposite edge) / (4 area^2)
    grad = sum(u[s.tri[:, k], None] * np.cross(s.normal, p[:, (k + 2) % 3] - p[:, (k + 1) % 3]) for k in range(3)) / (s.twice**2)[:, None]
    x = -grad / np.maximum(np.linalg.norm(grad, axis=1), 1e-300)[:, None]
    div = np.zeros(len(ids))
    for at, a, b in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        e1, e2 = p[:, a] - p[:, at], p[:, b] - p[:, at]
        cot_b = ((p[:, at] - p[:, b]) * (p[:, a] - p[:, b])).sum(1) / s.twice
        cot_a = ((p[:, at] - p[:, a]) * (p[:, b] - p[:, a])).sum(1) / s.twice
        div += np.bincount(s.tri[:, at], (cot_b * (e1 * x).sum(1) + cot_a * (e2 * x).sum(1)) / 2, len(ids))
    phi = s.solve(0.0, 1.0, -div, ~source)
    return pd.DataFrame({"map_id": v["map_id"].iloc[0], "vertex_id": ids, "distance": np.abs(phi - phi[source].min())}, columns=cols)


def heat_geodesic(vertices: DataFrame, triangles: DataFrame, sources: DataFrame, m: float = 1.0) -> DataFrame:
    """M7: distance along the surface by the heat method: diffuse from the sources, normalise the gradient, integrate it back."""
    marked = vertices.select("map_id", "vertex_id", "x", "y", "z").join(sources.select("map_id", "vertex_id", F.lit(True).alias("is_source")), ["map_id", "vertex_id"], "left").withColumn("is_source", F.coalesce("is_source", F.lit(False)))
    return marked.groupBy("map_id").cogroup(triangles.groupBy("map_id")).applyInPandas(lambda v, t: _heat(v, t, m), "map_id long, vertex_id int, distance double")


def _diffuse(v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    v = v.sort_values("vertex_id")
    if t.empty or not (v["density"] > 0).any():
        return pd.DataFrame({"map_id": v["map_id"], "vertex_id": v["vertex_id"], "value": np.nan})
    ids, s = _arrays(v, t)
    edge = np.linalg.norm(s.xyz[s.tri[:, 1]] - s.xyz[s.tri[:, 0]], axis=1).mean()
    step = max(v["sigma"].max() ** 2 / 2, edge * edge)
    spread = {c: s.solve(1.0, step, v[c].to_numpy(float)) for c in ("density", "total", "total_cos", "total_sin")}
    cycle, lo = v["cycle"].max(), v["lo"].min()
    with np.errstate(all="ignore"):
        if cycle > 0:
            out = lo + (np.arctan2(spread["total_sin"], spread["total_cos"]) / (2 * np.pi) % 1.0) * cycle
        else:
            out = spread["total"] / spread["density"]
    out = np.where(spread["density"] > 1e-6 * spread["density"].max(), out, np.nan)
    return pd.DataFrame({"map_id": v["map_id"].iloc[0], "vertex_id": ids, "value": out})


def heat_interpolate(vertices: DataFrame, triangles: DataFrame, field: DataFrame, sigma: float | None = None, distance_threshold: float | None = None, cycle_length: float | None = None) -> DataFrame:
    """M9: values spread along the surface: diffuse the measurements and their number, divide; where hardly any of it comes, or beyond the
    threshold along the surface, null.

    field(map_id, vertex_id, value): one row per measurement; each counts, those of one vertex too; values that are not finite do not. Without sigma it is the median distance
    between nearest measured vertices (A7). With a cycle length values are averaged on the circle, and lie from the least measurement on; 0 takes the range of
    the measurements for it, and none is left where that is 0.
    """
    rows = field.select("map_id", "vertex_id", finite(F.col("value").cast("double")).alias("value")).filter("value IS NOT NULL")
    cycle = F.lit(None).cast("double") if cycle_length is None else F.max("value") - F.min("value") if cycle_length == 0 else F.lit(float(cycle_length))
    maps = rows.groupBy("map_id").agg(F.min("value").alias("lo"), F.when(cycle > 0, cycle).otherwise(0.0).alias("cycle"))
    if sigma:
        maps = maps.withColumn("sigma", F.lit(float(sigma)))
    else:
        at = rows.join(vertices.select("map_id", "vertex_id", "x", "y", "z"), ["map_id", "vertex_id"]).groupBy("map_id", "vertex_id", "x", "y", "z").agg(F.count("*").alias("n"))
        # a vertex measured twice has another measurement at distance 0, which does not count
        near = nn_join(at.filter("n = 1"), at, ["map_id"], k=2).filter("near_id <> vertex_id AND distance > 0").groupBy("map_id", "vertex_id").agg(F.min("distance").alias("near"))
        maps = maps.join(near.groupBy("map_id").agg(F.median("near").alias("sigma")), "map_id", "left").withColumn("sigma", F.coalesce("sigma", F.lit(1.0)))
    angle = (F.col("value") - F.col("lo")) / F.when(F.col("cycle") > 0, F.col("cycle")) * (2 * math.pi)
    sums = [F.count("*").cast("double").alias("density"), F.sum("value").alias("total"), F.sum(F.coalesce(F.cos(angle), F.lit(0.0))).alias("total_cos"), F.sum(F.coalesce(F.sin(angle), F.lit(0.0))).alias("total_sin")]
    held = rows.join(maps, "map_id").groupBy("map_id", "vertex_id").agg(*sums)
    placed = vertices.select("map_id", "vertex_id", "x", "y", "z").join(held, ["map_id", "vertex_id"], "left").join(maps, "map_id", "left").fillna(0.0, ["density", "total", "total_cos", "total_sin", "cycle", "lo", "sigma"])
    out = placed.groupBy("map_id").cogroup(triangles.groupBy("map_id")).applyInPandas(_diffuse, "map_id long, vertex_id int, value double")
    out = out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if distance_threshold is not None:
        near = heat_geodesic(vertices, triangles, rows.select("map_id", "vertex_id").distinct())
        out = out.join(near, ["map_id", "vertex_id"]).withColumn("value", F.when(F.col("distance") <= distance_threshold, F.col("value"))).drop("distance")
    return out


def _plane(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("vertex_id")  # sums in one order, whatever order the rows come in
    x = g[["x", "y", "z"]].to_numpy(float)
    centre = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - centre).T, bias=True) if len(x) > 1 else np.eye(3))
    e1, e2 = axes[:, 2], axes[:, 1]
    sign = lambda e: e if e[np.argmax(np.abs(e))] > 0 else -e  # noqa: E731  an axis has no direction of its own
    e1, e2 = sign(e1), sign(e2)
    out = g[["map_id", "vertex_id", "value"]].copy()
    out["px"], out["py"], out["pz"] = (x - centre) @ e1, (x - centre) @ e2, 0.0
    for n, e in (("a", e1), ("b", e2)):
        out[[f"{n}x", f"{n}y", f"{n}z"]] = e
    return out


def conduction_directions(vertices: DataFrame, k: int = 5) -> DataFrame:
    """Unit direction of the activation gradient: neighbours in the map's main plane (itself included), least squares, back in space.

    vertices(map_id, vertex_id, x, y, z, value). A flat field gives the zero vector. The flat maps are stored, as the search reads them many times. Joins of vertices ask
    for shuffles, as in `nn_join`.
    """
    kinds = "map_id long, vertex_id int, value double, px double, py double, pz double, " + ", ".join(f"{n}{c} double" for n in "ab" for c in "xyz")
    flat = stored(vertices.select("map_id", "vertex_id", "x", "y", "z", "value").groupBy("map_id").applyInPandas(_plane, kinds), "flat")
    own = flat.select("map_id", "vertex_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    near = nn_join(own, own, ["map_id"], k=k).select("map_id", "vertex_id", "near_id")
    met = near.join(flat.select("map_id", F.col("vertex_id").alias("near_id"), "px", "py", "value").hint("merge"), ["map_id", "near_id"])
    p, q, v = (F.col(c) - F.avg(c).over(Window.partitionBy("map_id", "vertex_id")) for c in ("px", "py", "value"))
    sums = met.withColumns({"p": p, "q": q, "v": v}).groupBy("map_id", "vertex_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in (("p", "p"), ("p", "q"), ("q", "q"), ("p", "v"), ("q", "v"))])
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    gx = F.when(F.abs(det) > 1e-12, (F.col("pv") * F.col("qq") - F.col("qv") * F.col("pq")) / det).otherwise(F.lit(0.0))
    gy = F.when(F.abs(det) > 1e-12, (F.col("qv") * F.col("pp") - F.col("pv") * F.col("pq")) / det).otherwise(F.lit(0.0))
    sums = sums.withColumns({"gx": gx, "gy": gy}).withColumn("size", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    axes = flat.select("map_id", "vertex_id", *[f"{n}{c}" for n in "ab" for c in "xyz"])
    unit = lambda c: F.when(F.col("size") > 0, (F.col("gx") * F.col(f"a{c}") + F.col("gy") * F.col(f"b{c}")) / F.col("size")).otherwise(F.lit(0.0)).alias(f"d{c}")
    return sums.join(axes.hint("merge"), ["map_id", "vertex_id"]).select("map_id", "vertex_id", *[unit(c) for c in "xyz"])

"""Closed-form cases on tiny tables."""

import math

import numpy as np
import pytest

from atriaflow.functions import columns, vocab
from atriaflow.operators import geodesic, link, measure, mesh, report, spatial, spread
from atriaflow.sources import studies
from pyspark.sql import functions as F


def square(spark, n=11):
    """A unit-step n x n grid and its triangles."""
    v = [(0, i, float(i % n), float(i // n), 0.0) for i in range(n * n)]
    t = []
    for r in range(n - 1):
        for c in range(n - 1):
            a = r * n + c
            t += [(0, len(t), a, a + 1, a + n), (0, len(t) + 1, a + 1, a + n + 1, a + n)]
    vertices = spark.createDataFrame(v, "map_id long, vertex_id int, x double, y double, z double")
    return vertices, spark.createDataFrame(t, "map_id long, tri_id int, v0 int, v1 int, v2 int")


def test_interval_edges(spark):
    faces = spark.createDataFrame([(1, 0.0, 0.5), (1, 1.0, 0.5), (1, 2.0, 0.5)], "map_id long, face_value double, area double")
    iv = [("high", 1.0, 2.0), ("low", 0.0, 1.0)]
    got = {r["label"]: r["area_cm2"] for r in measure.areas_for_intervals(faces, iv).collect()}
    assert got == pytest.approx({"low": 0.005, "high": 0.010})


def test_areas_and_edges(spark):
    v, t = square(spark, 2)
    areas = mesh.triangle_areas(t, v)
    assert [r["area"] for r in areas.collect()] == [0.5, 0.5]
    edges = {(r["a"], r["b"]): r["length"] for r in mesh.mesh_edges(t, v).collect()}
    assert len(edges) == 5 and edges[1, 2] == pytest.approx(math.sqrt(2))


def test_nn_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 3)) * [1, 5, 50], rng.normal(size=(80, 3)) * [1, 5, 50]
    frame = lambda x: spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "map_id long, vertex_id int, x double, y double, z double")
    got = {}
    for r in spatial.nn_join(frame(a), frame(b), ["map_id"], k=3).collect():
        got.setdefault(r["vertex_id"], {})[r["rank"]] = r["near_id"]
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    for i in range(len(a)):
        assert [got[i][k] for k in (1, 2, 3)] == list(np.argsort(d[i])[:3])


@pytest.mark.parametrize("k", [1, 4])
def test_nn_join_on_maps_of_other_sizes_and_far_clouds(spark, k):
    """A small dense map, a wide sparse one, one point alone, and a cloud some 360 mm away from its surface."""
    rng = np.random.default_rng(7)
    sphere = lambda n, r: (lambda v: v / np.linalg.norm(v, axis=1)[:, None] * r)(rng.normal(size=(n, 3)))
    surfaces = {1: sphere(400, 0.5), 2: sphere(60, 900.0), 3: np.array([[1.0, 2.0, 3.0]]), 4: sphere(500, 40.0)}
    clouds = {1: sphere(50, 0.52), 2: sphere(50, 850.0), 3: rng.normal(size=(5, 3)), 4: np.vstack([sphere(60, 38.0) + [360, 0, 20], sphere(40, 41.0)])}
    frame = lambda maps: spark.createDataFrame([(m, i, *map(float, p)) for m, x in maps.items() for i, p in enumerate(x)] + [(4, 9999, float("nan"), 0.0, 0.0)], "map_id long, vertex_id int, x double, y double, z double")
    got = {}
    for r in spatial.nn_join(frame(clouds), frame(surfaces), ["map_id"], k=k).collect():
        got.setdefault((r["map_id"], r["vertex_id"]), {})[r["rank"]] = r["near_id"]
    for m, x in clouds.items():
        d = np.linalg.norm(x[:, None] - surfaces[m][None], axis=2)
        for i in range(len(x)):
            want = list(np.argsort(d[i], kind="stable")[:k])
            assert [got[m, i][j + 1] for j in range(len(want))] == want and len(got[m, i]) == len(want)


def test_region_spread_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK", 16)
    rng = np.random.default_rng(2)
    grid = np.array([(i % 7, i // 7, 0) for i in range(49)], dtype=float)  # the same distance again and again
    maps = {1: rng.normal(size=(70, 3)) * 30, 2: rng.normal(size=(2, 3)), 3: rng.normal(size=(1, 3)), 4: np.zeros((5, 3)), 5: grid}
    v = spark.createDataFrame([(m, i, *map(float, p)) for m, x in maps.items() for i, p in enumerate(x)], "map_id long, vertex_id int, x double, y double, z double")
    scalars = v.select("map_id", "vertex_id", F.lit(1.0).alias("value")).unionByName(spark.createDataFrame([(9, 0, 5.0)], "map_id long, vertex_id int, value double"))
    got = {r["map_id"]: tuple(r)[1:] for r in spread.region_spread(scalars, v, 0.0, 2.0).collect()}
    for m, x in maps.items():
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        pairs = d[np.triu_indices(len(x), 1)]
        want = (np.where(np.eye(len(x)), np.inf, d).min(axis=1).max(), pairs.max(), pairs.mean(), np.median(pairs)) if len(pairs) else (0, 0, 0, 0)
        assert got[m] == pytest.approx(want, abs=1e-7)
    assert got[9] == (0, 0, 0, 0)


def test_nested_attribute_filters(spark):
    texts = [
        '{"a": {"k": 7, "x y": [1, {"b": "7"}, "s"]}, "n": null, "flag": true, "f": 7.0}', '{"a": {"k": "7"}, "n": 0, "flag": "true"}', '{"a": 7, "f": 7.5}', '{"a": [7, [8]], "s": "TRUE"}',
        "no json", None, "[]", '{"a": {}, "big": 9007199254740993}',
    ]
    maps = spark.createDataFrame(list(enumerate(texts)), "map_id long, attributes string")
    found = lambda f: sorted(r["map_id"] for r in report.filter_by_attributes(maps, f).collect())
    assert found({}) == list(range(8))
    assert found({"a": {"k": 7}}) == [0] and found({"a": {"k": "7"}}) == [1] and found({"a": 7}) == [2] and found({"a": {}}) == [0, 1, 7]
    assert found({"a": {"x y": [{"b": "7"}]}}) == [0] and found({"a": {"x y": ["s", 1]}}) == [0] and found({"a": {"x y": [2]}}) == [] and found({"a": [[8]]}) == [3] and found({"a": [8]}) == []
    assert found({"n": None}) == [0] and found({"flag": "True"}) == [0] and found({"flag": True}) == [0] and found({"a": {"k": "true"}}) == []
    assert found({"f": 7}) == [0] and found({"f": 7.5}) == [2] and found({"missing": None}) == []
    assert found({"big": 9007199254740993}) == [7] and found({"big": 9007199254740992}) == []


def test_cohort_with_and_without_multifocal_maps(spark):
    rng = np.random.default_rng(6)
    parts = ["posterior wall", "anterior wall", "lateral wall", "roof"]
    rows = [(str(rng.choice(["LA", "RA"])), str(rng.choice(parts)), int(rng.integers(1, 3)), bool(rng.random() < 0.3), float(rng.integers(3, 9)), float(rng.normal(10, 3)) if rng.random() < 0.9 else float("nan")) for _ in range(200)]
    rows.append(("LA", "roof", 2, None, 9.0, None))
    df = spark.createDataFrame(rows, "atrium string, part string, ref_catheters int, is_multifocal boolean, max_geodesic_dist double, sigma double")
    got = {(r["ref_catheters"], r["region"], r["level"]): r for r in report.cohort_summary(df).collect()}
    label = lambda a, p: {("LA", "posterior"): "LA post", ("LA", "anterior"): "LA ant", ("RA", "posterior"): "RA post", ("RA", "lateral"): "RA lat"}.get((a, p.split()[0]), f"{a} {p}")
    kept = [(ref, label(a, p), bool(m), s) for a, p, ref, m, far, s in rows if far >= 5]
    for key, r in got.items():
        own = [x for x in kept if (key[0] is None or x[0] == key[0]) and (key[1] is None or x[1] == key[1])]
        assert (r["n_all"], r["n_focal"], r["n_excluded"]) == (len(own), sum(not x[2] for x in own), sum(x[2] for x in own))
        for name, some in (("all", own), ("focal", [x for x in own if not x[2]])):
            v = [x[3] for x in some if x[3] is not None and not math.isnan(x[3])]
            for stat, q in (("median", 50), ("q1", 25), ("q3", 75)):
                assert r[f"{stat}_{name}"] == (pytest.approx(np.percentile(v, q)) if v else None)
    assert {k[2] for k in got} == {0, 1, 2, 3} and (None, None, 3) in got


def test_exact_rank_sum_law(spark):
    from itertools import combinations

    for n1, n2 in ((2, 2), (3, 5), (5, 3), (8, 4)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        assert [int(w) for w in report._rank_sums(n1, n2)] == [us.count(u) for u in range(n1 * n2 + 1)]
    rows = [("small", i < 3, v) for i, v in enumerate([9.0, 7.0, 3.0, 1.0, 2.0, 8.0, 4.0])] + [("ties", i < 3, v) for i, v in enumerate([9.0, 7.0, 3.0, 3.0, 2.0, 8.0])]
    rows += [("large", i % 2 == 0, float(i * i % 101) + i / 1000) for i in range(60)] + [("one", True, 1.0), ("one", False, 2.0), ("small", True, None), ("small", False, float("nan"))]
    got = {r["region"]: r for r in report.mann_whitney(spark.createDataFrame(rows, "region string, good boolean, v double"), ["region"], "good", "v").collect()}
    us = [sum(c) - 3 for c in combinations(range(7), 3)]
    assert (got["small"]["u"], got["small"]["exact"]) == (9.0, True) and got["small"]["p"] == pytest.approx(sum(u >= 9 for u in us) / len(us))
    assert not got["ties"]["exact"] and not got["large"]["exact"] and "one" not in got
    for name in ("ties", "large"):
        assert got[name]["p"] == pytest.approx(0.5 * math.erfc(got[name]["z"] / math.sqrt(2)), rel=1e-12)
    z = spark.range(-400, 401).select((F.col("id") / 20.0).alias("z"))
    for r in z.select("z", report._normal_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-9, abs=1e-300)


def uneven(spark, n=7):
    """A bent square mesh with edges of many lengths: vertices, triangles as arrays and as tables."""
    rng = np.random.default_rng(8)
    xyz = np.array([(i % n, i // n, 0) for i in range(n * n)], float) + rng.uniform(-0.4, 0.4, (n * n, 3))
    tri = np.array([t for r in range(n - 1) for c in range(n - 1) for a in (r * n + c,) for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))])
    v = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "map_id long, vertex_id int, x double, y double, z double")
    t = spark.createDataFrame([(1, i, *map(int, x)) for i, x in enumerate(tri)], "map_id long, tri_id int, v0 int, v1 int, v2 int")
    return xyz, tri, v, t


def test_labels_follow_the_neighbour_nearest_to_the_sources(spark):
    xyz, tri, v, t = uneven(spark)
    n = len(xyz)
    near = [set() for _ in range(n + 1)]
    for a, b in [e for x in tri for e in ((x[0], x[1]), (x[1], x[2]), (x[2], x[0]))]:
        near[a].add(b)
        near[b].add(a)
    rng = np.random.default_rng(9)
    # distances that fit no path: with local minima that are no sources, ties and a vertex that is out of reach
    d = np.round(rng.uniform(1, 5, n), 1)
    d[[3, 40]] = 0.0
    d[17], d[25] = np.inf, 2.0
    label = {3: 3, 40: 40}
    for i in sorted(range(n), key=lambda i: (d[i], i)):
        if i not in label:
            best = min(((d[w], w) for w in near[i] if w in label and d[w] < np.inf), default=None)
            if best:
                label[i] = label[best[1]]
    distances = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(d)] + [(1, n, 0.5)], "map_id long, vertex_id int, distance double")
    edges = mesh.mesh_edges(t, v)
    sources = spark.createDataFrame([(1, 3), (1, 40)], "map_id long, vertex_id int")
    got = {r["vertex_id"]: r["source"] for r in geodesic.nearest_source(edges, distances, sources).collect()}
    assert got == {i: label.get(i, -1) for i in range(n + 1)}


@pytest.mark.parametrize("cycle", [None, 0.0, 30.0, -1.0])
def test_heat_interpolation_counts_every_measurement(spark, cycle):
    xyz, tri, v, t = uneven(spark)
    n = len(xyz)
    rows = [(1, 8, 10.0), (1, 8, 12.0), (1, 8, 17.0), (1, 30, 2.0), (1, 44, 31.0), (1, 44, float("nan")), (1, 12, None)]
    field = spark.createDataFrame(rows, "map_id long, vertex_id int, value double")
    # cotangent weights and lumped areas, solved densely
    stiff, mass = np.zeros((n, n)), np.zeros(n)
    for x in tri:
        area = np.linalg.norm(np.cross(xyz[x[1]] - xyz[x[0]], xyz[x[2]] - xyz[x[0]])) / 2
        for k in range(3):
            o, a, b = x[k], x[(k + 1) % 3], x[(k + 2) % 3]
            mass[o] += area / 3
            e, f = xyz[a] - xyz[o], xyz[b] - xyz[o]
            w = e @ f / np.linalg.norm(np.cross(e, f)) / 2
            stiff[a, b] -= w
            stiff[b, a] -= w
            stiff[a, a] += w
            stiff[b, b] += w
    measured = [(i, x) for _, i, x in rows if x is not None and not math.isnan(x)]
    # vertices measured once: the distances to their nearest measured neighbours
    places = sorted({i for i, _ in measured})
    single = [i for i in places if sum(j == i for j, _ in measured) == 1]
    sigma = np.median([min(np.linalg.norm(xyz[i] - xyz[j]) for j in places if j != i) for i in single])
    edge = np.mean([np.linalg.norm(xyz[x[0]] - xyz[x[1]]) for x in tri])
    solve = lambda r: np.linalg.solve(np.diag(mass) + max(sigma**2 / 2, edge**2) * stiff, r)
    put = lambda f: np.bincount([i for i, _ in measured], [f(x) for _, x in measured], n)
    lo, length = 2.0, {None: None, 0.0: 29.0, 30.0: 30.0, -1.0: None}[cycle]
    weight = solve(put(lambda x: 1.0))
    if length:
        turn = np.arctan2(solve(put(lambda x: math.sin(2 * math.pi * x / length))), solve(put(lambda x: math.cos(2 * math.pi * x / length)))) / (2 * math.pi) * length
        want = lo + (turn - lo) % length
    else:
        want = solve(put(lambda x: x)) / weight
    got = {r["vertex_id"]: r["value"] for r in geodesic.heat_interpolate(v, t, field, cycle_length=cycle).collect()}
    for i in range(n):
        assert got[i] == (pytest.approx(want[i], abs=1e-5) if weight[i] > 1e-6 * weight.max() else None)


def test_ablation_indices_keep_their_family(spark):
    kind = "study_id long, placed_id long, type string, x double, y double, z double, attributes map<string,string>"
    rows = [
        (1, 1, "ablation", 0.0, 0.0, 0.0, {"rf_index": "3.5", "max_power_w": "40"}), (1, 2, "ablation", 0.0, 0.0, 0.0, {}), (1, 3, "ablation_pfa", 0.0, 0.0, 0.0, {"lesion_index": "9"}),
        (1, 4, "ablation", float("nan"), 0.0, 0.0, {"lesion_index": "9"}), (2, 5, "ablation", 0.0, 0.0, 0.0, {"rf_index": "1"}), (2, 6, "ablation", 0.0, 0.0, 0.0, {"ablation_index": "2"}), (None, 7, "ablation", 0.0, 0.0, 0.0, None),
    ]
    placed = spark.createDataFrame(rows, kind)
    got = {r["placed_id"]: (r["power"], r["index_name"], r["index"]) for r in link.ablation_table(placed).collect()}
    assert got == {1: (40.0, "rf_index", 3.5), 2: (None, "rf_index", None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None)}
    counts = {r["study_id"]: (r["n_markers"], r["n_excluded"], r["families"]) for r in link.ablation_counts(placed).collect()}
    assert counts == {1: (2, 2, "rf_index"), 2: (2, 0, "rf_index,ablation_index"), None: (1, 0, "")}


def test_maps_are_planned_with_their_files(spark):
    from atriaflow.sources import exports

    maps = spark.createDataFrame([("e", "a", 5), ("e", "b", 4), ("e", "c", 9)], "export string, map_name string, n_points int")
    shapes = spark.createDataFrame([("e", "a", 3, "y"), ("e", "a", 3, "x"), ("e", "c", 3, "p"), ("e", "c", 4, "q")], "export string, map_name string, n_vertices int, path string")
    got = {r["map_name"]: (r["included"], r["issue"], r["files"] and [tuple(f) for f in r["files"]]) for r in exports.plan_maps(maps, shapes).collect()}
    assert got == {"a": (True, None, [("x", 3), ("y", 3)]), "b": (False, None, None), "c": (True, "files of different vertex counts", [("p", 3), ("q", 4)])}


def test_readers_do_not_shuffle(spark):
    from atriaflow.sources import exports

    empty = files(spark, ("x", "y"))
    plans = [*exports.read_mesh(empty), exports.read_mesh_flags(empty), exports.read_ecg_windows(empty), exports.read_dws(empty), exports.read_preamble(empty), exports.read_channel_map(empty), exports.read_placed_points(empty, ",", "k"), exports.read_marker_tables(empty)]
    plans += [*studies.read_force(empty), studies.read_point_cloud(empty), studies.read_dxl_points(empty), studies.read_archive_points(empty), studies.read_dxl_waveforms(empty), studies.read_map_names(empty)]
    for df in plans:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_point_exports_are_looked_up_once(spark):
    """Columns are found once a file, each line is split once; odd cells, a second column of a name, a value column that is not valid."""
    head = "Export\nData starts in row,4\nMap type:,CFEmean_uni\n(Point #),surface x, surface y,surface z,surface x,New valid,New,adjTime (ms),force (g),roving x,roving y,roving z,Electrodes,Freeze Grp #\n"
    lines = ["7,1,2,3,9,1.0,4.5,9000,-1,1,2,3,D2, g1", "8,1,2,NaN,9,1,4,1,1,1,2,3,D2,g", "", "9,1,2,3,,0,4,-8999,0,1,,3,,", "10,-1e1,2, 3 "]
    out = studies.read_dxl_points(files(spark, ("a/b.csv", head + "\n".join(lines))))
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")
    assert above.count("split(") <= 1 and "array_position" not in above and "rlike" not in above.lower() and "array_position" in below
    got = {r["source_id"]: ((r["point_index"], r["x"], r["z"]), {k: tuple(v) for k, v in r["measurements"].items()}, r["electrodes"], r["annotations"]) for r in out.collect()}
    folder = {"source_folder": "dir/a"}
    assert got == {
        "7": ((0, 1.0, 3.0), {"cfe_mean_uni": (4.5, "cfe_mean", "")}, {"D2": [1.0, 2.0, 3.0]}, {"freeze_group": "g1", **folder}),
        "9": ((3, 1.0, 3.0), {"annotation_time": (-8999.0, "activation_time", "ms"), "contact_force": (0.0, "contact_force", "g")}, {}, {"reference_adjustment_ms": "-8999.0", **folder}),
        "10": ((4, -10.0, 3.0), {}, {}, folder),
    }


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_meshes_by_sections(spark):
    from atriaflow.sources import exports

    text = "#TriangulatedMeshVersion2.0 \r\n[verticescolorssection]\n; a\n; B c\n0 = -10000 2\n1 = 3 4 5\n\n[VerticesSection]\n7 = 1 2 3 0 0 1\n[TrianglesSection]\n; x\n0 = 7 7 7 0 0 1 -1\n1 = 7 7 7 0 0 1 0"
    v, t, c = exports.read_mesh(files(spark, ("m", text)))
    assert [(r["vertex_id"], r["z"]) for r in v.collect()] == [(7, 3.0)] and [r["tri_id"] for r in t.collect()] == [1]
    assert sorted((r["vertex_id"], r["column"], r["value"]) for r in c.collect() if r["value"]) == [(0, "c", 2.0), (1, "color_0", 3.0), (1, "color_1", 4.0), (1, "color_2", 5.0)]
    assert exports.read_mesh_flags(files(spark, ("m", text))).count() == 0
    fails(v.sparkSession.createDataFrame([("m", "#TriangulatedMeshVersion1.0\n")], "file string, value string").transform(lambda d: exports.read_mesh(d)[0]), "TriangulatedMeshVersion2.0")


def test_windows_and_matrices(spark):
    from atriaflow.sources import exports

    head = "v\nRaw ECG to MV (gain) = 0.003\nM1(1) M2(2)\n"
    assert [round(r["value"], 6) for r in exports.read_ecg_windows(files(spark, ("e", head + "1 2\n3 4\n5"))).orderBy("sample_idx", "channel").collect()] == [0.003, 0.006, 0.009, 0.012]
    fails(exports.read_ecg_windows(files(spark, ("e", head + "1 2\n3\n5 6"))), "malformed row")
    assert exports.read_ecg_windows(files(spark, ("e", head))).count() == 0
    table = "Export: x: y\nCatheter[0]: no\nchannel,catheter name,electrode name,is visible\n0, CS,20A_1,1\n1,CS\nend,a,b\n2,CS,x,1\nt_dws,t_ref,c0,c0_ds\n0,1,5,6\n,,,\nEOF"
    f = files(spark, ("d", table))
    assert [tuple(r)[1:] for r in exports.read_channel_map(f).orderBy("channel").collect()] == [("0", "CS", "20A_1", True), ("1", "CS", None, None)]
    assert [tuple(r)[1:] for r in exports.read_preamble(f).collect()] == [("Export", "x: y")]
    assert [(r["sample_idx"], r["channel"], r["value"]) for r in exports.read_dws(f).collect()] == [(0, "c0", 5.0)]
    fails(exports.read_dws(files(spark, ("d", "t: 1\nx,y"))), "no sample matrix")
    kinds = spark.createDataFrame([(n,) for n in ("a/Contact_Force.csv", "Model_Point_Cloud_1.csv", "ECG_raw.csv", "Electrode_Locations.csv")], "file string").select(exports.dws_kind())
    assert [r[0] for r in kinds.collect()] == ["timeseries", "point_cloud", "waveforms", "timeseries"]


def test_marker_tables_by_file_name(spark):
    from atriaflow.sources import exports

    texts = (
        ("s/AutoMark_Data.csv", "Export\n\nRF Episode,Lesion ID,NavX ABL-D X (mm),NavX ABL-D Y (mm),NavX ABL-D Z (mm),Max Power (W)\n1,L7,1,2,3,40,\n2,L8,,2,3,40\n3,L9,4,5,6,\n\nRF Episode,other\n9,9"),
        ("s/Duo_AutoMarksSummaryList_VoXel.csv", "t_dws,a legend\nt_dws,t_secs,ID,AutoMark Location X,AutoMark Location Y,AutoMark Location Z,Average Force,Duration\n0,0,D1,1,1,bad,9,9\n0,0,D2,1,1,2,8,\nt_dws,t_secs,next\n1,2,3"),
        ("s/Lesions.csv", 'Text,Type,Surface,x,y,z,R,G,B,Diameter,Annotation\n"a, b",dot,1,1,2,3,255,0.0,7,4,"said ""no"""\n,dot,1,4,5,6,1,2,,,'),
        ("s/My_Labels.csv", "Text,Type,Surface,x,y,z\nHis,lm,1,1,2,3"), ("s/Other.csv", "Text,Type,Surface,x,y,z\nHis,lm,1,1,2,3"), ("s/Labels.csv", "Text;Type"),
    )
    got = {(r["type"], r["source_id"]): (r["x"], r["z"], r["label"], r["attributes"]) for r in exports.read_marker_tables(files(spark, *texts)).collect()}
    assert got == {
        ("ablation", "L7"): (1.0, 3.0, None, {"rf_episode": "1", "lesion_id": "L7", "power": "40"}), ("ablation", "L9"): (4.0, 6.0, None, {"rf_episode": "3", "lesion_id": "L9"}),
        ("ablation_pfa", "D2"): (1.0, 2.0, None, {"avg_force": "8"}),
        ("marker", "a, b"): (1.0, 3.0, "a, b", {"marker_type": "dot", "diameter": "4", "annotation": 'said "no"', "color": "255,0,7"}), ("marker", None): (4.0, 6.0, None, {"marker_type": "dot"}),
        ("landmark", "His"): (1.0, 3.0, "His", {"marker_type": "lm"}),
    }


def test_strict_force_and_signal_texts(spark):
    head = "x\nIntervalNonGraph\n0 1 2 3\nIndex\tTime\tForceValue\tAxialAngle\tLateralAngle\n"
    windows, samples = studies.read_force(files(spark, ("f", head + "0 10 1 2 3\n1 30 4 5 6\n\n2 40 7 8 9")))
    assert tuple(windows.first()) == ("dir/f", 1000 / 15, 1.0, 2.0, 3.0) and samples.count() == 9
    assert studies.read_force(files(spark, ("f", head + "0 10 1 2 3\n1 10 4 5 6")))[0].first()["sample_rate"] is None
    for text in (head + "0 10 1 2", head + "0 10 1 2 x", "no header", head, head.replace("Time", "Clock") + "0 10 1 2 3"):
        fails(studies.read_force(files(spark, ("f", text)))[1], "malformed force rows|no force columns")
    signal = 'Sample rate:,2\nTrace,startTime (abs),rovTime (wave samples),"(Point #)",0,1\n'
    rows = studies.read_dxl_waveforms(files(spark, ("wave_rov.csv", signal + '"a, b",1.5,1,"p",3,\nc,2,2,q,4,5'))).orderBy("row_no", "sample_idx").collect()
    assert [(r["channel"], r["point_id"], r["map_sample"], r["value"]) for r in rows] == [("a, b", "p", 1.0, 3.0), ("a, b", "p", 1.0, None), ("c", "q", None, 4.0), ("c", "q", None, 5.0)]
    for row in ("a,,1,p,3,4", "a,x,1,p,3,4", "a,1,1,p,3,y"):
        fails(studies.read_dxl_waveforms(files(spark, ("wave_rov.csv", signal + row))), "no number")


def test_map_names_and_encodings(spark, tmp_path):
    from atriaflow.sources import lines

    texts = ["Data starts in row,3\nMap name:,VoXel\tREMAP - SR \nx", "Data starts in row,2\nx\nMap name:,late", "Map NAME:, plain", "Map name:,m\t", "nothing", "Data starts in row,x\nMap name:,a"]
    got = {r["file"]: r["map_name"] for r in studies.read_map_names(files(spark, *[(str(i), t) for i, t in enumerate(texts)])).collect()}
    assert got == {"dir/0": "REMAP - SR", "dir/1": None, "dir/2": "plain", "dir/3": None, "dir/4": None, "dir/5": "a"}
    (tmp_path / "latin.txt").write_bytes("5 µV".encode("latin-1"))
    (tmp_path / "utf.txt").write_bytes("5 µV".encode())
    assert {r["value"] for r in lines.whole_files(spark, str(tmp_path)).collect()} == {"5 µV"}


def test_names_are_found_by_seeds(spark):
    names = ["Customer#000000012", "Customer#000000123", "ab", "Customer", "aaaa", "xyzzy" * 9, ".*(", "ä–ß"]
    texts = ["Customer#000000012 and Customer#000000123", "about", "aaaaaa", "no", "", "q" + "xyzzy" * 10, "a.*(b", "–ä–ß–", None, "A"]
    n, t = spark.createDataFrame([(x, str(i)) for i, x in enumerate(names)], "name string, study_id string"), spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for kept in (names, [x for x in names if len(x) > 4]):
        got = {(r["id"], r["name"]) for r in report.names_in(t, n.filter(F.col("name").isin(kept)), ["id"]).collect()}
        assert got == {(i, x) for i, text in enumerate(texts) for x in kept if text and x in text}
    assert report.names_in(t, n.limit(0), ["id"]).count() == 0


def test_signal_store_prunes(spark, tmp_path, monkeypatch):
    from atriaflow.sources import signals

    monkeypatch.setattr(signals, "ROW_GROUP", 4 << 10)
    df = spark.range(40000).select(F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("data_uri"), (F.col("id") / 4).cast("int").alias("sample_idx"), (F.floor(F.col("id") / 4) / 1000.0).alias("t"), F.lit("c").alias("channel"), (F.hash("id") % 1000 / 7.0).alias("value"))
    path = str(tmp_path / "store")
    signals.write_samples(df.unionByName(df), path, 6)
    assert spark.read.parquet(f"{path}/samples").count() == 40000
    some = signals.read_samples(spark, path, ["c"], (2.0, 2.25), ["u1"])
    assert sorted(r["sample_idx"] for r in some.collect()) == list(range(2000, 2251))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,2.0)" in plan and "In(data_uri" in plan or "EqualTo(data_uri" in plan
    assert "dynamicpruning" in plan.lower()
    # row groups of the files: few can hold the range
    import glob

    import pyarrow.parquet as pq

    groups = hit = 0
    for f in glob.glob(f"{path}/samples/*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            uri, t = (meta.row_group(g).column(at[c]).statistics for c in ("data_uri", "t"))
            groups += 1
            hit += uri.min <= "u1" <= uri.max and t.min <= 2.25 and t.max >= 2.0
    assert groups > 30 and hit < groups / 10
    assert signals.read_samples(spark, path).count() == 40000


def test_same_map_has_no_delta(spark):
    v, _ = square(spark, 4)
    two = v.drop("map_id").withColumn("map_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    s = two.withColumn("name", F.lit("f")).withColumn("value", F.col("x") * 2)
    pairs = spark.createDataFrame([(9, 0, 1)], "pair_id long, map_a long, map_b long")
    got = spatial.compare_maps(pairs, two, s, "f").collect()
    assert len(got) == 16 and all(r["delta"] == 0 and r["distance"] == 0 for r in got)


def test_shortest_paths_and_labels(spark):
    v, t = square(spark, 11)
    src = spark.createDataFrame([(0, 0), (0, 120)], "map_id long, vertex_id int")
    edges = mesh.mesh_edges(t, v)
    paths = geodesic.shortest_paths(edges, src)
    got = {r["vertex_id"]: r for r in paths.collect()}
    assert got[10]["distance"] == pytest.approx(10) and got[12]["source"] == 0 and got[108]["source"] == 120
    labels = {r["vertex_id"]: r["source"] for r in geodesic.nearest_source(edges, paths.select("map_id", "vertex_id", "distance"), src).collect()}
    assert labels[1] == 0 and labels[119] == 120


def test_heat_distance_near_plane(spark):
    v, t = square(spark, 21)
    src = spark.createDataFrame([(0, 220)], "map_id long, vertex_id int")
    got = {r["vertex_id"]: r["distance"] for r in geodesic.heat_geodesic(v, t, src).collect()}
    want = {i: math.hypot(i % 21 - 10, i // 21 - 10) for i in range(441)}
    rel = [abs(got[i] - want[i]) / want[i] for i in got if want[i] > 0]
    assert np.median(rel) < 0.05


def test_heat_interpolation_keeps_constants(spark):
    v, t = square(spark, 7)
    field = v.filter("vertex_id % 5 = 0").select("map_id", "vertex_id", F.lit(3.5).alias("value"))
    assert all(r["value"] == pytest.approx(3.5) for r in geodesic.heat_interpolate(v, t, field, 2.0).collect())


def test_conduction_follows_the_gradient(spark):
    v, _ = square(spark, 6)
    got = geodesic.conduction_directions(v.withColumn("value", F.col("x") * 4)).collect()
    assert all(abs(r["dx"] - 1) < 1e-6 and abs(r["dy"]) < 1e-6 for r in got)


def test_conduction_sends_no_points_through_the_driver(spark, tmp_path):
    """Files look small when compressed; a map is laid flat once, and no vertices are broadcast."""
    square(spark, 6)[0].withColumn("value", F.col("y") * 4).write.parquet(str(tmp_path / "v"))
    got = geodesic.conduction_directions(spark.read.parquet(str(tmp_path / "v")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapGroups" not in plan
    assert all(abs(r["dx"]) < 1e-6 and abs(r["dy"] - 1) < 1e-6 for r in got.collect())


def test_cyclic_mean_wraps(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "map_id long, vertex_id int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, -1.0, 0.0, 0.0, 5.0), (0, 1, 1.0, 0.0, 0.0, 295.0)], "map_id long, point_index int, x double, y double, z double, value double")
    got = spatial.gaussian_interpolate(v, f, 2.0, None, 300.0).first()["value"]
    assert min(abs(got - 300), abs(got)) < 1e-6
    assert spatial.gaussian_interpolate(v, f, 2.0).first()["value"] == pytest.approx(150)


def test_primary_slot(spark):
    s = spark.createDataFrame([(1, -10000.0), (1, -20.0), (1, -80.0), (2, -20.0), (2, 30.0)], "map_id long, value double")
    got = {r["map_id"]: (r["kind"], r["sign"]) for r in vocab.classify_primary(s).collect()}
    assert got == {1: ("pacemap_score", -1), 2: ("activation_time", 1)}


def test_point_scores_and_channels(spark):
    raw = spark.createDataFrame([(1, 0, 100, 20), (1, 1, 100, 130), (1, 2, 0, -10000)], "map_id long, point_index int, reference int, map_annotation int")
    verdict = spark.createDataFrame([(1, "pacemap_score")], "map_id long, kind string")
    assert {r["point_index"]: r["value"] for r in vocab.decode_point_annotations(raw, verdict).collect()} == {0: 80.0, 1: None, 2: None}
    row = spark.createDataFrame([("CS 1-2", "M1 (12)")], "b string, c string").select(columns.unipoles(F.col("b")).alias("u"), columns.split_channel(F.col("c")).alias("c")).first()
    assert row["u"] == ["CS 1", "CS 2"] and row["c"]["name"] == "M1" and row["c"]["id"] == "12"


def test_force_window_must_be_one(spark):
    points = spark.createDataFrame([(1, 1, "a", 1000.02), (1, 1, "b", 2000.5)], "study_id long, map_id long, point_id string, at double")
    windows = spark.createDataFrame([(1, None, "w1", 1000.0, 0.0, 0.04), (1, 1, "w2", 2000.0, 0.0, 1.0), (1, None, "w3", 2000.0, 0.0, 2.0)], "study_id long, map_id long, data_uri string, start_time double, first double, last double")
    got = {r["point_id"]: r["data_uri"] for r in link.force_for_points(points, windows).collect()}
    assert got == {"a": "w1", "b": None}


def test_windows_that_name_their_point(spark):
    points = spark.createDataFrame([(1, 1, 7, 0.0), (1, 1, 8, 5.0), (1, 2, 7, 50.0), (2, None, 7, None), (1, 1, 9, 5.0)], "study_id long, map_id long, point_id long, at double")
    windows = spark.createDataFrame(
        [(1, 1, "d7", None, None, None, "7"), (1, None, "d8", None, None, None, "8"), (1, 1, "t", 4.0, 0.0, 2.0, None), (2, None, "x", None, None, None, "7"), (1, 3, "other", 0.0, 0.0, 99.0, None)],
        "study_id long, map_id long, data_uri string, start_time double, first double, last double, of_point string",
    )
    got = {(r["study_id"], r["map_id"], r["point_id"]): (r["data_uri"], r["direct"]) for r in link.force_for_points(points, windows).collect()}
    # point 8 is named by one window and lies in another: two candidates, so none
    assert got == {(1, 1, 7): ("d7", True), (1, 1, 8): (None, None), (1, 2, 7): (None, None), (2, None, 7): ("x", True), (1, 1, 9): ("t", False)}


@pytest.mark.parametrize("seconds", [0.7, 3.0, 1000.0])
def test_nearest_samples(spark, seconds):
    """The as-of join against all pairs: ties, points at, between, before and after samples, stretches without any."""
    rng = np.random.default_rng(5)
    samples = [(u, c, i, t, float(i)) for u in "ab" for c in "xy" for i, t in enumerate(np.sort(rng.choice(60, 25)) / 4.0) if not (c == "y" and 3 < t < 11)]
    points = [(f"{u}{k}", u, float(k) / 8 - 4) for u in "abz" for k in range(200)]
    df = spark.createDataFrame([(u, c, i, float(t), v) for u, c, i, t, v in samples], "data_uri string, channel string, sample_idx int, t double, value double")
    near = link.nearest_samples(spark.createDataFrame(points, "point_id string, data_uri string, rel_t double"), df, seconds)
    got = {(r["point_id"], r["channel"]): (r["sample_idx"], r["value"]) for r in near.collect()}
    want = {}
    for p, u, at in points:
        for c in "xy":
            own = [(abs(t - at), i, v) for w, k, i, t, v in samples if (w, k) == (u, c)]
            if own:
                want[p, c] = min(own)[1:]
    assert got == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "rel_t" not in plan.split("Join")[0] or "Union" in plan


def test_mixed_rates_are_an_error(spark):
    kind = "point_id long, role string, data_uri string, channel string, sample_rate double, n_samples int, start_time double, primary boolean, map_id long"
    samples = spark.createDataFrame([(u, "c", i, float(i)) for u in "abcd" for i in (1, 0)], "data_uri string, channel string, sample_idx int, value double")
    own = [(1, "bipolar", "a", "c", 1000.0, 2, 0.0, True, 1), (1, "reference", "b", "c", 1000.0, 2, 5e-7, False, 1), (1, "ecg", "c", "c", 1000.0, 2, None, False, 1), (2, "bipolar", "d", "c", None, 2, 0.0, True, 2)]
    rows = link.signal_arrays(spark.createDataFrame(own, kind), samples).collect()
    assert {(r["point_id"], r["role"]): r["trace"] for r in rows} == {(1, "bipolar"): [0.0, 1.0], (1, "reference"): [0.0, 1.0]}
    mixed = [*own, (3, "bipolar", "d", "c", 500.0, 2, 0.0, True, 1)]
    for df in (spark.createDataFrame(mixed, kind), spark.createDataFrame(mixed, kind).drop("map_id")):
        with pytest.raises(Exception, match="mixed sample rates"):
            link.signal_arrays(df, samples).collect()


def test_beat_windows(spark):
    samples = spark.createDataFrame([("u", i, i / 100.0 - 3, "c", 0.0) for i in range(700)], "data_uri string, sample_idx int, t double, channel string, value double")
    points = spark.createDataFrame([(k, "u", k / 7.0 - 2, 0.0) for k in range(30)], "point_id long, data_uri string, reference_t double, map_t double")
    got = {(r["point_id"], r["sample_idx"]) for r in report.beat_window(points, samples, 250.0).collect()}
    assert got == {(k, i) for k in range(30) for i in range(700) if abs((i / 100.0 - 3 - (k / 7.0 - 2)) * 1000) <= 250.0}


def test_signal_binding_is_unique(spark):
    points = spark.createDataFrame([(1, "p", "g", "bipolar", " cs 1-2"), (1, "p", "g", "ecg", "V1"), (1, "p", "g", "reference", "R"), (1, "q", "h", "reference", "R")], "study_id long, point_id string, freeze_group string, role string, wanted string")
    channels = spark.createDataFrame([("w", 1, "p", None, "CS 1-2"), ("w", 1, "p", None, "V1"), ("x", 1, "p", None, "v1"), ("r", 1, None, "g", "r")], "data_uri string, study_id long, point_id string, freeze_group string, channel string")
    got = {(r["point_id"], r["role"]): (r["n"], r["channel"]) for r in link.bind_signals(points, channels).collect()}
    assert got == {("p", "bipolar"): (1, "CS 1-2"), ("p", "ecg"): (2, None), ("p", "reference"): (1, "r")}


def test_vectors_hold_every_point(spark):
    long = spark.createDataFrame([(1, 5, "v", "k", "mV", 2.0), (1, 3, "v", "k", "mV", 1.0), (1, 3, "v", "k", "V", 7.0)], "map_id long, point_index int, name string, kind string, unit string, value double")
    points = spark.createDataFrame([(1, 3), (1, 4), (1, 5), (2, 0)], "map_id long, point_index int")
    got = {(r["map_id"], r["unit"]): r["vector"] for r in link.signal_properties(long, points).collect()}
    assert got == {(1, "mV"): [1.0, None, 2.0], (1, "V"): [7.0, None, None]}


def test_regions_leave_zero_coordinates_out(spark):
    rows = [(1, 1, 20.0, 1.0, 1.0), (1, 1, 0.0, 9.0, 9.0), (1, 2, 0.0, 0.0, 0.0), (1, 3, 1.0, 6.0, 7.0), (1, 4, -12.0, 2.0, 1.0)]
    points = spark.createDataFrame(rows, "study_id long, map_id long, x double, y double, z double")
    ref = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "study_id long, rx double, ry double, rz double")
    got = {r["map_id"]: r["region"] for r in report.centroid_region(points, ref).collect()}
    assert got == {1: "lateral wall", 2: None, 3: "anterior wall", 4: None}


def test_texts_lose_names_and_paths(spark):
    rows = [(1, "Ann Lee and Ann", "/home/x", "n"), (2, "study/3", "plain", None), (3, "xAnnx", "a\\b", "n")]
    df = spark.createDataFrame(rows, "id long, title string, extra string, notes string")
    studies = spark.createDataFrame([(7, "Ann"), (8, "Ann Lee"), (9, "")], "study_id long, name string")
    got = {r["id"]: (r["title"], r["extra"], r["notes"]) for r in report.deidentify(df, studies, ["id"], ["title", "extra"]).collect()}
    assert got == {1: ("study/8 and study/7", "[redacted]", "[redacted]"), 2: ("study/3", "plain", None), 3: ("xstudy/7x", "[redacted]", "[redacted]")}
    assert report.deidentify(df, studies, ["id"], ["title"], enabled=False).first()["mode"] == "open"


def test_mann_whitney_tail(spark):
    rows = [("r", i < 6, float(v)) for i, v in enumerate([9, 8, 7, 7, 6, 5, 4, 3, 2, 1])]
    got = report.mann_whitney(spark.createDataFrame(rows, "region string, good boolean, v double"), ["region"], "good", "v").first()
    assert got["u"] == 24 and got["p"] == pytest.approx(0.5 * math.erfc(got["z"] / math.sqrt(2)), abs=1e-12)


@pytest.mark.parametrize(("a", "sigma", "b"), [(80, 9, 5), (100, 3, 0), (40, 25, 60)])
def test_decay_fit_equals_a_fine_grid(spark, a, sigma, b):
    d = np.arange(1, 40, 2.0)
    y = a * np.exp(-(d**2) / (2 * sigma**2)) + b + 3 * np.sin(d)
    got = report.fit_decay(spark.createDataFrame([(1, float(p), float(q), 5) for p, q in zip(d, y)], "map_id long, bin double, mean_score double, n long")).first()
    fits = lambda s, x, z: ((x * np.exp(-(d**2) / (2 * s * s)) + z - y) ** 2).sum()
    best = min(fits(s, x, z) for s in np.linspace(max(0.1, sigma - 4), min(40, sigma + 4), 41) for x in np.linspace(0, 100, 101) for z in np.linspace(0, 100, 101))
    assert fits(got["sigma"], got["amplitude"], got["offset"]) <= best + 1e-9
    assert 0 <= got["amplitude"] <= 100 and 0.1 <= got["sigma"] <= 40 and 0 <= got["offset"] <= 100


def test_decay_fit(spark):
    rows = [(1, d + 0.0, 80 * math.exp(-d * d / (2 * 9.0**2)) + 5, 5) for d in range(1, 40, 2)]
    got = report.fit_decay(spark.createDataFrame(rows, "map_id long, bin double, mean_score double, n long")).first()
    assert got["sigma"] == pytest.approx(9, rel=0.01) and got["amplitude"] == pytest.approx(80, rel=0.01) and got["r2"] > 0.9999


def test_report_has_a_row_for_missing_maps(spark):
    ids = spark.createDataFrame([(1,), (7,)], "map_id long")
    areas = spark.createDataFrame([(1, 2.123456)], "map_id long, area_cm2 double")
    stats = spark.createDataFrame([(1, 0.5, 1.0, 0.7, 0.1)], "map_id long, min_value double, max_value double, mean_value double, std_value double")
    iv = spark.createDataFrame([(1, "low", 1.0)], "map_id long, label string, area_cm2 double")
    own = spark.createDataFrame([(1, {"atrium": "LA"})], "map_id long, attributes map<string,string>")
    got = {r["map_id"]: r for r in report.report_table(ids, areas, stats, iv, iv, ["low"], ["low"], own, ["atrium"]).collect()}
    assert got[1]["area_cm2"] == 2.1235 and got[1]["low (rel)"] == 1.0 and got[1]["atrium"] == "LA" and got[7]["found"] is False and got[7]["low (abs)"] is None


def files(spark, *texts):
    return spark.createDataFrame([(f"dir/{name}", value) for name, value in texts], "file string, value string")


def test_signal_rows_that_are_wrong_are_errors(spark):
    head = "Sample rate:,2\nTrace,(Point #),startTime (abs),0,1\n"
    good = studies.read_dxl_waveforms(files(spark, ("wave_rov.csv", head + "a,7,1.5,3,\nEOF\nx"))).collect()
    assert [(r["point_id"], r["sample_idx"], r["t"], r["value"]) for r in good] == [("7", 0, 0.0, 3.0), ("7", 1, 0.5, None)]
    for text in ("Trace,(Point #),0,1\na,1,2,3", head + "a,7,1.5,3", "Sample rate:,2\nTrace,0,2\na,1,2", "Sample rate:,2\nWaveform samples exported:,3\nTrace,0,1\na,1,2"):
        with pytest.raises(Exception, match="wave_rov"):
            studies.read_dxl_waveforms(files(spark, ("wave_rov.csv", text))).collect()


def test_study_trees_are_kept_once(spark, tmp_path):
    def tree(names):
        maps = spark.createDataFrame([(s, "carto", m) for s in names for m in ("a", "b")], "study_name string, vendor string, map_name string")
        points = spark.createDataFrame([(s, "a", i, float(len(names))) for s in names for i in range(3)], "study_name string, map_name string, point_index int, x double")
        return studies.study_tree(maps, points, spark.createDataFrame([(names[0], "label", 1)], "study_name string, type string, placed_no int"))

    path = str(tmp_path / "store")
    count = lambda name: spark.read.parquet(f"{path}/{name}").count()
    studies.persist_study(tree(["s", "t"]), path)
    studies.persist_study(tree(["s", "t", "u"]), path)
    assert [count(n) for n in ("studies", "maps", "points", "placed_points")] == [3, 6, 9, 1]
    studies.persist_study(tree(["t"]), path, replace=True)
    xs = spark.read.parquet(f"{path}/points").groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in xs} == {2.0: 3, 3.0: 3, 1.0: 3}


def test_raw_components():
    assert studies.raw_components(None) == set(studies.COMPONENTS) and studies.raw_components("") == set() == studies.raw_components([])
    with pytest.raises(ValueError, match="odd"):
        studies.raw_components("mesh, odd")


def test_names_of_volumes_in_a_broken_file(spark):
    got = studies.volume_names(files(spark, ("x.xml", '<DIF><Volume name=" a "><Vertices>1 2'), ("y.xml", "<DIF/>"))).collect()
    assert [(r["file"], r["name"]) for r in got] == [("dir/x.xml", "a")]

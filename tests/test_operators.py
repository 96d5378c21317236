"""Hand-made cases: traps of the catalogue, kernels on known images, statistics on known samples."""

import itertools
import math
import struct
import threading
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import dates, levels, names
from tephra.operators import catalog, evaluate, kernels, models, nearest, pixels, quantiles, report, sample, select
from tephra.sources import catalog_files
from tephra.streaming import ingest


def png(rows, rgb=False):
    kind = 2 if rgb else 0
    raw = b"".join(b"\x00" + bytes(np.asarray(r, dtype=np.uint8).ravel()) for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_names(spark):
    cases = {"cam_20141115_143022.jpg": (2014, 11, 15, 14, 30, 22), "20141115_14.jpg": (2014, 11, 15, 14, 0, 0), "x_2014-11-15_14-30.jpg": (2014, 11, 15, 14, 30, 0), "a/Kalor_Canon_2014-11-12_17.13.07.jpg": (2014, 11, 12, 17, 13, 7), "k_2014-11-12_17.13.jpg": (2014, 11, 12, 17, 13, 0), "therm.jpg": (None,) * 6, None: (None,) * 6}
    df = spark.createDataFrame([(k,) for k in cases], "filename string")
    assert {r.filename: tuple(r)[1:] for r in names.stamped(df).collect()} == cases


def test_moments(spark):
    rows = [(2024, 1, 0, None), (2024, 1, None, 5), (2024, 1, 32, 5), (2024, 13, 1, 5), (2024, 2, 30, 5), (None, 1, 1, 5), (2024, 2, 29, 5)]
    df = spark.createDataFrame(rows, "year int, month int, day int, hour int").withColumns({"minute": F.lit(None).cast("int"), "second": F.lit(None).cast("int")})
    got = [r[0] and r[0].strftime("%d %H") for r in df.select(dates.moment()).collect()]
    assert got == ["01 00", "01 05", "01 05", None, None, None, "29 05"]
    assert [r[0] is None for r in df.select(dates.moment_strict()).collect()] == [True, True, True, True, True, True, False]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("u1", "a", None), ("u3", "c", "x")], "url string, f string, g string")
    new = spark.createDataFrame([("u1", None, "b", 1), ("u2", "q", None, 1), ("u2", "r", None, 2)], "url string, f string, g string, n int")
    once = catalog.upsert(old, new, arrival=F.col("n"))
    want = {("u1", "a", "b"), ("u2", "r", None), ("u3", "c", "x")}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in catalog.upsert(once, new, arrival=F.col("n")).collect()} == want


def test_duplicate_names_do_not_multiply_rows(spark):
    index = spark.createDataFrame([("a", None), ("a", 1.0), ("b", None)], "filename string, s double")
    scores = spark.createDataFrame([("a", 5.0), ("a", 4.0)], "filename string, s double")
    assert sorted((r.filename, r.s) for r in catalog.fill_scores(index, scores, "s", F.col("s")).na.fill(-1).collect()) == [("a", 1.0), ("a", 4.0), ("b", -1.0)]


def test_quality_flags(spark):
    rows = [(None, True, 50.0, 90.0), (999, True, 50.0, 90.0), (5000, False, 50.0, 90.0), (5000, True, 29.9, 90.0), (5000, True, 30.0, 49.9), (5000, True, 30.0, None), (5000, True, 30.0, 50.0)]
    df = spark.createDataFrame(rows, "n long, ok boolean, m double, v double")
    assert [r[0] for r in df.select(levels.quality_flag(F.col("n"), F.col("ok"), F.col("m"), F.col("v"))).collect()] == ["corrupted"] * 3 + ["dark", "cloudy", "cloudy", "usable"]


def test_triage_cases(spark):
    def run(flags, predictions):
        i = spark.createDataFrame([(f"i{k}", f) for k, f in enumerate(flags)], "filename string, quality_flag string")
        p = spark.createDataFrame([(f"i{k}", y) for k, y in enumerate(predictions)], "filename string, weather_label int")
        r = evaluate.triage_f1(i, p).first()
        return r and (r.f1_macro, r.f1_volcanic, r.f1_weather)

    assert run(["dark"] * 3, [1, 1, 0][:2] + [1]) == (0.5, 1.0, 0.0)
    assert run(["dark", "dark", "cloudy", "cloudy"], [1, 1, 0, 0]) == (1.0, 1.0, 1.0)
    assert run(["cloudy", "cloudy"], [0, 0]) == (0.5, 0.0, 1.0)
    assert run(["usable"], [0]) is None
    macro, v, w = run(["dark", "cloudy", "dark", "cloudy"], [1, 1, 0, 0])
    assert macro == (v + w) / 2 == 0.5


def test_ranked_stats_with_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.7, 1), (0.7, 0), (0.7, 0), (0.1, 0), (None, 1)], "s double, y int")
    r = evaluate.ranked_stats(df, "s", "y").first()
    assert (r.n_pos, r.n_neg) == (2, 4)
    assert r.auc_pr == pytest.approx(0.5 * 1 / 3 + 0.5 * 2 / 5)
    pairs = [(a > b) + 0.5 * (a == b) for a in (0.5, 0.7) for b in (0.5, 0.7, 0.7, 0.1)]
    assert r.u == sum(pairs) and r.auc_roc == pytest.approx(sum(pairs) / 8)


def test_exact_tail():
    for n1, n2 in ((3, 4), (5, 5), (2, 7)):
        for u in (0, 3, n1 * n2 // 2, n1 * n2):
            hits = total = 0
            for pick in itertools.combinations(range(n1 + n2), n1):
                rest = [x for x in range(n1 + n2) if x not in pick]
                hits += sum(a > b for a in pick for b in rest) >= u
                total += 1
            assert evaluate.exact_tail(u, n1, n2) == pytest.approx(hits / total)


def test_mann_whitney(spark):
    df = spark.createDataFrame([(float(i), int(i > 6)) for i in range(12)], "s double, y int")
    r = evaluate.mann_whitney(df, "s", "y").first()
    assert r.effect_size == 1 and r.p_value == pytest.approx(1 / math.comb(12, 5))
    assert evaluate.mann_whitney(df.filter("s < 9"), "s", "y").count() == 0


def test_window_edges_of_precursors(spark):
    rows = [(1, 2024, 1, 7, 0, 0, 0, 9.0), (2, 2024, 1, 10, 0, 0, 0, 50.0), (3, 2024, 1, 6, 23, 59, 59, 70.0), (4, 2024, 1, 9, 12, 0, 0, 3.0), (5, 2024, 3, 1, 8, 0, 0, 4.0)]
    index = spark.createDataFrame(rows, "image_id long, year int, month int, day int, hour int, minute int, second int, patchcore_score double").withColumn("quality_flag", F.lit("usable"))
    events = spark.createDataFrame([("2024-01-10", "a", "b")], "event_date string, event_type string, event_intensity string").withColumn("event_date", F.to_date("event_date"))
    got = {r.lead_days: r for r in evaluate.precursors(index, events).collect()}
    assert got[3].n_images == 2 and got[3].max_score == 9.0 and got[7].n_images == got[14].n_images == 3
    assert got[3].background_score == 3.5


def as_pixels(spark, *images):
    return spark.createDataFrame([(k, x, y, float(v)) for k, img in enumerate(images) for y, r in enumerate(img) for x, v in enumerate(r)], "image_id long, x int, y int, v double")


def test_kernels_agree(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((9, 10)), rng.random((9, 10))
    px = as_pixels(spark, a, b)
    both = pixels.frame_pairs(px, spark.createDataFrame([(1, 0)], "image_id long, prev_id long"))
    assert pixels.ssim(both).first().ssim_distance == pytest.approx(kernels.ssim_distance(b, a))
    assert pixels.ssim(pixels.frame_pairs(px, spark.createDataFrame([(1, 1)], "image_id long, prev_id long"))).first().ssim_distance == pytest.approx(0)
    v = kernels.vector(b, a)
    one = lambda df, c: {r.image_id: r[c] for r in df.collect()}[1]
    assert one(pixels.thermal_gradient(px), "thermal_gradient") == pytest.approx(v["thermal_gradient"])
    assert one(pixels.texture_roughness(px), "texture_roughness") == pytest.approx(v["texture_roughness"])
    assert one(pixels.edge_density(px), "edge_density") == v["edge_density"] == 0
    assert one(pixels.bright_share(px, 200, 180), "above_200") == pytest.approx(v["bright_pixel_ratio"])
    assert one(pixels.mad(both), "mad") == pytest.approx(v["pixel_diff_mean"])
    assert one(pixels.mad(both), "temporal_change") == pytest.approx(v["temporal_change_score"])


def test_constant_image(spark):
    px = as_pixels(spark, np.full((8, 8), 0.4))
    assert pixels.entropy(px).first().entropy == pytest.approx(0)
    assert pixels.normalised(px).agg(F.max("norm")).first()[0] == 0
    assert kernels.ssim_distance(np.full((8, 8), 0.4), np.full((8, 8), 0.4)) == pytest.approx(0)


def test_images_from_files(spark, tmp_path):
    folder = tmp_path / "2024" / "03"
    folder.mkdir(parents=True)
    gray = np.arange(64).reshape(8, 8)
    (folder / "gray.png").write_bytes(png(gray))
    (folder / "rgb.png").write_bytes(png(np.stack([gray, gray * 2, gray * 3], axis=2), rgb=True))
    (folder / "bad.png").write_bytes(b"xx")
    got = {r.path.rsplit("/", 1)[1]: r for r in catalog_files.read_images(spark, str(tmp_path)).collect()}
    assert got["bad.png"].pixels is None and got["gray.png"].pixels == [float(x) for x in range(64)]
    assert got["rgb.png"].pixels[5] == pytest.approx(0.299 * 5 + 0.587 * 10 + 0.114 * 15)
    audit = {r.path.rsplit("/", 1)[1]: r.valid for r in catalog_files.audit_images(spark, str(tmp_path), min_bytes=10).collect()}
    assert audit == {"gray.png": True, "rgb.png": True, "bad.png": False}
    files = catalog_files.list_files(spark, str(tmp_path))
    assert [(r.year, r.month, r.n) for r in catalog_files.discover_months(files).collect()] == [(2024, 3, 3)]
    ready = {r.path.rsplit("/", 1)[1]: r for r in kernels.preprocess(catalog_files.read_images(spark, str(tmp_path)), 4).collect()}
    assert ready["bad.png"].error and len(ready["gray.png"].pixels) == 16 and ready["gray.png"].pixels[0] == 0 and ready["gray.png"].pixels[-1] == 255


def test_frame_pairs(spark):
    rows = [(1, "a", "2024-01-01 00:00:00", True), (2, "a", "2024-01-01 00:10:00", False), (3, "a", "2024-01-01 00:30:00", True), (4, "a", "2024-01-01 00:51:00", True), (5, "b", "2024-01-01 00:31:00", True)]
    df = spark.createDataFrame(rows, "image_id long, camera string, at string, readable boolean").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df = df.withColumns({"year": F.year("at"), "month": F.month("at"), "day": F.dayofmonth("at"), "hour": F.hour("at"), "minute": F.minute("at"), "filename": F.lit("f")})
    assert {r.image_id: r.prev_id for r in pixels.previous_in_gap(df).collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}
    assert {r.image_id: r.prev_id for r in pixels.previous_in_month(df).collect()} == {1: None, 3: 1, 4: 3, 5: None}


def test_clusters(spark):
    cells = [("g", r, c, 1.0 if (r, c) in {(0, 0), (1, 1), (3, 3), (3, 4), (4, 3), (4, 4)} else 0.0) for r in range(6) for c in range(6)]
    got = nearest.clusters(spark.createDataFrame(cells, "k string, row int, col int, value double"), "k").collect()
    assert [(r.size, r.row_min, r.row_max, r.col_min, r.col_max, r.centroid_row) for r in got] == [(4, 3, 4, 3, 4, 3.5)]


def test_distances_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q, c = rng.random((40, 5)), rng.random((30, 5))
    make = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "i long, features array<float>")
    want = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2)).min(axis=1)
    for most in (10**8, 200):  # one block, several blocks
        monkeypatch.setattr(nearest, "BLOCK_BYTES", most)
        got = {r.i: r.distance for r in nearest.distances(make(q), make(c), ["i"], 5).collect()}
        assert np.allclose([got[i] for i in range(40)], want, atol=1e-5)
    assert nearest.distances(make(q), make(c).limit(0), ["i"], 5).filter("distance is null").count() == 40


def test_equal_values_and_similar_groups(spark):
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert {(r.g, r.bin, r.n, r.density) for r in report.histogram(same, "v", 5, ["g"]).collect()} == {("a", 4, 1, None), ("b", 4, 2, None)}
    rng = np.random.default_rng(9)
    x, g = rng.normal(size=(60, 5)), ["abc"[i % 3] for i in range(60)]
    x[7] = 0
    got = {(r.a_group, r.b_group): (r.pairs, r.similarity) for r in catalog.similar_groups(spark.createDataFrame([(k, [float(v) for v in row]) for k, row in zip(g, x, strict=True)] + [("d", [1.0] * 5)], "g string, f array<double>"), "g", "f").collect()}
    u = np.delete(x, 7, axis=0) / np.linalg.norm(np.delete(x, 7, axis=0), axis=1)[:, None]
    of = [k for i, k in enumerate(g) if i != 7]
    for a, b in itertools.combinations_with_replacement("abc", 2):
        pairs = [u[i] @ u[j] for i in range(59) for j in range(59) if of[i] == a and of[j] == b and (a != b or i < j)]
        assert got[a, b][0] == len(pairs) and got[a, b][1] == pytest.approx(np.mean(pairs))
    assert ("d", "d") not in got and got["a", "d"][0] == sum(k == "a" for k in of)


def test_inversion_advice(spark):
    rows = [(float(i), int(i < 10)) for i in range(40)]
    got = evaluate.inversion(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert (got.auc_roc, got.auc_roc_inverted, got.auc_pr_inverted, got.advice, got.invert, got.above_random) == (0, 1, 1, "invert", True, False)
    assert evaluate.inversion(spark.createDataFrame([(-s, y) for s, y in rows], "s double, y int"), "s", "y").first().advice == "keep"
    line = evaluate.pr_curves(spark.createDataFrame(rows, "s double, y int").withColumn("z", F.lit(1.0)), ["s", "z"], "y")
    assert {(r.precision, r.recall) for r in line.filter("detector = 'random'").collect()} == {(0.25, 0.0), (0.25, 1.0)} and line.filter("detector = 'z'").count() == 1


def test_damaged_files_are_rows(spark, tmp_path):
    """A PNG file cut at every length, one with a filter that does not exist, and a JPEG file, by both readers."""
    gray = np.arange(64).reshape(8, 8)
    whole = kernels.png_of(gray)
    wrong = whole[:33] + (lambda body: struct.pack(">I4s", len(body), b"IDAT") + body + b"0000")(zlib.compress(b"".join(bytes([5, *row]) for row in gray.tolist())))
    rows = [(f"x/{n}.png", whole[:n]) for n in range(len(whole) + 1)] + [("x/wrong.png", wrong)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in catalog_files.decoded(frame).collect()}
    assert len(got) == len(rows) and got[f"x/{len(whole)}.png"].error is None and got["x/wrong.png"].error and got["x/20.png"].error
    assert all((r.pixels is None) == (r.error is not None) for r in got.values())
    folder = str(tmp_path / "images")
    assert catalog_files.write_files(frame, folder).agg(F.sum("length")).first()[0] == sum(len(c) for _, c in rows)
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 12, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(16):
        for y in range(12):
            picture.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{folder}/x/photo.jpg"))
    seen = {r.path.rsplit("/", 1)[1]: r for r in catalog_files.read_images(spark, folder).collect()}
    assert seen["photo.jpg"].width == 16 and seen["photo.jpg"].height == 12 and abs(np.mean(seen["photo.jpg"].pixels) - (0.299 * 200 + 0.587 * 100 + 0.114 * 50)) < 3
    assert seen[f"{len(whole)}.png"].pixels == [float(v) for v in range(64)] and seen["20.png"].pixels is None and len(seen) == len(rows)  # Spark lists no file without bytes
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in catalog_files.audit_images(spark, folder, 40).collect()}
    assert reasons["20.png"] == "short" and reasons["60.png"] == "damaged" and reasons["photo.jpg"] is None and len(reasons) == len(rows)


def test_kernel_features_separate_a_ring(spark, tmp_path):
    """Linear models cannot tell the middle of a ring from it; those on Fourier features can, also after saving. Classes of unlike size count alike."""
    rng = np.random.default_rng(8)
    turn, far = rng.uniform(0, 2 * np.pi, 400), np.where(np.arange(400) % 5 == 0, rng.uniform(0, 0.8, 400), rng.uniform(1.6, 2.4, 400))
    rows = [(i, float(r * np.cos(t)), float(r * np.sin(t)), float(i % 5 == 0)) for i, (t, r) in enumerate(zip(turn, far, strict=True))]
    df = models.balanced(models.assembled(spark.createDataFrame(rows, "image_id long, x double, y double, label double"), ["x", "y"]), "label")
    assert df.groupBy("label").agg(F.sum("weight").alias("w")).select(F.round("w")).distinct().count() == 1
    candidates = {n: e for n, e in models.weather_candidates(20, "weight").items() if n in ("linear_1", "kernel_10", "forest")}
    scores = models.competed(df, "image_id", candidates, k=3)
    assert scores["linear_1"][0] < 0.7 and scores["kernel_10"][0] > 0.95 and models.winner(scores) == "kernel_10"
    fitted = candidates["kernel_10"].fit(df)
    models.save(fitted, str(tmp_path / "ring"))
    one, two = (m.transform(df).orderBy("image_id").select("prediction").collect() for m in (fitted, models.load(str(tmp_path / "ring"))))
    assert one == two
    forest = candidates["forest"].fit(df)
    votes = forest.transform(df).select("features", "probability", "prediction").limit(40).collect()
    for r in votes:  # the forest's probabilities are the mean of its trees', its class the larger
        mean = np.mean([t.predictProbability(r.features).toArray() for t in forest.stages[-1].trees], axis=0)
        assert np.allclose(mean, r.probability.toArray()) and r.prediction == mean.argmax()


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "i long, features array<double>")


def clustered(rng, centres, n, dims=8):
    return (rng.normal(size=(centres, dims)) * 20)[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def test_pivots_leave_few_cells(spark, monkeypatch):
    """Equal to all distances at two sizes, with as many meetings for each query at ten times the data."""
    asked = []
    monkeypatch.setattr(nearest, "met_in_cells", lambda a, *rest, was=nearest.met_in_cells: asked.append(a.count()) or was(a, *rest))
    per_query = []
    for n in (300, 3000):
        rng = np.random.default_rng(4)
        x = clustered(rng, n // 30, 2 * n)
        q, c = np.r_[x[:n], rng.normal(size=(5, 8)) * 100], np.r_[x[n:], x[n : n + 7]]
        asked.clear()
        got = {r.i: r.distance for r in nearest.distances(vectors_of(spark, q), vectors_of(spark, c), ["i"], 8).collect()}
        want = [np.sqrt(((c - v) ** 2).sum(axis=1)).min() for v in q]
        assert np.allclose([got[i] for i in range(len(q))], want, atol=1e-5)
        per_query.append(sum(asked) / len(q))
    assert per_query[1] <= 1.2 * per_query[0] and per_query[1] < 4


def test_projections_find_most_neighbours(spark):
    """Recall of the approximate search, on vectors in clusters and on vectors without any."""
    rng = np.random.default_rng(5)
    for x, least in ((clustered(rng, 40, 4000), 0.95), (rng.normal(size=(4000, 16)), 0.9)):
        q, c = x[:400], x[400:]
        got = {r.i: r.distance for r in nearest.probed(vectors_of(spark, q), vectors_of(spark, c), ["i"], x.shape[1]).collect()}
        want = np.array([np.sqrt(((c - v) ** 2).sum(axis=1)).min() for v in q])
        found = np.array([got[i] for i in range(400)])
        assert (found >= want - 1e-6).all() and (found <= want + 1e-6).mean() >= least


def test_greedy_coreset_covers(spark):
    """Its covering radius is at most twice that of a plain greedy run, and below that of a sample by hash."""
    rng = np.random.default_rng(6)
    x = np.r_[clustered(rng, 30, 1800), rng.normal(size=(60, 8)) * 60]
    df = vectors_of(spark, x)
    cover = lambda ids: nearest.gaps(x, x[list(ids)]).min(axis=1).max()
    taken = [r.i for r in nearest.greedy_coreset(df, "i", 0.1, 50, piece=200).collect()]
    left, plain = nearest.gaps(x, x[:1])[:, 0], [0]
    while len(plain) < 186:
        plain.append(int(left.argmax()))
        left = np.minimum(left, nearest.gaps(x, x[plain[-1:]])[:, 0])
    assert len(taken) == len(set(taken)) == 186
    assert cover(taken) <= 2 * cover(plain) and cover(taken) < cover(r.i for r in sample.coreset(df, "i", 0.1, 50).collect())
    same = vectors_of(spark, np.ones((40, 3)))
    assert nearest.greedy_coreset(same, "i", 0.1, 50).count() == 40 and nearest.greedy_coreset(same.limit(0), "i").count() == 0 and nearest.greedy_coreset(same, "i", 0.1, 1).count() >= 4


def test_samples_and_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).alias("night"))
    split = {r["split"] + str(r.night): r["count"] for r in sample.train_val(df, "night", "k", 0.1).groupBy("split", "night").count().collect()}
    assert split == {"valFalse": 90, "trainFalse": 810, "valTrue": 10, "trainTrue": 90}
    assert sample.stratified(df, "night", "k", 7).count() == 14 and sample.coreset(df, "k").count() == 500


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double").withColumn("g", F.lit(1))
    got = {r.bin: r.n for r in report.histogram(df, "v", 5, ["g"]).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in np.round(rng.exponential(size=3000), 2)] + [("b", 1.5), ("b", None), (None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.0, "q": 0.1, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r.k: r for r in quantiles.quantiles(df, "v", ["k"], wanted).collect()}
    assert set(got) == {"a", "b", None} and got["b"].mid == 1.5 and got[None].mid == 3.0
    for n, q in wanted.items():
        assert got["a"][n] == pytest.approx(np.quantile([v for k, v in rows if k == "a"], q))
    assert quantiles.quantiles(df, "v", [], {"q": 0.5}).count() == 1


def test_frechet_distance(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 3))
    rows = [(0, [float(x) for x in v]) for v in a] + [(1, [float(x) + 2 for x in v]) for v in a]
    d = models.frechet_distance(spark.createDataFrame(rows, "g int, v array<double>"), "v", "g").first().distance
    assert d == pytest.approx(12, abs=0.01)
    assert math.isinf(models.frechet_distance(spark.createDataFrame(rows[:301], "g int, v array<double>"), "v", "g").first().distance)


def test_forest_separates(spark):
    df = spark.range(200).select("id", (F.col("id") / 200).alias("a"), F.when(F.col("id") < 100, "low").otherwise("high").alias("c"))
    fitted = models.volcano_fit(df, "c", ["a"], trees=10)
    assert models.volcano_predict(fitted, df, ["a"], ["c"]).filter("c <> volcano_class").count() <= 2
    assert models.volcano_fit(df.filter("c = 'low'"), "c", ["a"]) is None


def test_streams(spark, tmp_path):
    rows = [("u1", "a", 2024, 1, 1), ("u1", "b", 2024, 1, 2), ("u2", None, 2024, 2, 1)]
    df = spark.createDataFrame(rows, "url string, quality_flag string, year int, month int, arrival int")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new arrives the second time
        ingest.ingest(ingest.arrivals(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.url, r.quality_flag) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [("u1", "b"), ("u2", None)]
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-01 09:00:00", 5.0)], "camera string, t string, patchcore_score double").withColumn("taken_at", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "ev"))
    hourly = ingest.hourly_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    query = hourly.writeStream.outputMode("append").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.mean_score) for r in spark.sql("select * from hourly").collect()] == [(2, 2.0)]


def test_image_links(spark):
    page = '<img src="thumbnails/ech_kalor_1.jpg"><img src="/logo.png"><A class=x HREF=\'http://x/y.html\'>t</a><img src="http://z/a.JPG?s=1"><img src="http://z/kalor_arrow.png"><a href="html_images/kalor_2.html"><a href="file:///C|/u/2020_04/html_images/kalor_3.html"><a href="file:///C|/u/2020_04/html_images/other_3.html"><img src="http://z/kalor_4.png">'
    df = spark.createDataFrame([(1, "http://h.org/2024_01/2024_jan.html?x=1", 2024, 1, page), (2, "http://h.org/p", 2024, 1, None)], "page_id long, url string, year int, month int, html string")
    links = [r.link for r in select.links(df, "img", "src").collect()]
    assert links == ["http://h.org/2024_01/thumbnails/ech_kalor_1.jpg", "http://h.org/logo.png", "http://z/a.JPG?s=1", "http://z/kalor_arrow.png", "http://z/kalor_4.png"]
    assert [r.link for r in select.links(df, "a", "href").collect()][0] == "http://x/y.html"
    seen = spark.createDataFrame([(x,) for x in links], "link string").select(names.is_image_url(F.col("link")), names.rewritten(F.col("link"), "http://b", F.lit(2024), F.lit(1)), names.is_decoration(F.col("link")))
    assert [tuple(r) for r in seen.collect()] == [(True, "http://b/2024_01/html_images/ech_kalor_1.jpg", False), (False, links[1], False), (True, links[2], False), (True, links[3], True), (True, links[4], False)]
    full = {r.link for r in select.image_links(df, "http://b", "kalor").collect()}
    assert full == {"http://b/2024_01/html_images/ech_kalor_1.jpg", "http://h.org/2024_01/html_images/ech_kalor_2.jpg", "http://b/2020_04/html_images/ech_kalor_3.jpg", "http://z/kalor_4.png"}


def scored_index(spark, rows):
    """rows of (day, hour, flag, score) in January 2024."""
    schema = "image_id long, year int, month int, day int, hour int, minute int, second int, quality_flag string, patchcore_score double"
    return spark.createDataFrame([(i, 2024, 1, d, h, 0, 0, q, s) for i, (d, h, q, s) in enumerate(rows)], schema)


def test_precursors_take_usable_images_only(spark):
    rows = [(d, 12, "usable", 10.0) for d in range(1, 15)] + [(9, 12, "dark", 99.0), (9, 13, "cloudy", 98.0), (8, 2, None, 97.0)]
    events = spark.createDataFrame([("2024-01-10", "x", "y")], "event_date string, event_type string, event_intensity string").withColumn("event_date", F.to_date("event_date"))
    index = scored_index(spark, rows)
    found = evaluate.precursors(index, events)
    got = {r.lead_days: (r.n_images, r.max_score, r.q90_score, r.ratio, r.triggered) for r in found.collect()}
    assert got == {3: (3, 10.0, 10.0, 1.0, False), 7: (7, 10.0, 10.0, 1.0, False), 14: (9, 10.0, 10.0, 1.0, False)}
    assert {(r.threshold, r.n_triggers) for r in evaluate.threshold_analysis(found).collect()} == {(1.0, 1), (1.1, 0), (1.2, 0), (1.3, 0), (1.4, 0), (1.5, 0)}
    test = evaluate.permutation_test(index, found).first()
    assert (test.observed_mean, test.null_mean, test.p_value) == (10.0, 10.0, 1.0)  # other flags are no part of what is drawn from
    assert evaluate.permutation_test(scored_index(spark, rows[:9]), found).count() == 0  # too few usable rows


def test_categories_of_usable_images(spark):
    df = spark.createDataFrame([(1, 12, "usable", None), (2, 12, "dark", 0.0), (3, 2, "usable", None), (4, 19, "usable", 0.2), (5, 12, None, 0.5)], "image_id long, hour int, quality_flag string, anomaly_score double")
    assert {(r.image_id, r.category) for r in select.categories(df).collect()} == {(1, "day_calm"), (3, "night_calm"), (4, "night_active"), (4, "dusk")}


def test_unknown_flags(spark):
    rows = [("unknown", 10.0, None, False), ("", 40.0, None, True), (None, 40.0, 60.0, True), ("unknown", None, 5.0, True), ("corrupted", 10.0, 1.0, False)]
    df = spark.createDataFrame(rows, "quality_flag string, mean_brightness double, variance double, is_night boolean")
    assert [tuple(r) for r in catalog.fix_unknown_flags(df).select("quality_flag", "is_night", "fixed").collect()] == [("dark", True, True), ("cloudy", False, True), ("usable", False, True), ("unknown", True, False), ("corrupted", False, False)]


def test_nearest_month_and_pairs(spark):
    points = spark.createDataFrame([("2024-03-10",), ("2024-03-31",)], "at string").select(F.to_date("at").alias("at"))
    rows = spark.createDataFrame([("a", "2024-03-01", 5.0), ("a", "2024-04-01", 7.0), ("b", "2023-01-01", 1.0)], "g string, m string, s double").withColumn("m", F.to_date("m"))
    assert {(str(r["at"]), r.g, r.s) for r in catalog.nearest_in_time(points, "at", rows, "m", ["g"]).collect()} == {("2024-03-10", "a", 5.0), ("2024-03-31", "a", 7.0), ("2024-03-10", "b", 1.0), ("2024-03-31", "b", 1.0)}
    rng = np.random.default_rng(5)
    values = [(g, i, float(np.round(rng.random(), 1))) for g in "abc" for i in range({"a": 7, "b": 12, "c": 1}[g])]
    want = {}
    for (g, i, v), (h, j, w) in itertools.combinations(values, 2):
        want.setdefault((min(g, h), max(g, h)), []).append(abs(v - w))
    got = {(r.a_group, r.b_group): (r.pairs, r.mean_difference) for r in catalog.pairwise(spark.createDataFrame(values, "g string, i long, v double"), "g", "i", "v").collect()}
    assert {k: len(v) for k, v in want.items()} == {k: n for k, (n, _) in got.items()} and all(got[k][1] == pytest.approx(np.mean(v)) for k, v in want.items())


def test_clusters_take_cells_at_the_threshold(spark):
    cells = [(1, r, c, 0.5 if (r, c) in {(0, 0), (0, 1)} else 0.9 if (r, c) in {(2, 2), (3, 2)} else 0.49) for r in range(4) for c in range(4)]
    got = [(r.rank, r["size"], r.score) for r in nearest.clusters(spark.createDataFrame(cells, "g long, row int, col int, value double"), "g", 0.5).orderBy("rank").collect()]
    assert got == [(1, 2, pytest.approx(0.9)), (2, 2, pytest.approx(0.5))]


def test_png_files_round_trip(spark):
    rng = np.random.default_rng(3)
    gray, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 6, 3))
    assert (kernels.gray_of_png(kernels.png_of(gray)) == gray).all()
    assert np.allclose(kernels.gray_of_png(kernels.png_of(colour)), colour @ [0.299, 0.587, 0.114])
    filtered = bytearray()  # the same rows as every filter would write them
    px = rng.integers(0, 256, (5, 6)).astype(int)
    for y in range(5):
        filtered.append(y)
        for x in range(6):
            a, b, c = (px[y, x - 1] if x else 0), (px[y - 1, x] if y else 0), (px[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            filtered.append((px[y, x] - [0, a, b, (a + b) // 2, near][y]) % 256)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(filtered))) + chunk(b"IEND", b"")
    assert (kernels.gray_of_png(data) == px).all()
    files = [("a", kernels.png_of(gray)), ("b", data[:40]), ("c", b""), ("d", None)]
    got = {r.path: (r.width, r.error is None) for r in catalog_files.decoded(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a": (7, True), "b": (None, False), "c": (None, False), "d": (None, False)}


def test_pair_scores_match_the_relational_kernels(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random((9, 8)), rng.random((9, 8))
    frames = spark.createDataFrame([(1, 8, a.ravel().tolist(), b.ravel().tolist()), (2, 8, b.ravel().tolist(), None)], "image_id long, width int, pixels array<double>, before array<double>")
    got = {r.image_id: r for r in kernels.pair_scores(frames, ["image_id"]).collect()}
    px = spark.createDataFrame([(i, x, y, float(m[y, x])) for i, m in ((1, a), (2, b)) for y in range(9) for x in range(8)], "image_id long, x int, y int, v double")
    both = pixels.frame_pairs(px, spark.createDataFrame([(1, 2)], "image_id long, prev_id long"))
    m, s = pixels.mad(both).first(), pixels.ssim(both).first()
    assert (got[1].mad, got[1].most, got[1].p95, got[1].temporal_change, got[1].ssim_distance) == pytest.approx((m.mad, m.most, m.p95, m.temporal_change, s.ssim_distance))
    assert got[2].mad is None and got[2].night_score == 0.0


def test_pca_and_folds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    out = models.pca_2d(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "v", ["i"]).orderBy("i").collect()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([[r.x, r.y] for r in out]), np.abs(u[:, :2] * s[:2])) and (out[0].explained_x, out[0].explained_y) == pytest.approx(tuple((s**2 / (s**2).sum())[:2]))
    f = models.folds(spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y")), "y", "id", 5).groupBy("y", "fold").count().collect()
    sizes = {y: [r["count"] for r in f if r.y == y] for y in (0, 1)}
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())


def test_probabilities_of_classes(spark):
    df = spark.createDataFrame([(i, float(i % 2), ["lave", "normal"][i % 2]) for i in range(60)], "image_id long, f double, class string")
    fitted = models.volcano_fit(df, "class", ["f"], trees=5)
    rows = models.volcano_proba(fitted, df, ["f"], ["image_id"], ["lave", "nuage", "normal"]).collect()
    assert all(r.p_nuage == 0 and r.p_lave + r.p_normal == pytest.approx(1) and (r.volcano_class == "lave") == (r.image_id % 2 == 0) for r in rows)
    rules = models.volcano_proba(None, df, [], ["image_id"], ["lave", "nuage", "normal"]).filter("image_id = 3").first()
    assert (rules.volcano_class, rules.class_confidence, rules.p_lave, rules.p_normal) == ("normal", 1.0, 0.0, 1.0)


def test_saved_model_predicts_the_same(spark, tmp_path):
    rows = models.assembled(spark.createDataFrame([(i, float(i % 9), i % 2) for i in range(80)], "image_id long, f double, label int"), ["f"]).withColumn("label", F.col("label").cast("double"))
    model = models.weather_candidates()["linear_1"].fit(rows)
    models.save(model, str(tmp_path / "m"))
    one, two = (models.weather_predict(m, rows, ["image_id"]).orderBy("image_id").collect() for m in (model, models.load(str(tmp_path / "m"))))
    assert one == two


def test_safe_read(spark, tmp_path):
    assert catalog_files.read_index(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "i.csv").write_text("url,year,is_night,downloaded,anomaly_score\nu,2014.0,True,false,nan\n")
    r = catalog_files.read_index(spark, str(tmp_path / "i.csv")).first()
    assert (r.url, r.year, r.is_night, r.downloaded, r.anomaly_score, r.notes) == ("u", 2014, True, False, None, None)


def test_nearest_in_time_matches_all_pairs(spark):
    """Both sides of several partitions, ties to the earlier, rows of a day to the smallest, null times and groups."""
    rng = np.random.default_rng(3)
    day = lambda n: None if n < 0 else f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    rows = [(None if g == 3 else f"g{g}", day(int(n)), float(s)) for g, n, s in zip(rng.integers(0, 4, 90), rng.integers(-4, 330, 90), rng.integers(0, 5, 90))]
    rows += [("late", day(300), 1.0), ("tie", day(100), 1.0), ("tie", day(104), 2.0), ("tie", day(104), 1.5), ("never", None, 1.0)]
    points = [(day(n),) for n in (-1, 0, 56, 102, 102, 200, 329)]
    df = spark.createDataFrame(rows, "g string, m string, s double").withColumn("m", F.to_date("m")).repartition(5)
    at = spark.createDataFrame(points, "at string").withColumn("at", F.to_date("at"))
    out = catalog.nearest_in_time(at, "at", df, "m", ["g"])
    want = set()
    for p in {r["at"] for r in at.collect()} - {None}:
        for g in {r.g for r in df.collect()} - {"never"}:
            want.add((p, g, *min((abs((p - r.m).days), r.m, r.s) for r in df.collect() if r.g == g and r.m)[1:]))
    assert sorted(map(str, out.select("at", "g", "m", "s").collect())) == sorted(str(out.sparkSession.createDataFrame([w], out.schema).first()) for w in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert catalog.nearest_in_time(at, "at", df.filter("false"), "m", ["g"]).count() == 0
    assert catalog.nearest_in_time(at.filter("false"), "at", df, "m", ["g"]).count() == 0


@pytest.mark.parametrize(("m", "total"), [(12, 12), (30, 101), (7, 1009), (40, 5000)])
def test_draws_are_random_subsets(spark, m, total):
    """Every run draws m different rows, every row as often as any other, and two runs share as many as chance has it."""
    runs = 400
    of = {}
    for r in evaluate.drawn(spark, runs, m, total).collect():
        of.setdefault(r.run, []).append(r["at"])
    assert len(of) == runs and all(len(set(x)) == len(x) == m and 0 <= min(x) and max(x) < total for x in of.values())
    counts = np.bincount([x for v in of.values() for x in v], minlength=total)
    expected = runs * m / total
    assert m == total or ((counts - expected) ** 2).sum() / expected / (1 - m / total) == pytest.approx(total, abs=6 * math.sqrt(2 * total))
    shared = np.mean([len(set(of[i]) & set(of[i + 1])) for i in range(runs - 1)])
    assert shared == pytest.approx(m * m / total, rel=0.1, abs=0.05)


def test_permutations_have_the_deviation_of_a_finite_population(spark):
    values = np.random.default_rng(5).gamma(2, 10, 700)
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "image_id long, patchcore_score double").withColumn("quality_flag", F.lit("usable"))
    found = spark.createDataFrame([(7, 25.0)] * 10, "lead_days int, q90_score double")
    test = evaluate.permutation_test(df, found).first()
    m, n = 140, len(values)
    deviation = math.sqrt(values.var() / m * (n - m) / (n - 1))
    assert test.null_mean == pytest.approx(values.mean(), abs=4 * deviation / math.sqrt(1000))
    assert test.null_std == pytest.approx(deviation, rel=0.1)


def test_ranks_and_positions_in_range_partitions(spark):
    """As windows over whole groups give them, with nulls, ties and a group that holds most rows."""
    rng = np.random.default_rng(8)
    rows = [(i, None if g > 8 else "hot" if g > 2 else f"g{g}", None if s > 18 else float(s)) for i, (g, s) in enumerate(zip(rng.integers(0, 10, 600), rng.integers(0, 20, 600)))]
    df = spark.createDataFrame(rows, "id long, g string, s double").repartition(6)
    ranked = {(r.id, r["rank"]) for r in sample.rank_min(df, ["g"], "s").collect()}
    assert ranked == {(r.id, r["r"]) for r in df.selectExpr("id", "rank() over (partition by g order by s desc) as r").collect()}
    placed = {(r.id, r.at) for r in sample.positions(df, ["g"], ["s", "id"], "at").collect()}
    assert placed == {(r.id, r["r"]) for r in df.selectExpr("id", "row_number() over (partition by g order by s, id) as r").collect()}
    assert sample.rank_min(df.filter("false"), ["g"], "s").count() == sample.positions(df.filter("false"), ["g"], ["id"], "at").count() == 0


@pytest.mark.parametrize("scale", [1e-6, 1.0, 255.0])
def test_ssim_by_summed_areas(scale):
    rng = np.random.default_rng(1)
    a = (rng.random((40, 52)) + 3) * scale
    b = a + rng.normal(0, 0.1, a.shape) * scale
    means = lambda x: np.lib.stride_tricks.sliding_window_view(x, (7, 7)).mean(axis=(2, 3))
    near = lambda x, y: 49 / 48 * means((x - 3.5 * scale) * (y - 3.5 * scale)) - 49 / 48 * means(x - 3.5 * scale) * means(y - 3.5 * scale)
    spread = max(np.ptp(a), np.ptp(b))
    c1, c2 = (0.01 * spread) ** 2, (0.03 * spread) ** 2
    want = 1 - ((2 * means(a) * means(b) + c1) * (2 * near(a, b) + c2) / ((means(a) ** 2 + means(b) ** 2 + c1) * (near(a, a) + near(b, b) + c2))).mean()
    assert kernels.ssim_distance(a, b) == pytest.approx(want, rel=1e-7)


def flooded(on):
    """4-connected groups of a set of cells."""
    left, groups = set(on), []
    while left:
        todo, group = [min(left)], set()
        while todo:
            cell = todo.pop()
            if cell in left:
                left.discard(cell)
                group.add(cell)
                todo += [(cell[0] + 1, cell[1]), (cell[0] - 1, cell[1]), (cell[0], cell[1] + 1), (cell[0], cell[1] - 1)]
        groups.append(group)
    return groups


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_clusters_over_tiles(spark, tile):
    """Groups that cross many tiles, a snake through all of them, a grid without a name and one without active cells."""
    rng = np.random.default_rng(tile)
    grids = {"a": rng.random((13, 17)), "b": rng.random((13, 17)) + 0.12, None: rng.random((7, 9)), "off": np.full((4, 4), 0.1)}
    snake = np.full((11, 12), 0.0)
    snake[::2] = 0.9
    snake[1::4, -1] = snake[3::4, 0] = 0.8
    grids["snake"] = snake
    cells = [(k, r, c, float(v)) for k, g in grids.items() for (r, c), v in np.ndenumerate(g)] + [("off", 9, 9, float("nan")), ("off", 9, 8, None)]
    got = {}
    for r in nearest.clusters(spark.createDataFrame(cells, "k string, row int, col int, value double"), "k", 0.5, 2, tile).collect():
        got.setdefault(r.k, {})[r["rank"]] = (r["size"], r.row_min, r.row_max, r.col_min, r.col_max, r.centroid_row, r.centroid_col, r.score)
    assert set(got) == {"a", "b", None, "snake"}
    for k, found in got.items():
        g = grids[k]
        groups = [x for x in flooded(zip(*(i.tolist() for i in np.nonzero(g >= 0.5)), strict=True)) if len(x) >= 2]
        groups.sort(key=lambda x: (-np.mean([g[i] for i in x]), min(x)))
        of = lambda x: (len(x), min(r for r, _ in x), max(r for r, _ in x), min(c for _, c in x), max(c for _, c in x), np.mean([r for r, _ in x]), np.mean([c for _, c in x]), np.mean([g[i] for i in x]))  # noqa: B023, E731
        assert sorted(found) == list(range(1, len(groups) + 1))
        assert all(found[i + 1] == pytest.approx(of(x)) for i, x in enumerate(groups))
    assert len(got["snake"]) == 1


def test_heatmap_of_maxima(spark):
    rng = np.random.default_rng(8)
    names = ["thermal_gradient", "edge_density", "bright_zone_area", "bright_pixel_ratio"]
    rows = [(["x", "y", None][i % 3], i % 2, *[None if rng.random() < 0.1 else float(v) for v in rng.random(4)], [None, 0.0, float(rng.normal())][min(2, i % 7)]) for i in range(90)]
    df = spark.createDataFrame(rows, "camera string, year int, " + ", ".join(f"{n} double" for n in names) + ", s double")
    got = {(r.camera, r.year, r.row, r.col): r.max for r in nearest.heatmap_max(df.repartition(3), "s", ["camera", "year"], 5).collect()}
    used = df.filter("s <> 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(4))))
    want = used.groupBy("camera", "year", "row", "col").agg(F.max(nearest.weight(F.col("row") / 4, F.col("col") / 4) * F.col("s")).alias("v")).collect()
    top = {}
    for r in want:
        top[r.camera, r.year] = max(top.get((r.camera, r.year), -9.0), r.v)
    assert got == pytest.approx({(r.camera, r.year, r.row, r.col): r.v / top[r.camera, r.year] for r in want}) and len(got) == 6 * 25


def test_frame_stats_match_the_relational_kernels(spark):
    rng = np.random.default_rng(4)
    images = {1: rng.random((9, 7)), 2: np.full((9, 7), 0.25), 3: rng.random((9, 7)) / 12, 4: np.floor(rng.random((9, 7)) * 3) / 2}
    rows = [(i, m.ravel().tolist()) for i, m in images.items()] + [(5, None), (6, []), (7, [0.1, None])]
    frames = spark.createDataFrame(rows, "image_id long, pixels array<double>")
    got = {r.image_id: r for r in kernels.frame_stats(frames, ["image_id"], 0.5).collect()}
    px = pixels.exploded(frames.filter("image_id < 5"), "pixels", F.lit(7))
    twins = [pixels.stats(px), pixels.entropy(px), pixels.bright_share(px, 200, 180), pixels.night_score(px.withColumn("v", F.col("v") / 2)), px.groupBy("image_id").agg(F.percentile("v", F.lit(0.9)).alias("p90"))]
    gray = pixels.stats(px.withColumn("v", pixels.level(F.col("v")).cast("double"))).select("image_id", F.col("mean").alias("gray_mean"), F.col("variance").alias("gray_variance"))
    for df in (*twins, gray):
        for r in df.collect():
            assert all(got[r.image_id][c] == pytest.approx(r[c], abs=1e-9) for c in df.columns if c in kernels.STATS)
    assert all(got[i][c] is None for i in (5, 6, 7) for c in kernels.STATS)
    norm = frames.select("image_id", pixels.stretched(F.col("pixels"), F.array_min("pixels"), F.array_max("pixels")).alias("n"))
    far = {(r.image_id, r.x, r.y): r.v for r in pixels.exploded(norm.filter("image_id < 5"), "n", F.lit(7)).collect()}
    assert far == pytest.approx({(r.image_id, r.x, r.y): r.norm for r in pixels.normalised(px).collect()})


def test_edges_exist_in_the_unit_scale(spark):
    rng = np.random.default_rng(2)
    step = np.zeros((9, 10))
    step[:, 5:] = 1.0
    for img in (step, rng.random((9, 10)), np.full((9, 10), 0.5)):
        px = as_pixels(spark, img)
        v = kernels.vector(img, None, "unit")
        assert v["edge_density"] == pytest.approx(pixels.edge_density(px, scale=2.0).first().edge_density)
        assert v["thermal_gradient"] == pytest.approx(255 * pixels.thermal_gradient(px).first().thermal_gradient)
        assert v["texture_roughness"] == pytest.approx(255 * pixels.texture_roughness(px).first().texture_roughness)
    assert kernels.vector(step, None, "unit")["edge_density"] == pytest.approx(2 / 8) and kernels.vector(step, None)["edge_density"] == 0


def test_rounding_is_that_of_sql(spark):
    """41 / 640 is 0.0640625, whose double is over a half when written out and below it when scaled."""
    got = spark.createDataFrame([(41, 640), (323, 640), (1, 128), (-1, 128)], "a int, b int").select(report.r6(F.col("a") / F.col("b")).alias("r")).collect()
    want = duckdb.sql("select round(a / b, 6) from (values (0, 41, 640), (1, 323, 640), (2, 1, 128), (3, -1, 128)) v(i, a, b) order by i").fetchall()
    assert [r.r for r in got] == [w[0] for w in want] and got[0].r == 0.064062


def test_last_of_a_million_names(spark):
    names = [("train", "day", f"{i:06d}.png") for i in (999_998, 999_999, 1_000_000, 1_000_001)]
    got = catalog_files.named(spark.createDataFrame(names, "split string, period string, file_name string")).first()
    assert (got.n, got.n_names, got.last_name) == (4, 4, "1000001.png")


def test_few_distances_at_once(spark, monkeypatch):
    """On vectors without clusters, where every cell is asked, a query is sent once to a block, and no matrix of distances is larger than allowed."""
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(3000, 16)), rng.normal(size=(2500, 16))
    most, sent = [0], []
    monkeypatch.setattr(nearest, "AT_ONCE", 40_000)
    monkeypatch.setattr(nearest, "gaps", lambda x, y, was=nearest.gaps: most.append(len(x) * len(y)) or was(x, y))
    asks = [np.arange(50, dtype=np.int32)] * len(q)
    cell = rng.integers(0, 50, len(c))
    got = nearest.nearest_in_cells(q, asks, c, cell)
    assert np.allclose(got, [np.sqrt(((c - v) ** 2).sum(axis=1)).min() for v in q]) and max(most) <= 40_000
    monkeypatch.setattr(nearest, "met_in_cells", lambda a, *rest, was=nearest.met_in_cells: sent.append(a.count()) or was(a, *rest))
    out = {r.i: r.distance for r in nearest.distances(vectors_of(spark, q), vectors_of(spark, c), ["i"], 16).collect()}
    assert np.allclose([out[i] for i in range(len(q))], got, atol=1e-5) and sum(sent) <= 2 * len(q)


def test_large_month_is_several_files(spark, tmp_path):
    """No task writes a whole month."""
    rows = spark.range(20_000).select(F.col("id").alias("image_id"), F.lit(2024).alias("year"), F.when(F.col("id") < 100, 2).otherwise(1).alias("month"), (F.col("id") * 7 % 30 + 1).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"), (F.col("id") % 59).cast("int").alias("minute"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog_files.write_index(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "t"))
    sizes = [r["count"] for r in back.filter("month = 1").groupBy(F.input_file_name()).count().collect()]
    assert back.count() == 20_000 and len(sizes) > 1 and max(sizes) < 10_000


def test_competition_fits_equal_rows_once(spark, monkeypatch):
    """Scores are those of fits on all rows, but a fit takes a row for each that differs."""
    rng = np.random.default_rng(5)
    points = [(float(x), float(y), float(x + rng.normal() > 0)) for x, y in rng.normal(size=(40, 2))]
    rows = [(50 * i + c, *p) for i, p in enumerate(points) for c in range(20)]
    df = models.balanced(models.assembled(spark.createDataFrame(rows, "image_id long, x double, y double, label double"), ["x", "y"]), "label").cache()
    candidate, fits, plain = models.weather_candidates(weight="weight")["linear_1"], [], []
    fit = models.fitted
    monkeypatch.setattr(models, "fitted", lambda e, train, s: (fits.append(train.count()), fit(e, train, s))[1])
    got = models.competed(df, "image_id", {"one": candidate}, k=3)["one"]
    dealt = models.folds(df, "label", "image_id", 3).cache()
    for f in range(3):
        told = candidate.fit(dealt.filter(f"fold != {f}")).transform(dealt.filter(f"fold = {f}"))
        plain.append(models.binary_scores(told, "label", "prediction").first().f1_macro)
    assert got == pytest.approx((np.mean(plain), np.std(plain))) and len(fits) == 3 and max(fits) <= 40
    one, all_ = models.fit_all(df, "image_id", candidate).stages[-1], candidate.fit(df).stages[-1]
    assert np.allclose(one.coefficients.toArray(), all_.coefficients.toArray(), rtol=1e-3)


def test_forest_draws_equal_rows_together(spark):
    """All rows are drawn apart up to a bound; beyond it equal ones are drawn together, none is lost, and the row count follows those that differ."""
    few = models.assembled(spark.createDataFrame([(float(i), float(i % 2), 1.5 * n, n) for i, n in enumerate([1, 7, 100, 1000])], "a double, label double, weight double, rows long"), ["a"])
    for draws, most in ((1108, 1108), (100, 104)):
        out = models.drawn(few, draws)
        assert out.count() == 1108 if draws == 1108 else out.count() <= most
        weights = {r.a: r.w for r in out.groupBy("a").agg(F.sum("weight").alias("w")).collect()}
        assert weights == pytest.approx({0.0: 1.5, 1.0: 10.5, 2.0: 150, 3.0: 1500})


def test_features_of_frames_in_stacks(spark):
    """Frames of unlike shapes, with and without an earlier one, in one batch: as one by one, and a stack is one call."""
    rng = np.random.default_rng(6)
    rows = [(i, w := 8 + i % 2 * 3, rng.random(w * (6 + i % 3)).tolist(), rng.random(w * (6 + i % 3)).tolist() if i % 4 else None) for i in range(40)]
    got = {r.image_id: r for r in kernels.features(spark.createDataFrame(rows, "image_id long, width int, pixels array<double>, before array<double>").coalesce(1), "unit").collect()}
    assert len(got) == 40
    for i, w, a, b in rows:
        want = kernels.vector(np.reshape(a, (-1, w)), None if b is None else np.reshape(b, (-1, w)), "unit")
        assert all(got[i][f] == pytest.approx(want[f]) for f in kernels.FEATURES)
    stack = rng.random((50, 8, 8))
    assert np.allclose(kernels.vectors(stack, None)["lbp_entropy"], [kernels.lbp_entropy(np.floor(x * 255)) for x in stack])


def test_fits_store_no_features(spark):
    """Kernel features are made within the passes over the rows: no fit of the competition holds rows of any kind, and the models are Spark's."""
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(y), 3.0, float(x * y + rng.normal() > 0.7)) for i, (x, y) in enumerate(rng.normal(size=(900, 2)))]
    df = models.balanced(models.assembled(spark.createDataFrame(rows, "image_id long, x double, y double, same double, label double"), ["x", "y", "same"]), "label")
    candidates = {n: e for n, e in models.weather_candidates(weight="weight").items() if n in ("linear_1", "linear_50", "kernel_1", "kernel_10")}
    held, over, info = [0], threading.Event(), spark.sparkContext._jsc.sc().getRDDStorageInfo
    others = {r.id() for r in info()}  # what other tests hold

    def watch():
        while not over.wait(0.01):
            held[0] = max(held[0], sum(r.memSize() + r.diskSize() for r in info() if r.id() not in others))

    watcher = threading.Thread(target=watch)
    watcher.start()
    scores = models.competed(df, "image_id", candidates, k=3)
    fits = {n: models.fit_all(df, "image_id", e) for n, e in candidates.items()}
    over.set()
    watcher.join()
    assert held[0] == 0 and len(scores) == 4

    def loss(model, strength):
        """What a fit makes least, Spark's penalty included."""
        got = model.transform(df).select(F.col(model.stages[-1].getFeaturesCol()).alias("f"), "label", "weight").collect()
        x, y, w, b = np.array([r.f.toArray() for r in got]), np.array([r.label for r in got]), np.array([r.weight for r in got]), model.stages[-1].coefficients.toArray()
        m, spread = x @ b + model.stages[-1].intercept, np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w) / (1 - (w**2).sum() / w.sum() ** 2)
        return np.average(np.logaddexp(0, m) - y * m, weights=w) + strength * (spread * b**2).sum() / 2

    for n, e in candidates.items():
        ours, spark_s = (loss(m, e.getStages()[-1].getRegParam()) for m in (fits[n], e.fit(df)))
        assert spark_s - 0.01 < ours <= spark_s + 1e-7, n


def test_one_class_or_a_far_step(spark):
    """With one class the intercept is without bound, as in Spark; classes that a line parts are fitted as Spark does."""
    make = lambda rows: models.assembled(spark.createDataFrame(rows, "image_id long, x double, label double"), ["x"]).withColumn("weight", F.lit(1.0))
    candidate = models.weather_candidates(weight="weight")["linear_50"]
    for y in (0.0, 1.0):
        last = models.fit_all(make([(i, float(i), y) for i in range(6)]), "image_id", candidate).stages[-1]
        assert last.intercept == (np.inf if y else -np.inf) and not last.coefficients.toArray().any()
    df = make([(i, float(i - 20) ** 3, float(i > 20)) for i in range(41)])
    ours, plain = models.fit_all(df, "image_id", candidate).stages[-1], candidate.fit(df).stages[-1]
    assert ours.intercept == pytest.approx(plain.intercept, abs=1e-2) and np.allclose(ours.coefficients.toArray(), plain.coefficients.toArray(), rtol=1e-2)


def test_forest_grows_in_runs(spark, tmp_path, monkeypatch):
    """Beyond a bound of draws some trees grow at a time; they are one forest, which can be saved, and few tasks send figures for all nodes."""
    asked, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models, "AT_ONCE", 4000)
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df, params=None: asked.append(self.copy(params).getNumTrees()) or fit(self, df, params))
    df = models.balanced(models.assembled(spark.createDataFrame([(i, float(i % 10), float(i % 10 + i % 7 > 8)) for i in range(400)], "image_id long, x double, label double").withColumn("y", F.col("image_id").cast("double")), ["x", "y"]), "label")
    candidate = models.weather_candidates(33, "weight")["forest"]
    model = models.fit_all(df, "image_id", candidate)
    assert sum(asked) == 33 and len(asked) > 1 and max(asked) <= 10
    models.save(model, str(tmp_path / "forest"))
    for m in (model, models.load(str(tmp_path / "forest"))):
        trees = m.stages[-1].trees
        assert len(trees) == 33 and len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 10
        for r in m.transform(df).select("features", "label", "probability", "prediction").limit(40).collect():
            mean = np.mean([t.predictProbability(r.features).toArray() for t in trees], axis=0)
            assert np.allclose(mean, r.probability.toArray()) and r.prediction == mean.argmax()
    many = models.assembled(spark.range(300_000).select(F.col("id").cast("double").alias("a"), F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"), F.lit(1).alias("rows")), ["a"])
    assert models.drawn(many).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism

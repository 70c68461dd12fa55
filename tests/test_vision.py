"""Blur score: PNGs written here, corrupt frame -> 0.0, numpy stencil as expectation."""

import struct
import tempfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from canopy.functions.vision import add_blur_score, grey_from_bgr, laplacian_var_np
from canopy.plans.images import frames_from_files


def _png(path, pixels: np.ndarray):
    """Minimal PNG writer: 8-bit grey (2-D) or RGB (3-D) image."""
    h, w = pixels.shape[:2]
    ctype = 0 if pixels.ndim == 2 else 2
    raw = b"".join(b"\x00" + pixels[r].astype(np.uint8).tobytes() for r in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xffffffff)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_stencil_matches_explicit_loops():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 255, (5, 7)).astype(float)
    h, w = img.shape

    def ref(r):
        return 1 if r < 0 else r

    lap = np.zeros_like(img)
    for r in range(h):
        for c in range(w):
            u = img[1 if r == 0 else r - 1, c]
            d = img[h - 2 if r == h - 1 else r + 1, c]
            left = img[r, 1 if c == 0 else c - 1]
            right = img[r, w - 2 if c == w - 1 else c + 1]
            lap[r, c] = u + d + left + right - 4 * img[r, c]
    assert abs(laplacian_var_np(img) - lap.var()) < 1e-9


def test_array_expression_equals_numpy(spark):
    rng = np.random.default_rng(2)
    imgs = [rng.normal(size=(8, 8)) for _ in range(5)] + [np.zeros((8, 8))]
    df = spark.createDataFrame([(i, [float(x) for x in im.ravel()]) for i, im in enumerate(imgs)],
                               "id int, px array<double>")
    got = {r.id: r.blur_score for r in add_blur_score(df, "px", 8).collect()}
    for i, im in enumerate(imgs):
        assert abs(got[i] - laplacian_var_np(im)) < 1e-9


def test_image_files_and_corrupt_frame(spark):
    d = tempfile.mkdtemp(prefix="canopy-frames-")
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 255, (12, 16)).astype(np.uint8)
    rgb = rng.integers(0, 255, (10, 9, 3)).astype(np.uint8)
    flat = np.full((6, 6), 128, np.uint8)
    _png(f"{d}/cam1_1704067200.png", grey)
    _png(f"{d}/esp32_cam_x_1704067260.png", rgb)
    _png(f"{d}/cam1_1704067320.png", flat)
    with open(f"{d}/cam2_1704067380.jpg", "wb") as f:
        f.write(b"fake_jpeg_bytes_content")
    rows = {r.image_path: r for r in frames_from_files(spark, d).collect()}
    assert abs(rows["cam1_1704067200.png"].blur_score - laplacian_var_np(grey)) < 1e-6
    # colour frame: grey = 0.299 R + 0.587 G + 0.114 B, rounded to 8 bit
    bgr = rgb[..., ::-1].copy()
    g = grey_from_bgr(bgr.tobytes(), 10, 9, 3)
    assert abs(rows["esp32_cam_x_1704067260.png"].blur_score - laplacian_var_np(g)) < 1e-6
    assert rows["esp32_cam_x_1704067260.png"].sensor_name == "esp32_cam_x"
    assert rows["cam1_1704067320.png"].blur_score == 0.0
    bad = rows["cam2_1704067380.jpg"]
    assert bad.blur_score == 0.0 and bad.sensor_name == "cam2" and bad.timestamp == 1704067380


def test_latest_image_empty_status(spark):
    import canopy.plans.images as I
    from canopy.sources import bindings as B
    orig = B.image_frames
    try:
        B.image_frames = lambda s, d: orig(s, d).limit(0)
        r = I.latest_image(spark, "/root/testdata/sf0.001").collect()
    finally:
        B.image_frames = orig
    assert len(r) == 1 and r[0].status == "empty" and r[0].image_path is None and r[0].blur_score is None


def test_edge_frames_score_zero(spark):
    """Null, empty and one-row frames, and part rows, score 0.0 in both forms."""
    from canopy.functions.vision import add_blur_score, make_blur_pixels_udf
    rows = [(1, None), (2, []), (3, [1.0] * 8), (4, [1.0] * 20), (5, [float(i % 5) for i in range(16)])]
    df = spark.createDataFrame(rows, "id int, px array<double>")
    df = add_blur_score(df, "px", 8, "a").withColumn("b", make_blur_pixels_udf(8)(F.col("px")))
    got = {r.id: (r.a, r.b) for r in df.collect()}
    assert all(got[i] == (0.0, 0.0) for i in (1, 2, 3, 4))
    assert got[5][0] > 0 and abs(got[5][0] - got[5][1]) < 1e-9

import numpy as np

from dossier.operators import pixels as P


def page():
    a = np.full((120, 200), 240, np.uint8)
    for y in range(20, 100, 16):
        a[y : y + 6, 20:90:2] = 20
        a[y : y + 6, 120:180:2] = 20
    return a


def test_measures_tell_pages_apart():
    a, r = page(), np.random.default_rng(0)
    flat = np.full_like(a, 200)
    speckled = np.where(r.random(a.shape) < 0.1, 0, a).astype(np.uint8)
    assert P.laplacian_variance(a) > 1000 > P.laplacian_variance(flat) == 0
    assert P.noise_level(speckled) > P.noise_level(flat) == 0
    assert P.edges(a).mean() > 0.1 and not P.edges(flat).any()
    assert 20 <= P.otsu(a) < 240 and P.peaks(a) == 2
    assert P.stroke_variance(a) < 0.1
    g = np.full((50, 50), 255, np.uint8)
    g[[10, 30]], g[:, [5, 25]] = 0, 0
    assert P.grid(g) and not P.grid(a)


def test_laplacian_matches_plain():
    a = np.random.default_rng(1).integers(0, 256, (7, 9)).astype(np.uint8)
    p = np.pad(a.astype(float), 1, mode="reflect")
    plain = [[p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * p[i + 1, j + 1] for j in range(9)] for i in range(7)]
    assert np.isclose(P.laplacian_variance(a), np.var(plain))


def test_preparation_blocks_and_skew():
    a = page()
    assert P.cropped(a).shape == (70, 159)
    b = P.prepared(a)
    assert set(np.unique(b)) <= {0, 255} and b.shape == (140, 318)
    assert P.blocks(a) == [(x, y, w, 6) for y in range(20, 100, 16) for x, w in ((20, 69), (120, 59))]
    assert P.skew(a) == 0.0
    y, x = np.indices(a.shape)
    tilted = a[np.clip(np.round(y - x * np.tan(np.radians(3))).astype(int), 0, a.shape[0] - 1), x]
    assert abs(P.skew(tilted) - 3) <= 0.5


def test_dataframes(spark):
    a = page()
    rows = [(1, 200, 120, bytearray(a.tobytes())), (2, 200, 120, bytearray(np.full_like(a, 90).tobytes()))]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    got = {r.id: r for r in P.page_quality(df).collect()}
    assert got[1].sharpness == "Good" and got[2].sharpness == "Blurry" and "blurred" in got[2].warnings and got[1].orientation == "landscape"
    bad = spark.createDataFrame([(3, 10, 10, bytearray(b"x")), (4, 0, 0, None)], df.schema)
    assert [r.laplacian for r in P.measured(bad).collect()] == [None, None]
    assert P.text_blocks(df).where("id = 1").count() == 10 and P.detected(df).count() == 0
    assert P.prepare(df.limit(0)).count() == 0
    f = spark.createDataFrame([("c", 1, bytearray(b"\0\0")), ("c", 2, bytearray(b"\5\0")), ("d", 1, bytearray(b"\1"))], "cam string, n int, pixels binary")
    assert sorted((r.cam, r.n, r.diff) for r in P.frame_differences(f, "cam", "n").collect() if r.diff is not None) == [("c", 2, 5.0)]


def test_skew_of_steep_pages():
    """Tilts up to 30 degrees, on small pages and on a wide one with thin lines."""
    wide = np.full((1500, 3000), 240, np.uint8)
    for k in range(100, 1400, 60):
        wide[k : k + 12, 100:2900] = 20
    for a in (page(), wide):
        y, x = np.indices(a.shape)
        for tilt in (-20, -10, 3.3, 10, 20, 28):
            rows = np.round(y - (x - a.shape[1] // 2) * np.tan(np.radians(tilt))).astype(int)
            tilted = np.where((rows >= 0) & (rows < a.shape[0]), a[np.clip(rows, 0, a.shape[0] - 1), x], 240).astype(np.uint8)
            assert abs(P.skew(tilted) - tilt) <= 0.3, (a.shape, tilt, P.skew(tilted))

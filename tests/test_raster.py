import numpy as np
import pytest

from facetflow.operators import raster as R


def brute_components(mask):
    seen, sizes = set(), []
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        ahead, part = [start], set()
        while ahead:
            p = ahead.pop()
            if p in part or not (0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]) or not mask[p]:
                continue
            part.add(p)
            ahead += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= part
        sizes.append(frozenset(part))
    return sizes


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    gray = rng.integers(0, 256, (17, 23)).astype(np.uint8)
    mask = np.where(rng.random((17, 23)) < 0.35 + 0.05 * seed, 255, 0).astype(np.uint8)
    assert (R.from_png(R.png(gray)) == gray).all()
    padded = np.pad(gray, 1, mode="edge")
    assert all(R.median3(gray)[y, x] == np.median(padded[y : y + 3, x : x + 3]) for y in range(17) for x in range(23))
    count, label = R.components(mask)
    assert [frozenset(map(tuple, np.argwhere(label == k))) for k in range(1, count + 1)] == brute_components(mask)
    paper = np.argwhere(mask == 0)
    depth = R.distances(mask)
    assert all(np.isclose(depth[y, x], np.hypot(*(paper - (y, x)).T).min()) for y in range(17) for x in range(23))
    shape = R.disc(5)
    reach = np.argwhere(shape) - 2
    grown, shrunk = R.dilate(mask, shape), R.erode(mask, shape)
    for y in range(17):
        for x in range(23):
            under = [mask[y + a, x + b] for a, b in reach if 0 <= y + a < 17 and 0 <= x + b < 23]
            assert grown[y, x] == max(under) and shrunk[y, x] == min(under)


def test_bad_images():
    for data in (b"", b"no", R.png(np.zeros((2, 2), np.uint8))[:40]):
        with pytest.raises(ValueError):
            R.from_png(data)
    assert R.components(np.zeros((3, 3)))[0] == 0


def test_strokes():
    bar = np.zeros((20, 40), np.uint8)
    bar[8:13, 5:35] = 255
    line = R.thin(bar)
    assert (line > 0).sum(0).max() == 1 and R.components(line)[0] == 1
    cross = np.zeros((9, 9), np.uint8)
    cross[4], cross[:, 4] = 255, 255
    assert R.crossing_numbers(cross)[4, 4] == 4 and R.crossing_numbers(cross)[4, 0] == 1 and R.crossing_numbers(cross)[0, 0] == 0
    assert R.cluster_points([(0, 0), (4, 0), (100, 0), (5, 1)], 12) == [(3, 0), (100, 0)]
    assert R.corridor(bar, (0, 10), (39, 10), 6, 6) == 1.0 and R.corridor(bar, (0, 0), (39, 0), 6, 6) == 0.0 and R.corridor(bar, (3, 3), (3, 3), 1, 1) == 0.0
    assert R.line_share(bar, (0, 10), (39, 10), 6) == 1.0 and R.line_share(bar, (0, 10), (8, 10), 6) == 0.0


def test_kmeans():
    # From 1, 25.5 and 50: the middle cluster is empty and stays where it is.
    assert R.kmeans_1d(np.array([1.0, 2, 10, 11, 50]), np.ones(5), 3).tolist() == [6, 25.5, 50]
    assert R.kmeans_1d(np.array([1.0, 2, 20, 21, 50]), np.ones(5), 3).tolist() == [1.5, 20.5, 50]
    assert np.allclose(R.kmeans_1d(np.array([1.0, 9]), np.array([3, 1]), 1), [3])


def drawing(dots, lines, gap=None):
    image = np.full((300, 300), 255, np.uint8)
    ys, xs = np.mgrid[:300, :300]
    for (ax, ay), (bx, by) in lines:
        for t in np.linspace(0, 1, 800):
            x, y = ax + t * (bx - ax), ay + t * (by - ay)
            if gap is None or abs(t - 0.5) > gap:
                image[(xs - x) ** 2 + (ys - y) ** 2 <= 16] = 0
    for x, y in dots:
        image[(xs - x) ** 2 + (ys - y) ** 2 <= 169] = 0
    return image


def test_a_drawing_gives_its_graph():
    dots = [(60, 60), (200, 60), (60, 200)]
    gray = R.denoised(drawing(dots, [(dots[0], dots[1]), (dots[1], dots[2]), (dots[2], dots[0])]))
    assert gray.shape == (246, 300)
    fine, solid = R.ink(gray), R.ink(gray, R.SOLID_BLOCK)
    nodes = R.solid_dots(fine, solid, [])
    assert len(nodes) == 3 and all(abs(n["x"] - x) <= 2 and abs(n["y"] - y) <= 2 for n, (x, y) in zip(sorted(nodes, key=lambda n: (n["x"], n["y"])), sorted(dots), strict=True))
    lines = R.strokes(fine)
    found = R.traced(lines, nodes)
    assert found["edges"].tolist() == [[0, 1], [0, 2], [1, 2]] and not len(found["junctions"]) and not len(found["ends"])
    # Without one node its two strokes are one, and join the others a second time; with one node alone they lead away from it.
    assert R.traced(lines, nodes[:2])["edges"].tolist() == [[0, 1]] and R.traced(lines, [])["edges"].tolist() == []
    assert (R.traced(lines, nodes[:1])["holders"] == 0).all()
    assert R.solid_dots(fine, solid, nodes, weak=True) == []


def ring_at(image, x, y, r=14):
    ys, xs = np.mgrid[: image.shape[0], : image.shape[1]]
    d = np.hypot(xs - x, ys - y)
    image[d <= r + 2], image[d <= r - 2] = 0, 255
    return image


def test_circles_and_polygons():
    ends = [(60, 60), (200, 60), (60, 200)]
    image = drawing([], [(ends[0], ends[1]), (ends[1], ends[2]), (ends[2], ends[0])])
    for x, y in ends:
        ring_at(image, x, y)
    gray = R.denoised(image)
    got = R.open_circles(gray, R.ink(gray), [])
    assert len(got) == 3 and all(min(np.hypot(n["x"] - x, n["y"] - y) for x, y in ends) <= 4 and 12 <= n["radius"] <= 17 for n in got)
    mask = np.zeros((200, 200), np.uint8)
    for y in range(60):
        mask[20 + y, 20 : 21 + y] = 255  # right triangle
    mask[100:130, 100:190] = 255  # rectangle of 90 by 30
    got = R.polygon_nodes(mask, [])
    assert [(n["shape"], n["degree"]) for n in got] == [("triangle", 8), ("square", 7)] and (got[1]["x"], got[1]["y"]) == (144, 114)
    assert R.polygon_nodes(mask, got) == [] and R.outline(np.eye(1)) == [(0, 0)]


def test_extraction_of_a_table(spark):
    from facetflow.operators import extract

    dots = [(60, 60), (200, 60), (60, 200)]
    sides = [(dots[0], dots[1]), (dots[1], dots[2]), (dots[2], dots[0])]
    images = {"page014_cell000.png": R.png(drawing(dots, sides)), "page014_cell001.png": R.png(np.full((60, 60), 255, np.uint8)), "page014_cell002.png": b"no image", "odd": None}
    rows = spark.createDataFrame([(k, v, 6) for k, v in images.items()], "crop string, content binary, labeled_ring int")
    got = {r.crop: r for r in extract.extract(rows).collect()}
    good = got["page014_cell000.png"]
    # Three vertices of degree 5 in a triangle: 15 - 3 - 9 + 3 = 6.
    assert (good.page, good.node_count, [tuple(e) for e in good.edges], good.ring_size, good.euler_valid) == (14, 3, [(0, 1), (0, 2), (1, 2)], 6, True)
    assert good.validation_note == "r=6, E_att=15 (ring verified)"
    assert got["page014_cell001.png"].failures == ["EMPTY: no node was found"] and got["page014_cell002.png"].failures == ["ERROR: not a PNG"] and got["odd"].page is None
    assert extract.extract(rows.limit(0)).count() == 0


def test_chords_and_missing_places():
    from facetflow.operators import extract

    nodes = [{"x": x, "y": y, "radius": 10} for x, y in ((0, 0), (100, 0), (50, 9), (50, 10))]
    assert [0, 1] not in extract.chords(nodes).tolist() and [0, 1] in extract.chords([nodes[k] for k in (0, 1, 3)]).tolist()
    assert extract.chords(nodes[:1]).tolist() == [] and extract.chords([]).tolist() == []
    found = {"junctions": np.array([(7, 7)]), "ends": np.array([(0, 0), (10, 0), (90, 0)]), "holders": np.array([4, 2, 2])}
    assert extract.missing_places(found).tolist() == [[7, 7], [5, 0]] and extract.bridged(found) == {(2, 4)}
    none = {"junctions": np.zeros((0, 2)), "ends": np.zeros((0, 2)), "holders": np.zeros(0, int)}
    assert len(extract.missing_places(none)) == 0 and extract.bridged(none) == set()


def test_measures_against_brute_force():
    rng = np.random.default_rng(2)
    gray, mask = rng.integers(0, 256, (40, 50)).astype(np.uint8), np.where(rng.random((40, 50)) < 0.4, 255, 0).astype(np.uint8)
    places = [(5, 6, 4.0), (25, 20, 9.5), (49, 39, 3.0), (200, 200, 2.0)]
    x, y, r = np.array(places).T
    for k, (cx, cy, reach) in enumerate(places):
        inside = [(j, i) for i in range(40) for j in range(50) if (j - cx) ** 2 + (i - cy) ** 2 <= reach * reach]
        assert np.isclose(R.shares(mask, x, y, r)[k], np.mean([mask[i, j] > 0 for j, i in inside]) if inside else 0)
        assert np.isclose(R.brightness(gray, x, y, r)[k], np.mean([gray[i, j] for j, i in inside]) if inside else 255)
        around = [(cx + reach * np.cos(a), cy + reach * np.sin(a)) for a in 2 * np.pi * np.arange(24) / 24]
        assert R.rims(mask, x, y, r, 24)[k] == sum(mask[min(39, max(0, int(round(b, 9)))), min(49, max(0, int(round(a, 9))))] > 128 for a, b in around)
    points, taken = rng.integers(0, 100, (60, 2)), rng.integers(0, 100, (5, 2))
    kept: list = []
    for k, p in enumerate(points):
        if all(((p - q) ** 2).sum() >= 625 for q in [*taken, *points[kept]]):
            kept.append(k)
    assert R.spaced(points, taken) == kept and R.spaced(points[:0], taken) == []


def test_pages():
    page = np.full((900, 1200), 255, np.uint8)
    frames = [(100, 80, 260, 240), (600, 110, 300, 200), (150, 500, 240, 260)]
    for x, y, w, h in frames:
        for k in range(8):
            page[y + k : y + h - k, x + k], page[y + k : y + h - k, x + w - 1 - k] = 0, 0
            page[y + k, x + k : x + w - k], page[y + h - 1 - k, x + k : x + w - k] = 0, 0
    page[20:40, 20:500] = 0  # a line of text is too low
    boxes = R.page_boxes(page)
    assert len(boxes) == 3 and all(abs(x - 14 - a) <= 3 and abs(y - 14 - b) <= 3 and abs(w + 28 - c) <= 6 and abs(h + 28 - d) <= 6 for (a, b, c, d), (x, y, w, h) in zip(boxes, frames, strict=True))
    crops = R.cut(page, boxes)
    assert [c.shape for c in crops] == [(h + 20, w + 20) for _, _, w, h in boxes]
    assert R.skew(page) == 0 and R.straightened(page) is page
    block = np.full((600, 800), 255, np.uint8)
    block[150:450, 100:700] = 0
    turned = R.rotated(block, 4.0)
    assert abs(abs(R.skew(turned)) - 4) < 0.3 and abs(R.skew(R.straightened(turned))) < 0.6 and R.skew(np.full((50, 50), 255, np.uint8)) == 0
    hull = R.convex_hull(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3)]))
    assert sorted(map(tuple, hull.tolist())) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert (R.overlay(page, [{"x": 300, "y": 600, "radius": 9}], []) == 128).any() and R.overlay(page, [], []).tolist() == page.tolist()

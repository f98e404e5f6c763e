"""Numpy kernels against slow models, closed forms and invariants."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from glyphkin.functions import boxes, images, segment
from glyphkin.functions.geometry import polygon_iou
from glyphkin.functions.geometry import polygon_iou
from glyphkin.functions.mixtures import NORMALITY, SPLIT_BELOW, Mixture, kmeans, lower_root, principal_components, shrunk
from glyphkin.functions.registration import COUNT, align, generators, gradient, matrix_of, parameters_of, register_all, register_to, warp
from glyphkin.operators.glyphs import leaves_of
from glyphkin.operators.ordering import leaf_order, linkage


def square(x, y, s):
    return np.array([x, y, x + s, y, x + s, y + s, x, y + s], float)


def test_iou_of_squares():
    assert polygon_iou(square(0, 0, 2), square(1, 1, 2)) == pytest.approx(1 / 7)
    assert polygon_iou(square(0, 0, 2), square(2, 0, 2)) == 0
    assert polygon_iou(square(0, 0, 2), square(0, 0, 2)[[6, 7, 4, 5, 2, 3, 0, 1]]) == pytest.approx(1)


def test_suppression_merges_and_silences():
    p = np.stack([square(0, 0, 10), square(1, 0, 10), square(50, 0, 10)])
    kept, merged, classes = boxes.suppress(p, np.array([0.9, 0.3, 0.8]), 0.3, classes=np.eye(3))
    assert kept == [0, 2]
    assert merged[0] == pytest.approx((0.9 * p[0] + 0.3 * p[1]) / 1.2)
    assert classes[0] == pytest.approx([0.75, 0.25, 0])


def test_suppression_needs_neighbours():
    p = np.stack([square(0, 0, 10), square(50, 0, 10), square(51, 0, 10)])
    kept, _, _ = boxes.suppress(p, np.array([0.9, 0.8, 0.7]), 0.3, least=1)
    assert kept == [1]
    # with more asked for than there are, what was silenced competes again and goes too
    assert boxes.suppress(p, np.array([0.9, 0.8, 0.7]), 0.3, least=2)[0] == []


def test_soft_suppression_keeps_distant_boxes():
    p = np.stack([square(0, 0, 10), square(0, 0, 10), square(50, 0, 10)])
    kept, _ = boxes.suppress_softly(p, np.array([0.95, 0.9, 0.85]), 0.8)
    assert kept == [0, 2]


@pytest.mark.parametrize("transform", COUNT)
def test_parameters_round_trip(transform):
    p = np.linspace(0.01, 0.06, COUNT[transform])
    assert parameters_of(matrix_of(p, transform), transform) == pytest.approx(p)
    assert matrix_of(np.zeros(COUNT[transform]), transform) == pytest.approx(np.eye(3))


@pytest.mark.parametrize("transform", COUNT)
def test_generators_are_derivatives(transform):
    j = generators((4, 5), transform)
    for k in range(COUNT[transform]):
        p = np.zeros(COUNT[transform])
        p[k] = 1e-6
        m = matrix_of(p, transform)
        x, y = 3, 2
        moved = (m @ [x, y, 1])[:2]
        assert (moved - [x, y]) / 1e-6 == pytest.approx(j[y, x, :, k], abs=1e-4)


def blob(h=24, w=24, cx=12.0, cy=11.0):
    y, x = np.mgrid[:h, :w]
    return np.exp(-((x - cx) ** 2 / 18 + (y - cy) ** 2 / 8)) + 0.4 * np.exp(-((x - cx - 4) ** 2 + (y - cy + 3) ** 2) / 6)


def test_warp_by_whole_pixels():
    img = blob()
    m = np.eye(3)
    m[0, 2] = 2
    assert warp(img, m)[:, :-2] == pytest.approx(img[:, 2:], abs=1e-9)
    assert (warp(img, m)[:, -2:] == 0).all()


@pytest.mark.parametrize("transform,p", [("translation", [1.3, -0.7]), ("euclidean", [0.5, -0.4, 0.08]), ("homothety", [0.4, 0.3, 0.05]), ("similarity", [0.2, 0.3, 0.03, -0.04]), ("affinity", [0.3, -0.2, 0.02, 0.03, -0.02, 0.04])])
def test_alignment_finds_the_movement(transform, p):
    img = blob(32, 32, 15, 16)
    ref = warp(img, matrix_of(np.array(p), transform), fill=None)
    assert align(ref, img, transform) == pytest.approx(p, abs=0.01)


def test_registration_falls_back():
    flat = np.ones((8, 8))
    assert (register_to(flat, flat) == flat).all()
    moved = np.stack([blob(cx=12 + d) for d in (-1, 0, 1)])
    out = register_all(moved, "translation")
    assert out.std(0).mean() < moved.std(0).mean() / 5


def test_gradient_of_a_ramp():
    y, x = np.mgrid[:5, :6]
    g = gradient(2.0 * x + 3 * y)
    assert (g[0][:, 1:-1] == 2).all() and (g[1][1:-1] == 3).all()


def test_mixture_parts_two_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(6, 1, (100, 3))])
    model, labels = Mixture.fit(x, 2, seed=1)
    assert len(set(labels[:200])) == 1 and len(set(labels[200:])) == 1
    assert sorted(model.weights) == pytest.approx([1 / 3, 2 / 3], abs=0.02)
    assert all(b >= a - 1e-6 * abs(a) - 5 for a, b in zip(model.history, model.history[1:]))
    one, labels = Mixture.fit(np.ones((5, 2)), 3)
    assert len(one.weights) == 1 and (labels == 0).all()


def test_kmeans_loss_falls():
    x = np.random.default_rng(3).normal(size=(300, 2))
    _, centres, losses = kmeans(x, 6)
    assert len(centres) <= 6 and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def test_shrinkage_and_root():
    assert shrunk(np.zeros((2, 2)), 10) == pytest.approx(1e-5 * np.eye(2))
    cov = shrunk(np.outer([1, 2, 3], [1, 2, 3.0]), 5)
    assert np.linalg.eigvalsh(cov).min() > 0 and np.trace(cov) == pytest.approx(14)
    assert np.isfinite(lower_root(np.diag([1.0, -1e-9]))).all()


def test_principal_components_by_share():
    x = np.random.default_rng(0).normal(size=(50, 3)) * [10, 1, 0.1]
    assert principal_components(x, 0.9).shape[1] == 1
    assert principal_components(x, 2).shape[1] == 2


@pytest.mark.parametrize("test", NORMALITY)
def test_normality_tells_apart(test):
    rng = np.random.default_rng(5)
    normal = [NORMALITY[test](rng.normal(size=200)) for _ in range(60)]
    other = [NORMALITY[test](rng.exponential(size=200)) for _ in range(20)]
    assert np.mean(np.array(normal) < 0.05) < 0.2 and np.median(normal) > 0.2
    assert max(other) < 0.01
    assert SPLIT_BELOW == pytest.approx(0.0455, abs=1e-4)


def test_leaves_part_two_shapes():
    rng = np.random.default_rng(1)
    a, b = blob(10, 8, 3, 4), blob(10, 8, 5, 6)
    imgs = np.stack([x + rng.normal(0, 0.02, x.shape) for x in [a] * 40 + [b] * 40])
    leaves = leaves_of(imgs, register=False)
    assert all(set(np.unique(leaf // 40)) in ({0}, {1}) for leaf in leaves)
    assert leaves_of(imgs[:5], register=False) == []


def test_poisson_edit_of_itself():
    img = np.random.default_rng(2).random((12, 14))
    mask = np.zeros(img.shape, bool)
    mask[3:8, 4:9] = True
    assert images.poisson_edit(img, img, mask) == pytest.approx(img, abs=1e-6)
    assert images.poisson_edit(np.full((9, 9), 0.3), np.ones((9, 9)), mask[:9, :9]) == pytest.approx(np.ones((9, 9)), abs=1e-6)


def test_flat_background_of_a_gradient():
    y, x = np.mgrid[:40, :60]
    page = (200 - x).astype(np.uint8)
    page[15:25, 20:24] = 10
    out = images.flat_background(page, 2)
    assert out[5, 5] == pytest.approx(1) and out[20, 22] < 0.4
    tiled = images.flat_background(page, 2, tile=20)
    assert tiled.shape == out.shape


def test_words_only():
    page = np.full((20, 20), 7, np.uint8)
    out = images.only_words(page, [(5, 8, 5, 8)], 1)
    assert (out > 0).sum() == 25 and images.only_words(page, []) is page


def test_dominant_angle_of_stripes():
    y, x = np.mgrid[:64, :64]
    page = (127 + 100 * np.sin(2 * np.pi * y / 8)).astype(np.uint8)
    angles = {a for _, _, a in images.window_angles(page, 64, 64, (64, 64))}
    assert angles == {0.0}
    assert images.window_angles(np.full((64, 64), 9, np.uint8), 64, 64, (64, 64)) == []


def test_structure_tensor_direction():
    y, x = np.mgrid[:32, :32]
    t = images.structure_tensor(np.sin((x + y) / 2.0))
    assert np.degrees(np.median(t["orientation"][4:-4, 4:-4])) == pytest.approx(45, abs=1)
    assert t["coherence"][8:-8, 8:-8].mean() > 0.9
    g = images.structure_tensor(np.sin(x / 2.0), sigma=1.0)
    assert abs(g["Jyy"][8:-8, 8:-8]).max() < 1e-9


def test_centred_glyph():
    img = np.ones((20, 16))
    img[2:8, 1:5] = 0
    g = images.centred_glyph(img)
    y, x = np.indices(g.shape)
    assert g.shape == (40, 32)
    assert (g * y).sum() / g.sum() == pytest.approx(20, abs=0.6) and (g * x).sum() / g.sum() == pytest.approx(16, abs=0.6)
    assert images.centred_glyph(np.where(np.indices((60, 50))[0] > 30, 0.0, 1.0)).shape == (40, 32)


def test_tiff_tags():
    import struct

    tags = [(256, 3, 1, 100), (257, 3, 1, 50), (282, 5, 1, 8 + 2 + 5 * 12 + 4), (283, 5, 1, 8 + 2 + 5 * 12 + 4), (296, 3, 1, 2)]
    body = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 5) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + struct.pack("<II", 300, 1)
    assert images.tiff_info(body) == {"width_px": 100, "height_px": 50, "dpi_width": 300.0, "dpi_height": 300.0}
    with pytest.raises(ValueError):
        images.tiff_info(b"nothing of the kind")


def brute_path(cost, start, end, steps):
    h, w = cost.shape
    best = {start: 0.0}
    for _ in range(h * w):
        for (y, x), d in list(best.items()):
            for dy, dx, length in steps:
                v, u = y + dy, x + dx
                if 0 <= v < h and 0 <= u < w:
                    n = d + length * (cost[y, x] + cost[v, u]) / 2
                    if n < best.get((v, u), math.inf):
                        best[v, u] = n
    return best[end]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1000), st.booleans())
def test_cheapest_path(seed, diagonal):
    cost = np.random.default_rng(seed).random((5, 6))
    path = segment.cheapest_path(cost, (0, 0), (4, 5), diagonal)
    length = sum(np.hypot(*(b - a)) * (cost[tuple(a)] + cost[tuple(b)]) / 2 for a, b in zip(path, path[1:]))
    assert length == pytest.approx(brute_path(cost, (0, 0), (4, 5), segment.STEPS8 if diagonal else segment.STEPS4))


def test_masks_of_two_letters():
    word = np.ones((30, 50))
    word[8:22, 8:14] = 0
    word[8:22, 30:36] = 0
    found = segment.char_masks(word, np.array([[7, 23, 6, 16], [7, 23, 28, 38]]), 10)
    assert [i for i, _, _ in found] == [0, 1]
    for (i, (t, b, left, r), mask), lo in zip(found, (8, 30)):
        assert mask.shape == (b - t, r - left)
        inside = np.zeros(word.shape, bool)
        inside[t:b, left:r] = mask
        assert inside[10:20, lo : lo + 6].all()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 6))
def test_leaf_order_is_the_best(seed, n):
    d = np.random.default_rng(seed).random((n, n))
    d = d + d.T
    np.fill_diagonal(d, 0)
    members = {i: {i} for i in range(n)}
    for k, (a, b, _, _) in enumerate(linkage(d)):
        members[n + k] = members[a] | members[b]

    def fits(p):
        at = {x: i for i, x in enumerate(p)}
        return all(max(at[x] for x in m) - min(at[x] for x in m) == len(m) - 1 for m in members.values())

    cost = lambda p: sum(d[a, b] for a, b in zip(p, p[1:]))
    got = leaf_order(d)
    assert fits(got) and sorted(got) == list(range(n))
    assert cost(got) == pytest.approx(min(cost(p) for p in itertools.permutations(range(n)) if fits(p)))


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward"])
def test_linkage_by_definition(method):
    """Merges of the nearest pair, the smallest nodes on ties, with distances made anew from all pairs."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 12):
        d = rng.integers(1, 4, (n, n)) + 0.0 if n == 12 else rng.random((n, n))
        d = d + d.T
        np.fill_diagonal(d, 0)
        far = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
        size = dict.fromkeys(range(n), 1)
        for step, (a, b, h, s) in enumerate(linkage(d, method)):
            assert ((a, b), s) == (min(far, key=lambda p: (far[p], p)), size[a] + size[b]) and h == pytest.approx(far[a, b])
            for k in set(size) - {a, b}:
                x, y = far[min(a, k), max(a, k)], far[min(b, k), max(b, k)]
                t = size[a] + size[b] + size[k]
                far[k, n + step] = {"single": min(x, y), "complete": max(x, y), "average": (size[a] * x + size[b] * y) / (size[a] + size[b]), "ward": (((size[a] + size[k]) * x * x + (size[b] + size[k]) * y * y - size[k] * h * h) / t) ** 0.5}[method]
            size[n + step] = size.pop(a) + size.pop(b)
            far = {p: v for p, v in far.items() if not {a, b} & set(p)}


def grown(imgs, transform, least):
    """Leaves of the tree, every node registered."""

    def grow(node, level):
        if len(node) < least:
            return []
        if level < 10:
            part = register_all(imgs[node], transform)
            x = principal_components(part.reshape(len(part), -1), 9)
            if any(NORMALITY["ad"](x[:, k]) < SPLIT_BELOW for k in range(5)):
                _, labels = Mixture.fit(x, 2, seed=0)
                if len(set(labels.tolist())) == 2:
                    return grow(node[labels == 0], level + 1) + grow(node[labels == 1], level + 1)
        return [node]

    return grow(np.arange(len(imgs)), 0)


def test_queries_grow_trees_of_registered_images(spark, tmp_path):
    from glyphkin.plans import QUERIES

    rng = np.random.default_rng(1)
    imgs = [blob(8, 8, 3.5 + d, 4) + rng.normal(0, 0.02, (8, 8)) for d in [-0.5] * 20 + [0.5] * 20]
    rows = [(k, 0, [float(v) for v in x.ravel()]) for k, x in enumerate(imgs)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf, imgs = f"file://{tmp_path}", np.stack(imgs)
    want = grown(imgs, "euclidean", 8)
    assert [leaf.tolist() for leaf in leaves_of(imgs, least=8)] == [leaf.tolist() for leaf in want]
    bare = leaves_of(imgs, least=8, register=False)
    assert [len(leaf) for leaf in bare] != [len(leaf) for leaf in want]
    row = QUERIES["x15_leaves"](spark, sf).first()
    assert (row.leaves, row.held) == (len(want), sum(map(len, want)))
    cluster = {}
    for doc in (0, 1):
        ids = np.arange(doc, len(imgs), 2)
        cluster |= {int(i): -1 for i in ids}
        cluster |= {int(i): k for k, leaf in enumerate(grown(imgs[ids], "translation", 8)) for i in ids[leaf]}
    got = {r.char_id: r.cluster for r in QUERIES["x16_refined_clusters"](spark, sf).collect()}
    assert got == cluster


@pytest.mark.parametrize("more,want", [({}, {"homothety"}), ({"register_large": True}, {"homothety", "translation"})])
def test_large_nodes_are_registered_by_translation(monkeypatch, more, want):
    from glyphkin.operators import glyphs

    seen = []
    monkeypatch.setattr(glyphs, "register_all", lambda part, transform: seen.append((len(part), transform)) or part)
    rng = np.random.default_rng(1)
    imgs = np.stack([x + rng.normal(0, 0.02, x.shape) for x in [blob(10, 8, 3, 4)] * 40 + [blob(10, 8, 5, 6)] * 40])
    leaves_of(imgs, "homothety", large=60, **more)
    assert {t for _, t in seen} == want and all((n >= 60) == (t == "translation") for n, t in seen)


def test_initial_clusters_of_the_operators_settings(spark, sf):
    from glyphkin.plans import QUERIES

    got = {}
    for r in QUERIES["x14_initial_clusters"](spark, sf).collect():
        got.setdefault(r.doc, set()).add(r.root)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    for k in (0, 1):
        x = principal_components(np.array([r.embedding for r in rows if r.vec_id % 2 == k], float), 0.9)
        want = set(Mixture.fit(x, 70, 200, seed=42)[1].tolist())
        assert len(got[f"d{k}"]) == len(want) > 10


def test_mixtures_of_large_documents_are_fitted_in_blocks(spark, sf):
    from glyphkin.operators.glyphs import initial_clusters
    from glyphkin.plans.kernel_queries import _glyph_chars

    chars = _glyph_chars(spark, sf)
    equal = spark.range(300).selectExpr("'same' AS doc", "id AS char_id", "array_repeat(0.5F, 64) AS img")
    few = chars.filter("doc = 'd1' AND char_id < 60").selectExpr("'few' AS doc", "char_id", "img")
    got = {}
    for r in initial_clusters(chars.unionByName(equal).unionByName(few), components=12, large=100).collect():
        got.setdefault(r.doc, {})[r.char_id] = r.root
    assert set(got["same"].values()) == {0} and len(got["same"]) == 300
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    for doc, mine in (("d0", lambda v: v % 2 == 0), ("d1", lambda v: v % 2 == 1), ("few", lambda v: v % 2 == 1 and v < 60)):
        held = [r for r in rows if mine(r.vec_id)]
        x = principal_components(np.array([r.embedding for r in held], float), 0.9)
        want = Mixture.fit(x, 12, 200, seed=42)[1].tolist()
        assert [got[doc][r.vec_id] for r in held] == want and len(set(want)) > 1


def test_a_mixture_of_sums_is_that_of_the_points():
    from glyphkin.operators import mixing

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.4, (80, 3)) for m in ((0, 0, 0), (4, 1, 0), (0, 5, 2))])
    share = rng.dirichlet((1, 1, 1), len(x)).T
    model = Mixture.of(x, share)
    want, fit = model.shares(x)
    moments = [share.sum(1), share @ x, np.stack([(x * w[:, None]).T @ x for w in share])]
    got, total = mixing._mixture(len(x), *moments).shares(x)
    assert np.allclose(got.T, want, atol=1e-9) and np.isclose(total, fit)


@pytest.mark.parametrize("diagonal", [False, True])
def test_paths_of_a_stack_are_those_of_its_images(diagonal):
    rng = np.random.default_rng(0)
    # few levels, so many paths cost the same; some images have steps without cost
    cost = np.concatenate([rng.integers(1, 4, (60, 9, 11)), rng.integers(0, 3, (20, 9, 11))]).astype(float)
    starts, ends = (np.stack([rng.integers(0, 9, 80), rng.integers(0, 11, 80)], 1) for _ in range(2))
    for got, *one in zip(segment.cheapest_paths(cost, starts, ends, diagonal), cost, starts, ends):
        assert got.tolist() == segment.cheapest_path(one[0], tuple(one[1]), tuple(one[2]), diagonal).tolist()
    cost[3] = np.nan
    with pytest.raises(ValueError):
        segment.cheapest_paths(cost, starts, np.where(starts > 0, 0, 1), diagonal)


def test_masks_of_a_stack_are_those_of_its_words(monkeypatch):
    rng = np.random.default_rng(1)
    words = np.clip(rng.random((12, 16, 24)) * 1.2, 0, 1)
    found = segment.stacked_char_masks(words, boxes := np.array([[4, 12, 2, 9], [5, 11, 13, 20]]), 7)
    plain, tried = segment.cheapest_path, []
    monkeypatch.setattr(segment, "cheapest_path", lambda *a, **k: tried.append(1) or plain(*a, **k))
    for word, masks in zip(words, found):
        want = segment.char_masks(word, boxes, 7)
        assert [m[:2] for m in masks] == [m[:2] for m in want] and all((a[2] == b[2]).all() for a, b in zip(masks, want))
    assert tried
    tried.clear()
    segment.cheapest_paths(words + 0.05, np.full((12, 2), 1), np.full((12, 2), 9), diagonal=True)
    # the search point by point isn't used where every step costs something
    assert not tried


def test_alignment_makes_an_image_s_spline_once(monkeypatch):
    from glyphkin.functions import registration

    made, plain = [], registration._spline_coefficients
    monkeypatch.setattr(registration, "_spline_coefficients", lambda x: made.append(1) or plain(x))
    img = blob()
    align(img, warp(img, matrix_of(np.array([-1.0, 0.5]), "translation"), fill=None), "translation")
    # two of the image that is moved beforehand, two of the aligned one, whatever the number of steps
    assert len(made) == 4


def _crowd(rng, n, width, height):
    """Slanted boxes at random places, some of them twice."""
    left, top, w, h = rng.integers(0, width, n), rng.integers(0, height, n), 20 + 2 * rng.integers(1, 51, n), 12 + rng.integers(1, 8, n)
    p = np.stack([left, top, left + w, top + 2, left + w - 3, top + h, left - 3, top + h - 2], 1).astype(float)
    p[: n // 10] = p[n // 10 : 2 * (n // 10)]
    return p


def _suppressed_plainly(p, scores, over, near, least):
    """As suppress, over all pairs."""
    order = np.argsort(scores, kind="stable")[::-1].tolist()
    silent, kept, merged = set(), [], []
    for k, i in enumerate(order):
        if i in silent:
            continue
        later = [(j, polygon_iou(p[i], p[j])) for j in order[k + 1 :] if j not in silent]
        close = [j for j, v in later if v > near]
        if len(close) < least:
            silent |= {j for j, v in later if v > over and j not in close}
            continue
        silent |= {j for j, v in later if v > over}
        group = [*close, i]
        kept.append(i)
        merged.append(scores[group] @ p[group] / scores[group].sum())
    return kept, merged


@pytest.mark.parametrize(("over", "near", "least"), [(0.3, 0.2, 0), (0.15, 0.5, 1)])
def test_suppression_in_small_parts_against_all_pairs(monkeypatch, over, near, least):
    rng = np.random.default_rng(5)
    p, scores = _crowd(rng, 150, 250, 60), 0.5 + rng.integers(0, 11, 150) / 20
    want, polygons = _suppressed_plainly(p, scores, over, near, least)
    for part, pairs in ((boxes.PART, boxes.PAIRS), (5, 40)):
        monkeypatch.setattr(boxes, "PART", part)
        monkeypatch.setattr(boxes, "PAIRS", pairs)
        kept, merged, _ = boxes.suppress(p, scores, over, near, least=least)
        assert kept == want
        assert np.allclose(merged, polygons)


def test_soft_suppression_in_small_parts_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    p, scores = _crowd(rng, 120, 250, 60), 0.85 + rng.integers(0, 11, 120) / 100
    left, alive, want = scores.copy(), list(range(120)), []
    while alive:
        i = max(alive, key=lambda k: (left[k], -k))
        alive.remove(i)
        for j in alive:
            left[j] *= np.exp(-2 * polygon_iou(p[i], p[j]) ** 2)
        alive = [j for j in alive if left[j] >= 0.8]
        want.append(i)
    for part, pairs in ((boxes.PART, boxes.PAIRS), (5, 40)):
        monkeypatch.setattr(boxes, "PART", part)
        monkeypatch.setattr(boxes, "PAIRS", pairs)
        assert boxes.suppress_softly(p, scores, 0.8)[0] == want


def test_suppression_of_many_boxes_in_one_place():
    """Pairs with boxes that are silent already are not made: 40 000 boxes in one place have 800 million."""
    p = np.tile([0.0, 0, 40, 0, 40, 12, 0, 12], (40_000, 1))
    kept, _, _ = boxes.suppress(p, np.linspace(0.5, 0.9, 40_000), 0.3, 0.2)
    assert kept == [39_999]
    assert boxes.suppress_softly(p, np.linspace(0.85, 0.9, 40_000))[0] == [39_999]


def test_best_overlaps_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    p, q, ids = _crowd(rng, 80, 250, 60), _crowd(rng, 150, 250, 60), rng.permutation(150)
    want = {}
    for i, x in enumerate(p):
        v, w = max((round(polygon_iou(x, y), 12), -k) for y, k in zip(q, ids.tolist()))
        if v > 0:
            want[i] = (-w, v)
    for pairs in (boxes.PAIRS, 40):
        monkeypatch.setattr(boxes, "PAIRS", pairs)
        assert {i: (w, v) for i, w, v in zip(*(x.tolist() for x in boxes.best_overlaps(p, q, ids)))} == want

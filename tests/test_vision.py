"""Image kernels against figures that can be worked out by hand, or plain versions."""

import math

import numpy as np
import pytest

from docloom.operators import imaging as im
from docloom.operators import vision
from docloom.plans.render import page_image


def lines_page(h=400, w=600):
    page = np.full((h, w, 3), 255, np.uint8)
    for y in range(30, h - 30, 24):
        page[y : y + 8, 40 : w - 60] = 0
    return page


def test_png_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (13, 7, 3)).astype(np.uint8), rng.integers(0, 256, (5, 9)).astype(np.uint8)):
        assert (im.decode_png(im.encode_png(image)) == image).all()
    path = tmp_path / "a.png"
    path.write_bytes(im.encode_png(lines_page()))
    assert vision.load_image(str(path)).shape == (400, 600, 3)
    with pytest.raises(FileNotFoundError):
        vision.load_image(str(tmp_path / "none.png"))
    with pytest.raises(TypeError):
        vision.load_image(7)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    rgb, raw = image[..., ::-1].astype(int), b""
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        out = []
        for x in range(5):
            for c in range(3):
                a, b, d = rgb[y, x - 1, c] if x else 0, rgb[y - 1, x, c] if y else 0, rgb[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out.append((rgb[y, x, c] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        raw += bytes([kind, *(int(v) for v in out)])
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (im.decode_png(data) == image).all()


def test_components_and_boundaries():
    mask = np.zeros((40, 60), bool)
    mask[5:15, 10:30] = True  # a box: 19 by 9 between the centres
    mask[20:35, 5:25] = True
    mask[24:31, 10:20] = False  # a frame with a block inside, which is not outermost
    mask[26:28, 13:16] = True
    mask[38, 50] = True
    found = sorted(im.outer(mask), key=lambda p: p["box"])
    assert [p["box"] for p in found] == [(5, 20, 20, 15), (10, 5, 20, 10), (50, 38, 1, 1)]
    assert [p["area"] for p in found] == [19 * 14, 19 * 9, 0] and [p["perimeter"] for p in found] == [2 * (19 + 14), 2 * (19 + 9), 0]
    ring = np.eye(9, dtype=bool) | np.eye(9, dtype=bool)[::-1]
    assert len(im.outer(ring)) == 1 and im.labels(ring, diagonal=False)[1] == 17
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.random((12, 14)) < 0.45
        number, n = im.labels(m)
        seen = {}
        for y, x in np.argwhere(m):
            todo, k = [(y, x)], number[y, x]
            seen.setdefault((y, x), k)
            while todo:
                p = todo.pop()
                for q in [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if 0 <= q[0] < 12 and 0 <= q[1] < 14 and m[q] and q not in seen:
                        seen[q] = k
                        todo.append(q)
        assert all(number[p] == k for p, k in seen.items()) and len(set(seen.values())) == n


def test_morphology_is_that_of_a_plain_version():
    rng = np.random.default_rng(3)
    mask = rng.random((20, 25)) < 0.2
    for kernel in (im.box(4, 3), im.box(5, 5), im.ellipse(5), im.ellipse(7)):
        kh, kw = kernel.shape
        want = np.zeros_like(mask)
        for y, x in np.ndindex(mask.shape):
            want[y, x] = any(0 <= y + i - kh // 2 < 20 and 0 <= x + j - kw // 2 < 25 and mask[y + i - kh // 2, x + j - kw // 2] for i, j in np.argwhere(kernel))
        assert (im.dilate(mask, kernel) == want).all()
    assert im.ellipse(5).sum() == 17 and im.ellipse(7).sum() == 33


def test_orientation_and_skew():
    page = lines_page()
    assert vision.orientation(page) == 0 and vision.orientation(np.rot90(page)) == 90 and vision.skew(page) == 0.0
    for angle in (-6.0, 4.0):
        turned = im.rotated(page, angle)
        assert abs(abs(vision.skew(turned)) - abs(angle)) < 1.0 and np.sign(vision.skew(turned)) == np.sign(angle)
    assert vision.correct_skew(page)[1] == 0.0
    assert vision.correct_skew(page, 5.0)[0].shape == page.shape and vision.skew(np.full((50, 50, 3), 255, np.uint8)) == 0.0
    square = np.array([(math.cos(math.radians(t)) * 50, math.sin(math.radians(t)) * 50) for t in (20, 110, 200, 290)])
    assert abs(im.least_box_angle(square) - 65) < 1e-6


def test_preprocess_chain():
    image, done = vision.preprocess(np.rot90(lines_page()).copy())
    assert done["orientation_angle_corrected"] == 90 and done["original_shape"] == [600, 400, 3] and done["final_shape"] == [400, 600, 3] == list(image.shape)
    faint = (lines_page() * 0.1 + 120).astype(np.uint8)
    better, done = vision.preprocess(faint, noise=False)
    assert done["clahe_applied"] and not done["denoise_applied"] and im.grey(better).std() > im.grey(faint).std()
    assert abs(im.from_lab(im.to_lab(lines_page())).astype(int) - lines_page()).max() <= 1
    rng = np.random.default_rng(0)
    noisy = np.clip(lines_page() + rng.normal(0, 12, (400, 600, 3)), 0, 255).astype(np.uint8)
    smooth = vision.denoise(noisy)
    assert smooth[45:50, 100:200].std() < noisy[45:50, 100:200].std() and abs(int(smooth[33, 300, 0]) - int(smooth[28, 300, 0])) > 150


def test_degradations_have_their_values():
    page = lines_page(300, 200)
    assert (vision.degrade(page, "low_contrast")[0, 0] == int(255 * 0.45 + 50)).all() and (vision.degrade(page, "low_contrast")[32, 50] == 50).all()
    for kind in vision.CONDITIONS:
        out = vision.degrade(page, kind)
        assert out.shape == ((200, 300, 3) if kind == "rotation_90" else page.shape) and out.dtype == np.uint8
    assert (vision.degrade(page, "downscale")[::2, ::2] == vision.degrade(page, "downscale")[1::2, 1::2]).all()
    dot = np.zeros((21, 21), np.uint8)
    dot[10, 10] = 255
    spread = vision.degrade(dot, "blur")
    assert (spread[10] > 0).sum() == 9 and spread[10, 10] == int(np.floor(255 * im.gaussian(9, 3.0)[4] ** 2 + 0.5))
    assert (vision.degrade(page, "unknown") == page).all()


def test_marks():
    for key in range(30):
        page = page_image(key)
        page = page if key % 2 else np.rot90(page, -1)
        stamp, signature = vision.detect_mark("stamp", page.copy()), vision.detect_mark("signature", page.copy())
        assert (stamp["present"], signature["present"]) == (key % 3 == 0, key % 5 == 0)
        assert stamp["confidence"] == (0.96 if key % 3 == 0 else 0.15) and (signature["confidence"] >= 0.6 if key % 5 == 0 else signature["confidence"] == 0.15)
    assert vision.find_stamp(np.zeros((50, 50), np.uint8))["confidence"] == 0.10
    for source in ("x.txt", "/no/such.png"):
        assert vision.detect_mark("stamp", source) == vision.stub_mark("stamp") and vision.stub_mark("stamp")["status"] == "not_implemented"
    assert vision.manual_mark("signature", False)["status"] == "not_detected" and vision.manual_mark("stamp", True, [0, 0, 5, 5])["bbox"] == [0, 0, 5, 5]
    ranked = vision.best_candidate("stamp", [((0, 0, 9, 9), 0.7, 1000.0), ((1, 1, 2, 2), 0.7, 90_000.0), ((3, 3, 4, 4), 0.9, 600.0)])
    assert ranked[0] == (1, 1, 2, 2)


def test_kernels_over_files_report_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(im.encode_png(lines_page()))
    (tmp_path / "b.png").write_bytes(b"broken")
    files = vision.read_images(spark, str(tmp_path), "*.png")
    rows = {r.path[-5:]: r for r in vision.apply_kernel(files, None, lambda page: {"angle": vision.orientation(page)}, "angle int").collect()}
    assert rows["a.png"].angle == 0 and rows["a.png"].error is None and rows["b.png"].page == 0 and "not a PNG" in rows["b.png"].error

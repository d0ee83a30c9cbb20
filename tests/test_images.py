"""Images that are really decoded, and hashes against a plain version of the resize."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from sieveline.sources import images


def png(pixels):
    """PNG bytes of (height, width, 1, 3 or 4) red, green, blue and opacity."""
    height, width, channels = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def plain_hash(grey):
    """Bicubic resize to 9 x 8 pixel by pixel in whole steps, then the difference bits."""

    def cubic(x):
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0

    def line(values, to):
        if len(values) == to:
            return list(values)
        scale = len(values) / to
        wide, out = max(scale, 1), []
        for i in range(to):
            centre = (i + 0.5) * scale
            at = range(max(int(centre - 2 * wide + 0.5), 0), min(int(centre + 2 * wide + 0.5), len(values)))
            weights = [cubic((x - centre + 0.5) / wide) for x in at]
            out.append(min(max(int(np.floor(sum(values[x] * w for x, w in zip(at, weights)) / sum(weights) + 0.5)), 0), 255))
        return out

    across = [line(row, 9) for row in grey.tolist()]
    small = np.array([line(column, 8) for column in zip(*across)]).T
    return f"{int(''.join('01'[int(b >= a)] for row in small for a, b in zip(row, row[1:])), 2):016x}"


def test_images_are_decoded_without_a_library_on_the_workers(spark, tmp_path):
    r = np.random.default_rng(1)
    ramp = np.tile(np.arange(9) * 20, (8, 1))
    made = {
        "A/flat.png": np.full((40, 30, 1), 77), "A/rising.png": ramp[:, :, None], "B/falling.PNG": ramp[:, ::-1, None], "B/small.png": r.integers(0, 256, (5, 4, 1)), "B/noise.png": r.integers(0, 256, (120, 90, 1)),
        "C/colour.png": r.integers(0, 256, (64, 72, 3)), "C/clear.png": r.integers(0, 256, (33, 47, 4)), "C/a+b é 1%.png": r.integers(0, 256, (8, 500, 3)),
    }
    for name, pixels in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(pixels))
    (tmp_path / "A" / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "A" / "cut.png").write_bytes(png(made["B/noise.png"])[:200])
    (tmp_path / "A" / "notes.txt").write_text("x")
    got = {v.relative_path: v for v in images.inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {*made, "A/broken.jpg", "A/cut.png"}
    for name, pixels in made.items():
        row, rgb = got[name], pixels.astype(np.int64)
        grey = rgb[:, :, 0] if rgb.shape[2] == 1 else (rgb[:, :, 0] * 19595 + rgb[:, :, 1] * 38470 + rgb[:, :, 2] * 7471 + 32768) >> 16
        data = (tmp_path / name).read_bytes()
        assert (row.status, row.error, row.height, row.width, row.food_class, row.bytes) == ("ok", "", *pixels.shape[:2], name[0], len(data)), name
        assert row.dhash == plain_hash(grey) and row.sha256 == hashlib.sha256(data).hexdigest(), name
    for name in ("A/broken.jpg", "A/cut.png"):
        assert (got[name].status, got[name].width, got[name].dhash, got[name].sha256) == ("corrupt", None, "", "") and got[name].error
    # fixed images with known hashes
    assert got["A/flat.png"].dhash == got["A/rising.png"].dhash == "f" * 16 and got["B/falling.PNG"].dhash == "0" * 16


@pytest.mark.parametrize("size", [1, 3, 9, 10, 64, 333])
def test_weights_of_a_resize_add_up_to_one(size):
    w = images.resize_weights(size, 9)
    assert w.shape == (9, size) and (np.abs(w.sum(axis=1) - (1 << images.PRECISION)) <= size).all()
    assert (images.shrink(np.full((20, size), 200)) == 200).all()

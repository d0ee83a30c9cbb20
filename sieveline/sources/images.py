"""Image inventories by Spark's own binary reader. A file that can't be read is a row with its error, never a failed job."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of images.
EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, content of all images below a folder, whatever the case of their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))


def difference_bits(grey: np.ndarray) -> str:
    """16 hex characters of an 8 x 9 grey image: a bit is set where the right neighbour is at least as light, row by row."""
    grey = np.asarray(grey).astype(np.int32)
    if grey.shape != (8, 9):
        raise ValueError("an 8 x 9 image is needed")
    return np.packbits(grey[:, 1:] >= grey[:, :-1]).tobytes().hex()


#: Bits after the point of the resize's weights.
PRECISION = 22
#: Weights of red, green and blue in grey, in 65536ths, and of the half that rounds.
GREY, HALF = (19595, 38470, 7471), 1 << 15


@functools.cache
def resize_weights(size: int, to: int) -> np.ndarray:
    """A matrix (to, size) of fixed-point weights: bicubic interpolation (a = -0.5), widened where it shrinks so that all
    pixels count."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum((centre - 2 * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    at = np.arange(size)[None, :]
    x = np.abs((at - centre[:, None] + 0.5) / wide)
    cubic = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    cubic = np.where((at >= first[:, None]) & (at < last[:, None]), cubic, 0.0)
    return np.floor(cubic / cubic.sum(axis=1, keepdims=True) * (1 << PRECISION) + 0.5).astype(np.int64)


def _weighted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((rows.astype(np.int64) @ weights.T + (1 << (PRECISION - 1))) >> PRECISION, 0, 255)


def shrink(grey: np.ndarray, width: int = 9, height: int = 8) -> np.ndarray:
    """A grey image of that size, first along its rows, then along its columns, in whole steps of grey."""
    across = _weighted(grey, resize_weights(grey.shape[1], width)) if grey.shape[1] != width else grey
    return _weighted(across.T, resize_weights(grey.shape[0], height)).T if grey.shape[0] != height else across


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Grey from pixels (height, width, channels): grey as it is, else blue, green, red and perhaps opacity, which doesn't count."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    blue, green, red = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return (red * GREY[0] + green * GREY[1] + blue * GREY[2] + HALF) >> 16


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of decoded images, one image at a time."""
    for batch in batches:
        out = []
        sizes = zip(*(batch[c].to_pylist() for c in ("height", "width", "channels")))
        for i, (height, width, channels) in enumerate(sizes):
            if height is None or height <= 0 or width <= 0:
                out.append("")
            else:
                pixels = np.frombuffer(batch["data"][i].as_buffer(), np.uint8).reshape(height, width, channels)
                out.append(difference_bits(shrink(grey_of(pixels))))
        yield pa.RecordBatch.from_arrays([batch["path"], batch["height"], batch["width"], pa.array(out, pa.string())], ["path", "height", "width", "dhash"])


#: Decoded images that are sent to a worker at once.
IMAGES = 4


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, dhash of the images below a folder, decoded in the JVM by Spark's image source.

    Of files that can't be decoded, height and width are -1 and the hash is blank. JPEG and PNG can be, WebP can't.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= IMAGES:
        spark.conf.set(key, str(IMAGES))
    files = spark.read.format("image").options(recursiveFileLookup="true", dropInvalid="false").load(root)
    # the binary source's form of a path: no percent signs of a URI, and one slash after file:
    path = F.regexp_replace(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    at = files.select(path.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    wanted = at.where(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))
    return wanted.mapInArrow(_hashes, "path string, height int, width int, dhash string")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """image_path, relative_path, food_class (the folder), bytes, status, error, width, height, dhash, sha256.

    Files are read twice, for their bytes and for their pixels, and joined by path. A file that can't be decoded is a row of
    status corrupt.
    """
    files = discover(spark, root).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))
    pixels = decoded(spark, root).select(F.col("path").alias("_path"), "height", "width", "dhash")
    seen = files.join(pixels, F.col("path") == F.col("_path"), "left")
    ok = F.coalesce(F.col("height") > 0, F.lit(False))
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.removeprefix("file:").rstrip("/").replace(".", r"\.") + "/", "")
    return seen.select(
        F.col("path").alias("image_path"),
        below.alias("relative_path"),
        F.element_at(F.split("path", "/"), -2).alias("food_class"),
        "bytes",
        F.when(ok, "ok").otherwise("corrupt").alias("status"),
        F.when(ok, "").otherwise("DecodeError: not an image that the decoder reads").alias("error"),
        F.when(ok, F.col("width")).alias("width"),
        F.when(ok, F.col("height")).alias("height"),
        F.when(ok, F.col("dhash")).otherwise("").alias("dhash"),
        F.when(ok, F.col("sha")).otherwise("").alias("sha256"),
    )

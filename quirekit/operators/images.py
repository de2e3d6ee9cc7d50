"""Page images: from RGB to what a recogniser reads, in numpy, as one Arrow function.

The steps are grey, enlarging, contrast by tiles, sharpening, Otsu, closing
and a border. They follow the published definitions of these operations;
rounding may differ by a grey level from native image libraries.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed


def grey(image):
    """Luma of an RGB image; an image of one channel as it is."""
    if image.ndim == 2:
        return image
    return np.floor(image[..., :3].astype(np.float64) @ [0.299, 0.587, 0.114] + 0.5).astype(np.uint8)


def enlarged(image, factor):
    """Bilinear enlargement by pixel centres; nothing for a factor of 1 or less."""
    if factor <= 1:
        return image
    size = [int(n * factor) for n in image.shape[:2]]
    at = [np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in zip(size, image.shape)]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(a + 1, n - 1) for a, n in zip(low, image.shape)]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    v = image.astype(np.float64)
    top = v[low[0]][:, low[1]] * (1 - fx) + v[low[0]][:, high[1]] * fx
    end = v[high[0]][:, low[1]] * (1 - fx) + v[high[0]][:, high[1]] * fx
    return np.floor(top * (1 - fy) + end * fy + 0.5).astype(np.uint8)


def contrast(image, clip=fixed.CLIP, tiles=fixed.TILES):
    """Contrast-limited adaptive histogram equalisation."""
    h, w = image.shape
    if not h or not w:
        return image
    padded = np.pad(image, ((0, -h % tiles), (0, -w % tiles)), mode="reflect" if min(h, w) > tiles else "edge")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            rest = over % 256
            if rest:
                counts[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(counts) * 255.0 / (th * tw)), 0, 255)
    ys, xs = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    a, b = np.clip(y0, 0, tiles - 1)[:, None], np.clip(y0 + 1, 0, tiles - 1)[:, None]
    c, d = np.clip(x0, 0, tiles - 1)[None, :], np.clip(x0 + 1, 0, tiles - 1)[None, :]
    value = (maps[a, c, image] * (1 - fx) + maps[a, d, image] * fx) * (1 - fy) + (maps[b, c, image] * (1 - fx) + maps[b, d, image] * fx) * fy
    return np.clip(np.rint(value), 0, 255).astype(np.uint8)


def sharpened(image, strength=fixed.SHARPEN):
    """Five times each pixel less its four neighbours, blended with the pixel; edges mirrored."""
    v = image.astype(np.float32)
    p = np.pad(v, 1, mode="reflect") if min(v.shape) > 1 else np.pad(v, 1, mode="edge")
    edge = 5 * v - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    return np.clip(v * np.float32(1 - strength) + edge * np.float32(strength), 0, 255).astype(np.uint8)


def otsu_level(image):
    """The grey level that parts an image into the two most different classes."""
    p = np.bincount(image.ravel(), minlength=256) / image.size
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight - mean) ** 2 / (weight * (1 - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def black_and_white(image):
    return np.where(image > otsu_level(image), 255, 0).astype(np.uint8) if image.size else image


def closed(image):
    """Closing with a 2 x 2 square: dilation to the lower right, erosion back."""
    p = np.pad(image, ((1, 0), (1, 0)), constant_values=0)
    wide = np.maximum.reduce([p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]])
    p = np.pad(wide, ((0, 1), (0, 1)), constant_values=255)
    return np.minimum.reduce([p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]])


def bordered(image, width=fixed.BORDER, level=255):
    edge = ((width, width), (width, width)) + ((0, 0),) * (image.ndim - 2)
    return np.pad(image, edge, constant_values=level)


def prepared(rgb, factor=1.0, keep_grey=False):
    """All steps on one image."""
    image = sharpened(contrast(enlarged(grey(rgb), factor)))
    return bordered(image if keep_grey else closed(black_and_white(image)))


def prepare(pages: DataFrame, factor=1.0, keep_grey=False, image="image") -> DataFrame:
    """Pages whose image struct (height, width, channels, data) is prepared; a null image stays null. One pass in Arrow."""
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(image)
            out = []
            for v in b.column(at).to_pylist():
                if v is None or v["data"] is None:
                    out.append(None)
                    continue
                shape = (v["height"], v["width"], v["channels"]) if v["channels"] > 1 else (v["height"], v["width"])
                new = prepared(np.frombuffer(v["data"], np.uint8).reshape(shape), factor, keep_grey)
                out.append({"height": new.shape[0], "width": new.shape[1], "channels": 1, "data": new.tobytes()})
            yield b.set_column(at, pa.field(image, kind), pa.array(out, kind))

    others = [f for f in pages.schema.fields if f.name != image]
    names = [f.name for f in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{image}` struct<height:int,width:int,channels:int,data:binary>"])
    return pages.select(*names, image).mapInArrow(run, schema)

"""Boxes: back to the original image, padding, usable sizes."""

from pyspark.sql import functions as F

from . import fixed
from .chars import col


def _whole(x):
    """Towards zero."""
    return x.cast("double").cast("int")


def to_original(left, top, width, height, scale, border, image_width, image_height, padding=fixed.PADDING):
    """struct(left, top, width, height) in the original image of a box in the prepared one."""
    left, top, width, height, scale, border, image_width, image_height = map(col, (left, top, width, height, scale, border, image_width, image_height))

    def side(at, size, whole):
        start = F.least(F.greatest(F.lit(0), _whole((at - padding - border) / scale)), whole - 4)
        return start, F.least(F.greatest(F.lit(4), _whole((size + 2 * padding) / scale)), whole - start)

    (x, w), (y, h) = side(left, width, image_width), side(top, height, image_height)
    return F.struct(x.alias("left"), y.alias("top"), w.alias("width"), h.alias("height"))


def padded(left, top, width, height, image_width, image_height, padding=fixed.PADDING):
    """struct(left, top, width, height) of a box with padding, inside the image."""
    left, top, width, height, image_width, image_height = map(col, (left, top, width, height, image_width, image_height))

    def side(at, size, whole):
        start = F.greatest(F.lit(0), at - padding)
        return start, F.least(whole, at + size + padding) - start

    (x, w), (y, h) = side(left, width, image_width), side(top, height, image_height)
    return F.struct(x.alias("left"), y.alias("top"), w.alias("width"), h.alias("height"))


def at_least(width, height, least):
    """4 for a candidate, 2 for a crop."""
    return (col(width) >= least) & (col(height) >= least)


def usable(present, scale, width, height):
    """Whether the original image can be read instead of the prepared one."""
    return col(present) & (col(scale) > 0) & (col(width) > 0) & (col(height) > 0)

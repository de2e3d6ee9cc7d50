"""The recogniser as an interface: an engine is a function that travels to the executors.

``engine(image, lang, config, table) -> str`` gets a numpy image and gives text,
or a tab-separated word table where ``table`` is true. It runs inside one Arrow
function for each page; an exception makes the reading null, never the task
fail. ``tesseract`` is such an engine where its libraries are installed.
"""

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed
from . import images


@dataclass(frozen=True)
class Options:
    """Settings that the environment may change; frozen, so they travel with the job."""

    command: str = "/usr/bin/tesseract"
    two_pass: bool = False
    timeout: int = fixed.TIMEOUT_S
    padding: int = fixed.PADDING
    ascii_least: float = fixed.ASCII_LEAST
    replacements_most: int = fixed.REPLACEMENTS_MOST
    enlarge: float = 1.0
    keep_grey: bool = False
    lang: str = "kor"
    second_lang: str = "eng"
    extra: dict = field(default_factory=dict, hash=False)

    @classmethod
    def from_environment(cls, env):
        yes = lambda name: env.get(name, "0").lower() in ("1", "true", "yes")
        return cls(
            command=env.get("TESSERACT_CMD", cls.command),
            two_pass=yes("OCR_2PASS"),
            timeout=int(env.get("OCR_TESSERACT_TIMEOUT", cls.timeout)),
            padding=int(env.get("OCR_CROP_PADDING", cls.padding)),
            ascii_least=float(env.get("OCR_ENG_ASCII_MIN", cls.ascii_least)),
            replacements_most=int(env.get("OCR_ENG_ROI_MAX", cls.replacements_most)),
            enlarge=float(env.get("OCR_UPSCALE", cls.enlarge)),
            keep_grey=yes("OCR_USE_GRAY"),
        )


def engine_config(words_file=None, patterns_file=None):
    """Settings of the first recognition, with user files where they are given."""
    return with_files(fixed.ENGINE, words_file, patterns_file)


def with_files(config, words_file=None, patterns_file=None):
    if words_file:
        config += f" -c user_words_file={words_file}"
    if patterns_file:
        config += f" -c user_patterns_file={patterns_file}"
    return config.strip()


def with_mode(config, mode):
    """The settings with another page mode."""
    return (re.sub(r"--psm\s+\d+", "", config).strip() + f" --psm {mode}").strip()


def tesseract(options):
    """An engine on pytesseract; fails with a clear message where that is not installed."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("the tesseract engine needs pytesseract and Pillow on driver and executors") from e

    def run(image, lang, config, table=False):
        pytesseract.pytesseract.tesseract_cmd = options.command
        read = pytesseract.image_to_data if table else pytesseract.image_to_string
        return read(Image.fromarray(image), lang=lang, config=config, timeout=options.timeout)

    return run


def cropped(image, box):
    """The part of an image, None if it is under two pixels."""
    left, top, width, height = box
    if width < 2 or height < 2:
        return None
    part = image[max(0, top) : top + height, max(0, left) : left + width]
    return part if part.shape[0] and part.shape[1] else None


def attempt(engine, *args):
    """The stripped reading, None where the engine failed."""
    try:
        return engine(*args)
    except Exception:  # an engine may raise anything; a page must never stop the job
        return None


def _array(v):
    shape = (v["height"], v["width"], v["channels"]) if v["channels"] > 1 else (v["height"], v["width"])
    return np.frombuffer(v["data"], np.uint8).reshape(shape)


def read_pages(pages: DataFrame, engine, options=Options(), config=None, image="image") -> DataFrame:
    """Adds base_text and tsv of each page's prepared image; null where the engine failed.

    The word table is only asked for where the first reading found something.
    """
    config = config or engine_config()
    added = [pa.field("base_text", pa.string()), pa.field("tsv", pa.string())]

    def run(batches):
        for b in batches:
            texts, tables = [], []
            for v in b.column(b.schema.get_field_index(image)).to_pylist():
                text = table = None
                if v is not None and v["data"] is not None:
                    pixels = _array(v)
                    text = attempt(engine, pixels, options.lang, config, False)
                    text = None if text is None else text.strip()
                    table = attempt(engine, pixels, options.lang, config, True) if text else None
                texts.append(text)
                tables.append(table)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(tables, pa.string())], schema=pa.schema([*b.schema, *added]))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields] + ["base_text string", "tsv string"])
    return pages.mapInArrow(run, schema)


def read_boxes(pages: DataFrame, engine, boxes, out="first_readings", options=Options(), config=None, image="image", modes=None, lang=None) -> DataFrame:
    """Adds an array of readings, one for each struct (left, top, width, height) of the array ``boxes``.

    ``modes``: an array of page modes beside the boxes; 8, a word, without it.
    """
    config = config or engine_config()
    lang = lang or options.second_lang

    def run(batches):
        for b in batches:
            found = []
            at = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in (image, boxes, *([modes] if modes else []))}
            for k in range(b.num_rows):
                v, places = at[image][k], at[boxes][k]
                if v is None or v["data"] is None or places is None:
                    found.append(None)
                    continue
                pixels, mine = _array(v), []
                for n, p in enumerate(places):
                    part = cropped(pixels, (p["left"], p["top"], p["width"], p["height"]))
                    mode = at[modes][k][n] if modes else 8
                    text = None if part is None else attempt(engine, images.grey(part), lang, with_mode(config, mode), False)
                    mine.append((text or "").strip())
                found.append(mine)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], schema=pa.schema([*b.schema, pa.field(out, pa.list_(pa.string()))]))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields] + [f"`{out}` array<string>"])
    return pages.mapInArrow(run, schema)

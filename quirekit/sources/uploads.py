"""Uploaded files and their pages."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed
from ..operators import pages as page_ops

PAGE = "path string, page int, total int, layer_text string, error string, image struct<height:int,width:int,channels:int,data:binary>"


def read_files(spark, path, glob="*"):
    """Files as rows (path, modificationTime, length, content), a reason beside those that are refused. Spark lists no files of zero bytes."""
    return page_ops.accepted_uploads(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def stream_files(spark, path, glob="*.pdf"):
    """The same as a stream of files that arrive in a folder."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
    return page_ops.accepted_uploads(source.schema("path string, modificationTime timestamp, length long, content binary").load(path))


def fitz_pages(content, dpi=fixed.DPI, render=True):
    """(page, total, text layer, RGB array or None, error) of a PDF, by PyMuPDF where that is installed."""
    try:
        import fitz
        import numpy as np
    except ImportError as e:
        raise RuntimeError("reading PDF pages needs PyMuPDF on the executors") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc):
            try:
                pixels = None
                if render:
                    p = page.get_pixmap(dpi=dpi, alpha=False)
                    pixels = np.frombuffer(p.samples, np.uint8).reshape(p.height, p.width, 3)
                yield n + 1, len(doc), page.get_text().strip(), pixels, None
            except Exception as e:  # one bad page must not lose the others
                yield n + 1, len(doc), None, None, str(e)


def pages_of(files: DataFrame, opener=fitz_pages) -> DataFrame:
    """One row for each page of the accepted files. ``opener(content)`` yields pages as fitz_pages does.

    A file that cannot be opened, or breaks off, has one row more: the next page, with the error. A missing library still fails the job.
    """
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("total", pa.int32()), ("layer_text", pa.string()), ("error", pa.string()), ("image", kind)])

    def opened(content):
        at = last = 0
        try:
            for row in opener(content):
                at, last = row[0], row[1]
                yield row
        except (RuntimeError, ImportError) as e:
            if isinstance(e, ImportError) or isinstance(e.__cause__, ImportError):
                raise
            yield at + 1, max(last, at + 1), None, None, str(e)
        except Exception as e:  # one bad file must not lose the others
            yield at + 1, max(last, at + 1), None, None, str(e)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for page, total, text, pixels, error in opened(content):
                    image = None
                    if pixels is not None:
                        image = {"height": pixels.shape[0], "width": pixels.shape[1], "channels": 1 if pixels.ndim == 2 else pixels.shape[2], "data": pixels.tobytes()}
                    yield pa.RecordBatch.from_pylist([{"path": path, "page": page, "total": total, "layer_text": text, "error": error, "image": image}], schema=schema)

    return files.where("reject IS NULL").select("path", "content").mapInArrow(run, PAGE)


def text_or_file(value):
    """A text, or what the file of that name holds: texts with line breaks or over 512 characters are never names."""
    if "\n" in value or len(value) > 512 or not os.path.exists(value):
        return value
    with open(value, encoding="utf-8") as f:
        return f.read()


def model_dirs(isdir=os.path.isdir, found=()):
    """Folders of engine models that exist, then those a search found; none twice."""
    out = [d for d in fixed.MODEL_DIRS if isdir(d)]
    return out + [d for d in dict.fromkeys(found) if d not in out]


def best_models(dirs, size):
    """Whether a folder holds models of the large kind, and what was found.

    ``size(folder, lang)``: bytes of a model, or None. A later folder's model
    of one language replaces an earlier one's; the search ends at the first folder with both large.
    """
    kor = eng = False
    seen = []
    for d in dirs:
        k, e = size(d, "kor"), size(d, "eng")
        if k is not None:
            kor = k / 2**20 >= fixed.BEST_KOR_MB
            seen.append(f"kor {k / 2**20:.1f} MB")
        if e is not None:
            eng = e / 2**20 >= fixed.BEST_ENG_MB
            seen.append(f"eng {e / 2**20:.1f} MB")
        if kor and eng:
            break
    return bool(seen) and kor and eng, "; ".join(seen) or "no model found"

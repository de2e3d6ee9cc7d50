"""Word tables, alignment, pages, images, recognisers and the stream against brute force."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirekit.functions import chars, english, fixed, geometry
from quirekit.operators import align, images, pages, recognise, words
from quirekit.sources import sinks, uploads
from quirekit.streaming import fold


def py_script(a, b, same=lambda x, y: x == y):
    n, m = len(a), len(b)
    d = {(i, 0): i for i in range(n + 1)} | {(0, j): j for j in range(m + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same(a[i - 1], b[j - 1])))
    out, at = [], (n, m)
    while at != (0, 0):
        i, j = at
        if i and j and same(a[i - 1], b[j - 1]) and d[at] == d[i - 1, j - 1]:
            op, at = ("m", a[i - 1], b[j - 1]), (i - 1, j - 1)
        elif i and j and d[at] == d[i - 1, j - 1] + 1:
            op, at = ("s", a[i - 1], b[j - 1]), (i - 1, j - 1)
        elif j and d[at] == d[i, j - 1] + 1:
            op, at = ("i", "", b[j - 1]), (i, j - 1)
        else:
            op, at = ("d", a[i - 1], ""), (i - 1, j)
        out.append(op)
    return out[::-1]


def test_edit_scripts(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(align, "_STRIDE_LEAST", 2)
    for k in range(300):
        a, b = ("".join(rng.choices("ab가 \n🙂", k=rng.randrange(14))) for _ in range(2))
        assert align.edit_script(a, b) == py_script(a, b)
        assert align.edit_script(a, b, True) == py_script(a, b, lambda x, y: x == y or x.isspace() and y.isspace())
    long = "".join(rng.choices("abcdef", k=3000))
    script = align.edit_script(long, long.replace("a", ""))
    assert sum(o == "m" for o, _, _ in script) == len(long.replace("a", "")) and "".join(g for _, g, _ in script) == long


def kind(c):
    if len(c) != 1:
        return "other"
    n = ord(c)
    if 0xAC00 <= n <= 0xD7A3 or 0x1100 <= n <= 0x11FF or 0x3130 <= n <= 0x318F:
        return "korean"
    if c.isascii() and c.isalpha():
        return "english"
    if c.isascii() and c.isdigit():
        return "digit"
    return "chinese" if 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF else "other"


def test_rates(spark):
    rng = random.Random(5)
    pairs = [(i, *("".join(rng.choices("aB가나1 漢.", k=rng.randrange(12))) for _ in range(2))) for i in range(150)] + [(900, "", ""), (901, None, "x")]
    got = {r.k: r for r in align.report(align.recognition_rates(spark.createDataFrame(pairs, "k int, truth string, extracted string"), "k")).collect()}
    assert len(got) == len(pairs)
    for k, a, b in pairs:
        tally = {c: [0, 0] for c in align.CLASSES}
        ops = py_script(a, b) if a is not None else []
        for at, (op, g, r) in enumerate(ops):
            c = kind(g)
            if op == "i":
                near = next((x for _, x, _ in ops[at + 1 :] if x), None) or next((x for _, x, _ in ops[:at][::-1] if x), "")
                c = "other" if kind(r) == "other" else kind(near) if kind(near) != "other" else kind(r)
            if c != "other":
                tally[c][op != "m"] += 1
        for c in align.CLASSES:
            ok, bad = tally[c]
            v = got[k][c]
            assert (v.correct, v.wrong, v.gt_count) == (ok, bad, ok + bad)
            assert v.accuracy == (round(ok / (ok + bad) * 100, 1) if ok + bad else None)
    assert got[900].report.splitlines()[0] == "한글: 원본에 한글 없음 (N/A)"


def test_html_and_copy(spark):
    df = align.with_script(spark.createDataFrame([("a<가", "a&b"), ("x", "xy"), ("xy", "x")], "truth string, extracted string"))
    got = [r.h for r in df.select(align.diff_html().alias("h")).collect()]
    assert got[0].startswith("a<span") and "diff-wrong-kr" in got[0] and "&lt;" in got[0] and "&amp;" in got[0]
    assert got[1] == 'x<span class="diff-extracted-line diff-ins">y</span>'
    assert got[2].endswith('<span class="diff-extracted-line">·</span></span>')
    text = df.withColumn("r", F.lit("rates")).select(align.copy_text("truth", "extracted", "r").alias("t")).first().t
    assert text.splitlines()[2:4] == ["[원본]", "a<가"] and text.endswith("rates\n\n---")


def test_compare_pages(spark):
    read = spark.createDataFrame([(1, 1, "one"), (1, 2, "tw0"), (2, 1, "z"), (3, 3, "whole")], "doc_id int, page int, text string")
    truth = spark.createDataFrame([(1, " one\n\n\n two "), (2, "  "), (3, "whole")], "doc_id int, truth string")
    got = {(r.doc_id, r.page): r for r in align.compare(read, truth).collect()}
    assert got[1, 2].truth_part == "two" and got[1, 2].english.accuracy == 66.7 and got[1, 1].english.accuracy == 100.0
    assert got[2, 1].error == "no truth" and got[2, 1].html is None and got[3, 3].truth_part == "whole"


# Word tables.

HEAD = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"


def line(level, block, row, word, text, conf="90", left="10", width="30"):
    return "\t".join([str(level), str(block), str(row), str(word), "0", "0", left, "20", width, "12", conf, text])


def test_parse(spark):
    tsv = HEAD + "\n".join([line(5, 1, 1, 2, " b "), line(5, 1, 1, 1, "a", "-1"), line(5, 1, 1, 1, "tie"), line(4, 1, 2, 0, "row"), "short\tline", line(5, 1, "x", 1, "bad"), line(5, 1, 2, 1, "dec", "96.5"), line(5, 1, 2, 1, "big", " 7 "), line(3, 1, 1, 1, "no")]) + "\n"
    df = spark.createDataFrame([(tsv,), ("",), (HEAD,), (None,)], "tsv string")
    got = df.select(words.in_reading_order(words.finest(words.parse("tsv"))).alias("w")).collect()
    assert [(w.text, w.conf) for w in got[0].w] == [("a", 0), ("tie", 90), ("b", 90), ("big", 7)]
    assert got[1].w == [] and got[2].w == [] and not got[3].w
    only = HEAD + line(4, 1, 1, 0, "row")
    assert [w.text for w in spark.createDataFrame([(only,)], "tsv string").select(words.finest(words.parse("tsv", False)).alias("w")).first().w] == ["row"]


def py_layout(rows):
    parts, last = [], None
    for block, row, text in rows:
        if last is not None and (block, row) != last and parts and parts[-1] != "\n":
            parts.append("\n")
        last = block, row
        if text:
            if parts and parts[-1] != "\n":
                parts.append(" ")
            parts.append(text)
    return "".join(parts).strip()


def test_layout(spark):
    rng = random.Random(3)
    cases = [[(rng.randrange(2), rng.randrange(3), rng.choice(["", "a", "b c", "가"])) for _ in range(rng.randrange(8))] for _ in range(200)]
    df = spark.createDataFrame([(i, [{"block_num": b, "line_num": r, "text": t} for b, r, t in c]) for i, c in enumerate(cases)], "i int, w array<struct<block_num:int,line_num:int,text:string>>")
    for c, r in zip(cases, df.select("i", words.laid_out("w").alias("t")).orderBy("i").collect()):
        assert r.t == py_layout(c)


def test_splice(spark):
    rng = random.Random(4)
    cases = [("".join(rng.choices("ab가", k=12)), [(rng.choice(["a", "ab", "가", "zz"]), rng.choice(["X", "", "ab"])) for _ in range(5)]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, [{"old": a, "new": b} for a, b in c]) for i, (t, c) in enumerate(cases)], "i int, t string, c array<struct<old:string,new:string>>")
    for (t, c), r in zip(cases, df.select("i", words.spliced("t", "c").alias("out")).orderBy("i").collect()):
        pos = 0
        for a, b in c:
            at = t.find(a, pos)
            if at >= 0:
                t, pos = t[:at] + b + t[at + len(a) :], at + len(b)
        assert r.out == t


def test_two_stage_stops_at_the_limit(spark):
    n = fixed.REPLACEMENTS_MOST + 5
    tsv = HEAD + "\n".join(line(5, 1, 1, k, f"({k}" if k != 3 else "(가3") for k in range(n))
    base = " ".join(f"({k}" if k != 3 else "(가3" for k in range(n))
    pages_df = words.candidates(spark.createDataFrame([(base, tsv), (None, tsv), ("  ", "")], "base_text string, tsv string"))
    made = pages_df.withColumn("first_readings", F.transform("candidates", lambda w: F.when(w["text"] == "(5", "??").otherwise(F.concat(F.lit("Word"), F.translate(w["text"], "(0123456789", "abcdefghijk")))))
    made = made.withColumn("second_readings", F.transform("candidates", lambda w: F.when(w["text"] == "(5", "Second").otherwise("")))
    got = [r.text for r in words.two_stage(made).collect()]
    assert got[1] == "" and got[2] == ""
    parts = got[0].split()
    assert parts[3] == "(가3" and parts[5] == "Second"
    assert sum(not p.startswith("(") for p in parts) == fixed.REPLACEMENTS_MOST


def test_fallback(spark):
    df = spark.createDataFrame([(None, "b", "c"), ("", "b", "c"), (None, None, None)], "a string, b string, c string")
    assert [r.t for r in df.select(words.fallback("a", "b", "c").alias("t")).collect()] == ["c", "", ""]
    assert [r.t for r in df.select(words.fallback("a", "b", "c", True).alias("t")).collect()] == ["b", "", ""]


def test_boxes(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4000), rng.randrange(5000), rng.randrange(300), rng.randrange(80), rng.choice([0.7, 1.0, 1.5]), 10, 2480, 3508) for _ in range(300)]
    df = spark.createDataFrame(rows, "l int, t int, w int, h int, s double, b int, iw int, ih int")
    for (l, t, w, h, s, b, iw, ih), r in zip(rows, df.select(geometry.to_original(*df.columns).alias("x")).collect()):
        x, y = (min(max(0, int((v - 8 - b) / s)), n - 4) for v, n in ((l, iw), (t, ih)))
        assert tuple(r.x) == (x, y, min(max(4, int((w + 16) / s)), iw - x), min(max(4, int((h + 16) / s)), ih - y))


def test_better_reading(spark):
    df = spark.createDataFrame([("ab", "cd"), ("", "cd"), ("가", "1"), (None, None)], "a string, b string")
    assert [r.t for r in df.select(english.better("a", "b").alias("t")).collect()] == ["ab", "cd", "가", None]


# Pages, images, recognisers.


def test_uploads_and_pages(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"two")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = uploads.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.reject for r in files.collect()} == {"a.PDF": None, "c.txt": "not a PDF"}
    empty = spark.createDataFrame([("b.pdf", b""), ("d.pdf", None), (None, b"x")], "path string, content binary")
    assert [r.reject for r in pages.accepted_uploads(empty).collect()] == ["empty file", "empty file", "not a PDF"]

    def opener(content):
        yield 1, 2, "one two three four five six seven eight nine ten ", np.zeros((4, 5, 3), np.uint8), None
        yield 2, 2, None, None, "x" * 300

    found = uploads.pages_of(files, opener).withColumn("force_ocr", F.lit("no"))
    got = {r.page: r for r in pages.extracted(found, recognised=lambda p: p.withColumn("text", F.lit("read"))).collect()}
    assert got[1].method == "direct" and got[1].text.endswith("ten") and got[1].dpi is None
    assert got[2].method == "error" and len(got[2].error) == 200 and got[2].text == ""
    with pytest.raises(Exception, match="PyMuPDF"):
        uploads.pages_of(files).collect()


def test_a_bad_file_keeps_the_others(spark):
    def opener(content):
        if content == b"broken":
            raise ValueError("no PDF")
        yield 1, 3, "text", None, None
        if content == b"cut":
            raise OSError("ends here")
        yield 2, 3, "more", None, None

    files = spark.createDataFrame([("a.pdf", b"broken"), ("b.pdf", b"cut"), ("c.pdf", b"fine")], "path string, content binary").withColumn("reject", F.lit(None).cast("string"))
    got = {(r.path, r.page): (r.total, r.layer_text, r.error) for r in uploads.pages_of(files, opener).collect()}
    assert got == {("a.pdf", 1): (1, None, "no PDF"), ("b.pdf", 1): (3, "text", None), ("b.pdf", 2): (3, None, "ends here"), ("c.pdf", 1): (3, "text", None), ("c.pdf", 2): (3, "more", None)}


def test_done_fills_pages_without_an_event():
    rows = [{"page": 2, "total": 4, "method": "ocr", "text": "two"}, {"page": 3, "total": 4, "method": "started"}, {"done": True, "total": 4, "text": "a\n\nb\n\n\nc", "methods": []}]
    (total, found), done = fold.merged((0, {}), rows)
    row = fold.shown(total, found)
    assert done and row["complete"] and row["text"] == "a\n\ntwo\n\nc\n\n"
    assert row["methods"] == ["p2:ocr"] and row["status"] == ["done"] * 4


def test_tally_places_inserted_characters():
    script = lambda *o: [(k, a, b) for k, a, b in o]
    assert align.tally(script(("i", "", "7"), ("m", "a", "a")))["english"] == [2, 1, 1]
    assert align.tally(script(("m", "가", "가"), ("i", "", "x")))["korean"] == [2, 1, 1]
    assert align.tally(script(("m", "a", "a"), ("i", "", "x"), ("m", " ", " ")))["english"] == [2, 1, 1]
    assert align.tally(script(("i", "", "."), ("m", "a", "a")))["english"] == [1, 1, 0]
    assert align.tally(script(("i", "", "1"),))["digit"] == [1, 0, 1]
    assert align.tally([]) == {c: [0, 0, 0] for c in align.CLASSES}


def test_events_round_trip(spark, tmp_path):
    rows = [(1, 1, "a\n\nb", "direct", None, None), (1, 2, "", "error", None, "bad"), (2, 1, "é", "ocr", 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string, method string, dpi int, error string")
    made = pages.events(df)
    got = {k: [json.loads(r.event) for r in sorted(made.where(F.col("doc_id") == k).collect(), key=lambda r: r.seq)] for k in (1, 2)}
    assert got[1][0] == {"page": 0, "total": 2, "method": "started", "dpi": 300, "psm": 6}
    assert got[1][2] == {"page": 1, "total": 2, "method": "direct", "dpi": None, "text": "a\n\nb"}
    assert got[1][4] == {"page": 2, "total": 2, "method": "error", "error": "bad", "text": ""}
    assert got[1][5] == {"done": True, "total": 2, "text": "a\n\nb\n\n", "methods": ["p1:direct", "p2:error"]}
    sinks.write_events(made, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 10


def test_stream_fold(spark, tmp_path):
    def event(doc, **e):
        return (doc, json.dumps(e))

    lines = [event(1, page=0, total=2, method="started"), event(1, page=2, total=2, method="ocr", text="old"), event(1, page=2, total=2, method="ocr", text="new"), event(1, page=1, total=2, method="direct", text="a\n\nb"), event(2, page=1, total=3, method="started"), event(3, page=1, total=2, method="error", text=""), event(3, done=True, total=2, text="x", methods=[])]
    source = str(tmp_path / "in")
    spark.createDataFrame(lines, "doc_id long, event string").coalesce(1).write.parquet(source)
    stream = fold.fold(fold.parsed(spark.readStream.schema("doc_id long, event string").parquet(source)), patience="1 second")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 90
        while spark.table("folded").count() < 3 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {r.doc_id: r for r in spark.table("folded").collect()}
    assert got[1].complete and got[1].text == "a\n\nb\n\nnew" and got[1].methods == ["p1:direct", "p2:ocr"] and got[1].status == ["done-direct", "done"]
    # The done event's text has one part, so the page without an event is empty but there.
    assert got[3].complete and got[3].status == ["error", "done"] and got[3].received == 2 and got[3].methods == ["p1:error"]
    assert not got[2].complete and got[2].status == ["working", "waiting", "waiting"]


def test_display(spark):
    df = spark.createDataFrame([(0, 0, 61_000, "direct"), (1, 3, 3_600_000, "x"), (2, 3, 999, None)], "page int, total int, ms long, method string")
    got = df.select(pages.progress().alias("p"), pages.minutes_seconds("ms").alias("t"), pages.method_label("method").alias("m"), pages.mean_per_page("ms", "page").alias("a"), pages.status(F.col("page") > 0, "method", F.lit(True)).alias("s")).collect()
    assert [tuple(r) for r in got] == [(0, "01:01", "직접", None, "working"), (33, "60:00", "x", 3_600_000, "done"), (67, "00:00", "", 500, "done")]


def test_image_steps():
    rng = np.random.RandomState(1)
    rgb = rng.randint(0, 256, (37, 53, 3)).astype(np.uint8)
    g = images.grey(rgb)
    assert g.shape == (37, 53) and abs(int(g[0, 0]) - rgb[0, 0] @ [0.299, 0.587, 0.114]) <= 1
    assert images.enlarged(g, 1.0) is g and images.enlarged(g, 2.0).shape == (74, 106)
    flat = np.full((40, 40), 90, np.uint8)
    assert (images.sharpened(flat) == 90).all() and (images.enlarged(flat, 1.5) == 90).all()
    two = np.where(np.arange(400).reshape(20, 20) % 7 < 3, 40, 200).astype(np.uint8)
    assert set(np.unique(images.black_and_white(two))) == {0, 255} and 40 <= images.otsu_level(two) < 200
    best = max(range(255), key=lambda t: _between(g, t))
    assert abs(_between(g, images.otsu_level(g)) - _between(g, best)) < 1e-6
    dots = np.zeros((6, 6), np.uint8)
    dots[2, 2] = dots[2, 4] = 255
    assert images.closed(dots)[2, 3] == 255 and (images.closed(dots) >= dots).all() and not images.closed(dots)[4:].any()
    done = images.prepared(rgb)
    assert done.shape == (57, 73) and set(np.unique(done)) <= {0, 255} and (done[:10] == 255).all()


def _between(g, t):
    low, high = g[g <= t].astype(float), g[g > t].astype(float)
    return len(low) * len(high) * (low.mean() - high.mean()) ** 2 / g.size**2 if len(low) and len(high) else 0.0


def test_recogniser_interface(spark):
    tsv = HEAD + line(5, 1, 1, 1, "(1", left="2", width="6")

    def engine(image, lang, config, table=False):
        if image.shape[0] == 30:
            raise ValueError("page that fails")
        return tsv if table else " base (1 " if lang == "kor" else "Word" if "--psm 8" in config and "--psm 6" not in config else "?"

    rows = [(i, {"height": h, "width": 40, "channels": 3, "data": bytes(h * 40 * 3)}) for i, h in enumerate((40, 30))] + [(2, None)]
    df = spark.createDataFrame(rows, "page int, image struct<height:int,width:int,channels:int,data:binary>")
    read = words.candidates(recognise.read_pages(images.prepare(df), engine))
    read = recognise.read_boxes(read, engine, "candidates").withColumn("second_readings", F.lit(None).cast("array<string>"))
    got = {r.page: r for r in words.two_stage(read).collect()}
    assert got[0].text == "base Word" and got[1].base_text == "base (1" and got[2].base_text is None and got[2].text == ""
    raw = {r.page: r for r in recognise.read_pages(df, engine).collect()}
    assert raw[1].base_text is None and raw[1].tsv is None and raw[0].tsv == tsv
    assert recognise.with_mode(recognise.engine_config("w", "p"), 8).endswith("user_patterns_file=p --psm 8")
    assert recognise.Options.from_environment({"OCR_2PASS": "Yes", "OCR_UPSCALE": "1.5"}) == recognise.Options(two_pass=True, enlarge=1.5)
    assert recognise.cropped(np.zeros((9, 9)), (0, 0, 1, 5)) is None


def test_models_and_texts(tmp_path):
    size = lambda d, lang: {"a": {"kor": 12 * 2**20}, "b": {"eng": 5 * 2**20}, "c": {"kor": 2**20}}[d].get(lang)
    assert uploads.best_models("ab", size)[0] and not uploads.best_models("ca", size)[0] and uploads.best_models([], size) == (False, "no model found")
    assert uploads.model_dirs(lambda d: d == "/usr/share/tessdata", ["/x", "/usr/share/tessdata"]) == ["/usr/share/tessdata", "/x"]
    (tmp_path / "t").write_text("inside")
    assert uploads.text_or_file(str(tmp_path / "t")) == "inside" and uploads.text_or_file("a\nb") == "a\nb"


def test_hangul(spark):
    df = spark.createDataFrame([("각",), ("가",), ("a",), ("가나",), (None,)], "c string").withColumn("s", chars.split_syllable("c"))
    got = df.select("s", chars.is_syllable("c").alias("y"), chars.join_syllable("s.initial", "s.medial", "s.final").alias("j")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [("ㄱ", "ㅏ", "ㄱ"), ("ㄱ", "ㅏ", " "), None, None, None]
    assert [r.y for r in got] == [True, True, False, False, False] and [r.j for r in got] == ["각", "가", "", "", ""]

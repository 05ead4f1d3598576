"""Readers of files, discovery, reports, verification and evaluation."""

import json
import os
import struct
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tamis import cli
from tamis.operators import evaluation, verify
from tamis.operators import findings as fd
from tamis.plans import scan
from tamis.sources import discover, images, pdf, sinks
from tamis.sources.extract import extract_all


def pdf_file(pages, extra=b"", info=b"", objects=b""):
    """A PDF of pages' content streams, deflated, with a font F1 in the tree's resources."""
    n, out = len(pages), [b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj"]
    out.append(b"2 0 obj<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + k) for k in range(n)) + b"]/Resources<</Font<</F1 5 0 R>>/XObject<</X1 6 0 R>>>>>>endobj")
    out.append(b"5 0 obj<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding" + extra + b">>endobj" + objects)
    for k, p in enumerate(pages):
        z = zlib.compress(p)
        out.append(b"%d 0 obj<</Type/Page/Parent 2 0 R/Contents %d 0 R>>endobj %d 0 obj<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj" % (10 + k, 100 + k, 100 + k, len(z), z))
    return b"\n".join([*out, b"9 0 obj<<" + info + b">>endobj trailer<</Root 1 0 R/Info 9 0 R>>\n%%EOF"])


def test_pdf():
    data = pdf_file([b"BT /F1 12 Tf (SIN \\(Canada\\): 757) Tj [(036) -300 (79) (3)] TJ 0 -14 Td (caf\\351) Tj ET", b"BT /F1 9 Tf 1 0 0 1 50 700 Tm <4869> Tj 1 0 0 1 90 700 Tm (there) Tj 1 0 0 1 50 680 Tm (x@example.org) Tj ET"], info=b"/Title(T)/Author<feff00c9>/CreationDate(D:20240101123000-05)/ModDate(D:2024)")
    assert pdf.pdf(data) == "SIN (Canada): 757036 793\ncafé\n\nHi there\nx@example.org"
    assert pdf.pdf_metadata(data) == {"title": "T", "author": "É", "created": "2024-01-01T12:30:00", "modified": "2024-01-01T00:00:00", "page_count": "2"}
    assert extract_all("pdf", data)[1] == "scanned" and extract_all("pdf", data)[3]["page_count"] == "2"
    asked = []
    text = pdf.pdf(data, lambda d, k: asked.append(k) or "scanned words")
    assert asked == [0, 1] and "scanned words" in text
    for bad in (b"no", b"%PDF-1.4 nothing", data.replace(b"trailer<<", b"trailer<</Encrypt 7 0 R"), b"%PDF" + data[8:40]):
        assert extract_all("pdf", bad)[1] == "extraction_failed"


def test_pdf_fonts_and_objects():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0053> <0002> <0049> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    fonts = b" 7 0 obj<</Length %d>>stream\n%s\nendstream endobj" % (len(cmap), cmap)
    wide = pdf_file([b"BT /F1 1 Tf <0001000200100011> Tj ET"], objects=fonts).replace(b"/Subtype/Type1/Encoding/WinAnsiEncoding", b"/Subtype/Type0/ToUnicode 7 0 R")
    assert pdf.pdf(wide) == "SIAB"
    named = pdf_file([b"BT /F1 1 Tf <010203> Tj ET"]).replace(b"/Encoding/WinAnsiEncoding", b"/Encoding<</Differences[1/A/uni00E9/seven]>>")
    assert pdf.pdf(named) == "Aé7"
    form = b" 6 0 obj<</Subtype/Form/Length 30>>stream\nBT /F1 1 Tf (inside a form) Tj ET\nendstream endobj"
    assert pdf.pdf(pdf_file([b"/X1 Do BI /W 1 ID (x EI BT (after) Tj ET"], objects=form)) == "inside a form\nafter"
    body = b"2 0 5 31 <</Type/Pages/Kids[10 0 R]>>    "
    packed = zlib.compress(b"2 0 5 36 " + b"<</Type/Pages/Kids[10 0 R]>>".ljust(36) + b"<</Type/Font/Subtype/Type1>>")
    stream = b"%PDF-1.5 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 3 0 obj<</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>stream\r\n" + packed + b"\nendstream endobj 10 0 obj<</Type/Page/Contents 11 0 R>>endobj 11 0 obj<</Length 22>>stream\nBT (packed objects) Tj ET\nendstream endobj"
    assert pdf.pdf(stream) == "packed objects" and body
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert pdf.predicted(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0) + b"\0" * 8 + b"pHYs" + struct.pack(">IIB", 11811, 11811, 1)


def tiff(frames):
    out, at = b"II" + struct.pack("<HI", 42, 8), 8
    for k in range(frames):
        entries = [(256, 3, 1, 30 + k), (257, 3, 1, 20), (277, 3, 1, 3)]
        at += 2 + 12 * len(entries) + 4
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", at if k + 1 < frames else 0)
    return out


def test_images():
    known = images.metadata(png(40, 30))
    assert (known["format"], known["width"], known["height"], known["mode"], known["dpi"]) == ("PNG", "40", "30", "RGB", "300x300")
    exif = b"Exif\0\0II" + struct.pack("<HI", 42, 8) + struct.pack("<HHHII", 1, 0x010F, 2, 4, int.from_bytes(b"Cam\0", "little")) + struct.pack("<I", 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 16, 24, 1) + b"\1\x11\0"
    known = images.metadata(jpeg)
    assert (known["format"], known["width"], known["height"], known["mode"], known["exif_make"]) == ("JPEG", "24", "16", "L", "Cam")
    assert images.metadata(tiff(3))["frames"] == "3" and images.metadata(b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 10)["width"] == "5"
    assert images.of_lines([("abcd", 1.0), (" ", 0.1), ("ab", 0.4)]) == ("abcd\nab", pytest.approx(80.0))
    assert images.of_frames([("abc", 90.0), ("", 10.0), ("a", 50.0)]) == ("abc\n\na", pytest.approx(80.0)) and images.of_frames([("", 90.0), ("", 10.0)])[1] == 50.0
    ocr = lambda data, k: [(f"frame {k}", 0.9)]
    text, status, _, known = extract_all("tif", tiff(2), {"ocr": ocr, "faces": lambda d: 2})
    assert (text, status, known["faces_detected"], known["ocr_confidence"]) == ("frame 0\n\nframe 1", "scanned", "2", "90.0000")
    assert extract_all("png", png(1, 1))[1] == "extraction_failed" and extract_all("png", b"??", {"ocr": ocr})[1] == "extraction_failed"


def test_discovery(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "out/2024").mkdir(parents=True)
    for name in ("z.txt", "b/a.MD", "b/n.pdf", "out/report.md", "out/2024/x.html", "odd.xyz"):
        (tmp_path / name).write_text("SIN: 757 036 793")
    (tmp_path / "big.txt").write_text("x" * 3000)
    (tmp_path / "binary.csv").write_bytes(b"\0" * 9000)
    os.symlink(tmp_path / "z.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "b", tmp_path / "linked")
    found, skipped, out = discover.walk(str(tmp_path), (str(tmp_path / "out"),))
    assert [os.path.basename(p) for p, _ in found] == ["a.MD", "n.pdf", "big.txt", "binary.csv", "odd.xyz", "z.txt"] and out == 2
    assert {os.path.basename(p) for p, _ in skipped} == {"link.txt", "linked"}
    good, left, _ = discover.discover(spark, str(tmp_path), ("txt", ".md", "csv", "xyz"), 0.002, (str(tmp_path / "out"),))
    assert {os.path.basename(r["path"]) for r in good.collect()} == {"a.MD", "z.txt"}
    reasons = {(r["path"] and os.path.basename(r["path"]), r["reason"], r["count"]) for r in left.collect()}
    assert reasons == {("link.txt", "symlink", 1), ("linked", "symlink", 1), ("big.txt", "too_large", 1), ("binary.csv", "binary content", 1), (None, "filtered", 1)}
    rows = good.select("path", "ext").collect()
    (tmp_path / "z.txt").unlink()
    texts = {os.path.basename(r["path"]): r for r in discover.read_local(spark.createDataFrame(rows)).collect()}
    assert texts["z.txt"]["scan_status"] == "extraction_failed" and "FileNotFoundError" in texts["z.txt"]["failure_reason"] and texts["a.MD"]["text"]
    gone = spark.createDataFrame([(str(tmp_path / "never.txt"), "txt")], "path string, ext string")
    assert discover.read_local(gone).first()["scan_status"] == "extraction_failed"
    with pytest.raises(FileNotFoundError):
        discover.walk(str(tmp_path / "none"))
    one = scan.scan_path(spark, str(tmp_path / "b/a.MD"), layers=("regex", "keyword_context"))
    assert one["file_scores"].first()["band"] == "HIGH"
    by_store = scan.scan_folder(spark, f"file://{tmp_path}/b", ("regex",), ("md",))
    assert by_store["scan_summary"].first()["scanned"] == 1


class Chat(BaseHTTPRequestHandler):
    asked: list = []

    def _say(self, data):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(data).encode())

    def do_GET(self):  # noqa: N802
        self._say({"models": [{"name": "small:1b"}]})

    def do_POST(self):  # noqa: N802
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        question = json.loads(said["messages"][1]["content"])
        Chat.asked.append(question["value"])
        good = question["value"].endswith("6")
        verdict = "LEGITIMATE" if good else "FALSE_POSITIVE" if question["value"].endswith("7") else "perhaps"
        self._say({"message": {"content": f'Sure: {{"verdict": "{verdict}", "reason": "so"}} .'}})

    def log_message(self, *_):
        pass


def test_verification(spark):
    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert verify.available(url, "small") == (True, "enabled") and verify.available(url, "large")[0] is False
        assert verify.available(url, "small", False) == (False, "disabled") and verify.available("http://127.0.0.1:1", "small")[1].startswith("skipped")
        docs = spark.createDataFrame([(k, f"Passport AB12345{k} was shown") for k in (8, 6, 7)], "doc_id int, text string")
        results = scan.scan_documents(docs, ("passport",))
        said = verify.ask(fd.explode_findings(results), results, verify.chat_judge(url, "small")).collect()
    finally:
        server.shutdown()
    assert {(r["doc_id"], r["verdict"]) for r in said} == {(6, "LEGITIMATE"), (7, "FALSE_POSITIVE"), (8, "ERROR")}
    assert Chat.asked == ["AB123456", "AB123457", "AB123458", "AB123458"]  # in order, and once more where the answer is none
    out = verify.rescored(results, spark.createDataFrame(said))
    scores = {r["doc_id"]: r["band"] for r in fd.file_scores(out).collect()}
    assert scores == {6: "HIGH", 7: "LOW", 8: "HIGH"}
    part = verify.report_part(fd.explode_findings(out), "enabled", "small")
    assert (part["routed"], part["demoted"], part["errors"]) == (3, 1, 1) and part["demoted_findings"][0]["original_risk_level"] == "HIGH"
    assert verify.json_in('x {"a": 1} y') == {"a": 1} and verify.json_in("{") is None and verify.json_in(None) is None


def test_evaluation(spark):
    want = spark.createDataFrame([("d", "Anna Smith"), ("d", "Bo"), ("e", "x@y.org")], "doc_id string, value string")
    got = spark.createDataFrame([("d", "anna"), ("d", "anna smith"), ("f", "z")], "doc_id string, value string")
    rows = {r["id"]: (r["hits"], r["missed"], r["extra"]) for r in evaluation.matched(want, got).collect()}
    assert rows == {"d": (1, 1, 1), "e": (0, 1, 0), "f": (0, 0, 1)}
    a, b = (spark.createDataFrame([(x,) for x in v], "c string") for v in ("aab", "abc"))
    assert {tuple(r) for r in evaluation.multiset_difference(a, b, ["c"]).collect()} == {("a", 1, 0), ("c", 0, 1)}
    rows = spark.createDataFrame([("POSITIVE", "health_card", "ON", "PASS"), ("POSITIVE", "health_card", "ON", "VALUE-MISMATCH"), ("NEGATIVE", "health_card", "ON", "PASS"), ("POSITIVE", "passport", "CA", "PASS")], "verdict string, doc_type string, jurisdiction string, outcome string")
    r = evaluation.by_jurisdiction(rows).collect()
    assert len(r) == 1 and (r[0]["total"], r[0]["pass"], r[0]["value_mismatch"]) == (2, 1, 1)
    verified = spark.createDataFrame([("c", "s", True, "HIGH"), ("c", "s", True, None), ("c", "s", False, None)], "category string, source string, routed boolean, original_risk_level string")
    assert [tuple(x) for x in evaluation.demotions(verified).collect()] == [("c", "s", 2, 1, 1)]


def test_helpers_of_reports():
    assert sinks.shortened("abcdefghij", 5) == "ab…ij" and sinks.shortened("abc", 5) == "abc" and len(sinks.shortened("x" * 99)) == 40
    assert (sinks.safe_score("70"), sinks.safe_score(None), sinks.safe_score("x"), sinks.safe_score(float("nan"))) == (70, 0, 0, 0)
    assert sinks.layer_banner() == f"Detection layers: all 11 active ({', '.join(sorted(fd.dims.LAYERS))})"
    assert sinks.resource_banner({}) is None and "2 workers" in sinks.resource_banner({"peak_rss_mb": 10, "workers": 2})
    assert scan.scan_options("regex, mrz", ".TXT,md", 3) == {"layers": frozenset({"regex", "mrz"}), "extensions": frozenset({"txt", "md"}), "max_mb": 3.0}
    with pytest.raises(ValueError):
        scan.scan_options("nonsense")


def test_command_line_and_run(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("SIN: 757 036 793")
    assert cli.main(["--path", str(tmp_path / "in"), "--layers", "regex,keyword_context", "--out", str(tmp_path / "out"), "--no-verify"]) == 0
    assert sinks.recent(str(tmp_path / "out")) and cli.main(["--path", str(tmp_path / "none"), "--out", str(tmp_path / "out")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["--path", ".", "--layers", "nonsense"])
    assert e.value.code == 2
    told = []
    with scan.Run(spark, every=0.1) as run:
        run.follow(scan.scan_path(spark, str(tmp_path / "in"), layers=("regex", "keyword_context"))["file_scores"], told.append)
        assert set(run.progress()) == {"done", "running", "all"}
    assert told[0]["file"] == "a.txt" and told[0]["risk"] == "HIGH" and run.peaks["peak_rss_mb"] > 0 and len(run.ticker) == 1


def test_cancel(spark):
    def slow(batches):
        for b in batches:
            time.sleep(1)
            yield b

    with scan.Run(spark, "long") as run:
        threading.Timer(3, run.cancel).start()
        with pytest.raises(Exception, match="CANCELLED"):
            spark.range(60, numPartitions=60).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
    assert run.cancelled

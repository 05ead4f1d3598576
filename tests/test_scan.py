import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from tamis.operators import alarm
from tamis.operators import findings as fd
from tamis.operators import verify
from tamis.plans.scan import register_functions, scan_documents, scan_folder
from tamis.sources.extract import html_text, looks_binary
from tamis.sources import sinks
from tamis.sources.sinks import write_reports
from tamis.streaming.files import scan_stream, write_stream


def scored(spark, findings):
    kinds = "array<struct<category:string,value:string,confidence:double,risk_level:string>>"
    return [r["s"] for r in spark.createDataFrame([(f,) for f in findings], f"findings {kinds}").select(fd.score(F.col("findings")).alias("s")).collect()]


def test_scores(spark):
    f = lambda category, risk, n=1, c=1.0: [(category, str(k), c, risk) for k in range(n)]
    many = f("contact.email", "MEDIUM", 200) + f("contact.phone", "MEDIUM", 200) + f("entity.person", "LOW", 200)
    assert scored(spark, [[], f("identifier.financial.sin", "HIGH", 1, 0.95), many, f("technical.url", "LOW", 100), f("entity.date", "LOW", 100)]) == [0, 75, 69, 29, 5]


def test_dedup_and_rules(spark):
    docs = spark.createDataFrame([("a", "SIN 757036793, passport 757036793"), ("b", "DOB: 1980-02-02"), ("c", None), ("d", "")], "doc_id string, text string")
    rows = {(r["doc_id"], r["raw_type"]): r for r in fd.explode_findings(scan_documents(docs, ("regex", "keyword_context", "passport"))).collect()}
    assert set(rows) == {("a", "sin"), ("b", "dob")}
    assert round(rows["a", "sin"]["confidence"], 4) == 0.6375


def test_layer_selection_isnt_monotone(spark):
    docs = spark.createDataFrame([("a", "Northwest Territories driver's licence and health card 1234567897")], "doc_id string, text string")
    types = lambda *layers: {r["raw_type"] for r in fd.explode_findings(scan_documents(docs, layers)).collect()}
    assert any(t.startswith("drivers_license") for t in types("drivers_license"))
    assert not any(t.startswith("drivers_license") for t in types("drivers_license", "health_card"))


def test_missing_ner_degrades(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    r = scan_documents(docs).first()
    assert r["failed_layers"] == ["gliner"] and r["detection_degraded"] and r["sources"]["regex"] == 0
    ok = scan_documents(docs, ("regex",)).first()
    one = scan_documents(spark.createDataFrame([("a", "x@example.org")], "doc_id string, text string"), ("regex",)).first()
    assert one["sources"]["regex"] == 1 and one["total_detections"] == 1 and one["high_confidence"] == 1
    assert not ok["detection_degraded"] and "gliner" in ok["disabled_layers"]


def test_alarms(spark):
    docs = spark.createDataFrame([("/x/john_passport_scan.jpg", ""), ("/x/compass_report.txt", ""), ("/x/PRCard2.png", "carte santé"), ("/x/passport.txt", "Reference 757 036 793")], "path string, text string")
    rows = {r["file"]: r for r in alarm.alarms(scan_documents(docs, ("regex",), keep=("path", "text"))).collect()}
    assert {k: r["triggered_by"] for k, r in rows.items()} == {"/x/john_passport_scan.jpg": "filename", "/x/PRCard2.png": "both"}


def test_verdicts_only_lower(spark):
    docs = spark.createDataFrame([(1, "Passport AB123456"), (2, "Passport AB123457")], "doc_id int, text string")
    f = fd.explode_findings(scan_documents(docs, ("passport",)))
    asked = verify.questions(f)
    out = verify.apply_verdicts(f, asked.where("doc_id = 1").withColumn("verdict", F.lit("FALSE_POSITIVE")))
    got = {r["doc_id"]: (r["risk_level"], r["original_risk_level"], r["llm_verified"]) for r in out.collect()}
    assert got == {1: ("LOW", "HIGH", True), 2: ("HIGH", None, False)}


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SIN: 757 036 793")
    (tmp_path / "b.txt").write_bytes(b"\0\1\2")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "c.xyz").write_text("no")
    (tmp_path / "bad.docx").write_text("no zip")
    (tmp_path / "m.eml").write_text("From: a@b.org\nSubject: x\nContent-Type: text/html\n\n<p>call (403) 555-1234<script>1</script></p>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>mail x@example.org</w:t></w:p></w:document>')
    t = scan_folder(spark, str(tmp_path), ("regex", "keyword_context"), ("txt", "docx", "eml"))
    assert {r["raw_type"] for r in t["findings"].collect()} >= {"sin", "phone", "email"}
    assert {r["reason"] for r in t["skipped_files"].collect()} == {"binary content", "filtered"}
    assert t["failed_files"].count() == 1
    s = t["scan_summary"].first()
    assert (s["scanned"], s["failed"], s["skipped"], s["high"]) == (3, 1, 2, 1)
    paths = write_reports(t, str(tmp_path / "out"), str(tmp_path), layers=("regex", "keyword_context"))
    data, page = json.load(open(paths["json"])), open(paths["html"]).read()
    assert "757 036 793" not in page and "757 036 793" not in json.dumps(data) and data["summary"]["high_risk"] == 1
    assert (data["total_files"], data["skipped_files"], len(data["failed_files"]), len(data["files"])) == (6, 2, 1, 4) and data["files"][-1]["scan_status"] == "extraction_failed"
    assert "PARTIAL SCAN" in open(paths["md"]).read() and "BadZipFile" in page and "binary content" in open(paths["md"]).read()
    assert open(tmp_path / "out/latest.html").read() == page
    again = write_reports(t["results"], str(tmp_path / "out"), str(tmp_path), masked=False)
    assert again["json"] != paths["json"] and "757 036 793" in open(again["html"]).read()
    assert sinks.stored(paths["json"]) == {"scanned": 3, "failed": 1, "skipped": 2, "high": 1, "medium": 2, "low": 0, "alarms": 0, "cancelled": False}
    assert [r["score"] for r in sinks.preview(paths["json"])] == sorted((r["score"] for r in sinks.preview(paths["json"])), reverse=True)
    assert [r["html_path"] for r in sinks.recent(str(tmp_path / "out"))][0] == os.path.realpath(again["html"]) and "error" in sinks.stored("/none")


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x@example.org")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    write_stream(scan_stream(rows, ("regex",)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 1


def test_helpers(spark):
    assert html_text("<p>a<script>b</script></p><style>c</style><p>d &amp; e</p>") == "a\nd & e"
    assert looks_binary(b"a\0") and not looks_binary(b"plain") and not looks_binary(b"")
    register_functions(spark)
    assert spark.sql("select raw_type from detect_pii('Patient PHN 9698658215')").first()[0] == "health_card_bc"


def test_evaluate(spark):
    want = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, t string")
    got = spark.createDataFrame([(1, "a"), (4, "b")], "k int, t string")
    rows = {r["bucket"]: (r["want"], r["got"], r["hit"]) for r in fd.evaluate(want, got, ["k", "t"], "t").collect()}
    assert rows == {"a": (2, 1, 1), "b": (1, 1, 0), "all": (3, 2, 1)}


def test_compare_runs_broadcasts_nothing(spark):
    # rows of few bytes by the optimiser's estimate
    runs = [spark.range(1, 4).select(F.col("id").alias("doc_id"), F.expr(band).alias("band")) for band in ("if(id = 1, 'NONE', 'LOW')", "if(id = 1, 'HIGH', 'LOW')")]
    out = fd.compare_runs(*runs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.collect() == [(1, "NONE", "HIGH")]

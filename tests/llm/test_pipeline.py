"""The pipeline's stages on a small table, each against what its operator decides."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import store
from tamis.llm.surrogates import spans


def test_pipeline(spark, tmp_path):
    words = [f"{a}a{b}e{c}" for a in "bcdfghjk" for b in "lmnrstvw" for c in "tkpvzbdg"]
    texts = [" ".join(words[(k * 37 + 13 * i) % 512] for i in range(40 + k)) + "." for k in range(60)]
    texts[7] = texts[3]
    texts[9] = texts[5] + " zutaken"
    texts[11] += " mail x.1@mail1.example.com"
    texts += ["LOUD!! NOISE!! " * 30 + str(k) for k in range(8)]
    data = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        left[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {d for d, _ in left["quality"]} == set(range(60))
    assert {d for d, _ in left["near_dedup"]} == set(range(60)) - {7, 9}
    before, after = dict(left["near_dedup"]), dict(left["pii"])
    assert before.keys() == after.keys() and [d for d in before if before[d] != after[d]] == [11]
    assert "x.1@" not in after[11] and len(spans(after[11])) == 1
    assert {d for d, _ in left["mixing"]} <= before.keys() and len(left["mixing"]) > len(before)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(packed[packed["piece"] == 0]["doc_id"]) == sorted(d for d, _ in left["mixing"])
    assert (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_near_dedup_by_rows(spark, tmp_path):
    words = [f"{a}a{b}e{c}" for a in "bcdfghjk" for b in "lmnrstvw" for c in "tkpvzbdg"]
    text = lambda k: " ".join(words[(k * 37 + 13 * i) % 512] for i in range(40 + k)) + "."
    data = [(1, text(1))] * 40  # a row that repeats
    data += [(None, text(2)), (None, text(2) + " zutaken"), (None, text(2))]  # near and equal copies without an id
    data += [(4, text(4)), (4, text(5)), (3, text(5) + " zutaken")]  # two texts of one id, one of them a copy of another's
    data += [(None, text(6)), (6, text(6)), (None, ""), (None, None), (7, None)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("lang", "source")})
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect()]
    by_id = lambda x: sorted((t or "", t is None) for i, t in left if i == x)
    assert by_id(1) == [(text(1), False)] and by_id(4) == [(text(4), False)] and by_id(3) == [(text(5) + " zutaken", False)]
    assert by_id(6) == [(text(6), False)] and by_id(7) == [("", True)]
    nameless = by_id(None)
    assert nameless[:2] == [("", False), ("", True)] and len(nameless) == 3 and nameless[2][0].startswith(text(2))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, spans string, key string, size long, copies long, node long"


def test_stages_on_edge_cases(spark):
    words = [f"{a}a{b}e{c}" for a in "bcdfghjk" for b in "lmnrstvw" for c in "tkpvzbdg"]
    text = lambda k: " ".join(words[(k * 37 + 13 * i) % 512] for i in range(40 + k)) + "."
    row = lambda k, t, lang="en", source="s": (k, t, lang, source, None, "l", 0.5, "s", "k", 7, 7, 7)
    data = [row(k, text(k), source=f"s{k % 2}") for k in range(30)]
    data += [row(1, text(1), source="s1")] * 3 + [row(None, text(2)), row(None, None), row(None, None), row(40, None), row(41, ""), row(42, " \t", None, None)]
    data += [row(43, "mail x.1@mail1.example.com " + text(33)), row(44, text(44) * 400), row(45, "one")]
    docs, none = spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame([], SCHEMA)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and stage(spark, none, "").count() == 0, name
        got = ids(out)
        if name == "quality":
            assert {(False, k) for k in range(30)} <= set(got)
        if name == "near_dedup":
            # copies with and without an id are one row, rows without words stay
            assert got == sorted([(False, k) for k in range(30)] + [(True, 0), (True, 0)] + [(False, k) for k in range(40, 46)])
        if name == "pii":
            assert got == ids(docs) and sum(a["text"] != b["text"] for a, b in zip(sorted(out.collect(), key=lambda r: str(r["doc_id"])), sorted(docs.collect(), key=lambda r: str(r["doc_id"])), strict=True)) >= 1
            assert {r["doc_id"] for r in out.collect()} - {r["doc_id"] for r in out.collect() if r["text"] is not None} <= {None, 40}
        if name == "mixing":
            assert set(got) <= set(ids(docs))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == len(data)
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0


def test_tables_are_removed_after_use(spark, tmp_path):
    words = [f"{a}a{b}e{c}" for a in "bcdfghjk" for b in "lmnrstvw" for c in "tkpvzbdg"]
    data = [(k, " ".join(words[(k * 37 + 13 * i) % 512] for i in range(40 + k)) + ".", "en", "s", 1) for k in range(20)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    mark = len(store.made_since(0))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in store.made_since(mark) if os.path.exists(p.removeprefix("file://"))}
    assert left == {"stage-mixing", "pack-pieces", "pack-counts"} and out.count() >= 20

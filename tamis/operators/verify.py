"""Verification of findings by an injected judge: verdicts may lower a risk, never raise one.

A judge is a function (question) -> (verdict, reason), where a question has value, detected_type, context, source_layer and, where the value
isn't in the text as it stands, context_note. `chat_judge` makes one of a local chat server."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import mask_value
from ..functions.spans import norm

ROUTED_SOURCES = ("passport", "drivers_license", "uci", "status_card", "keyword_context")
ROUTED_KEYWORD_TYPES = ("dob", "email", "phone", "postal_code_ca")


def routable(raw_type: Column, source: Column, risk: Column) -> Column:
    return source.isin(*ROUTED_SOURCES) & (risk != "LOW") & ((source != "keyword_context") | raw_type.isin(*ROUTED_KEYWORD_TYPES))


def questions(findings: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document, value and category that a judge is asked about."""
    return findings.where(routable(F.col("raw_type"), F.col("source"), F.col("risk_level"))).groupBy(id_column, "norm_value", "category").agg(F.min("value").alias("value"), F.min("source").alias("source"))


def context_of(text: Column, value: Column, width: int = 100) -> Column:
    """The text around the value's first place, else its first 200 characters."""
    at = F.instr(text, value)
    first = F.greatest(at - 1 - width, F.lit(0))
    return F.when(at > 0, F.substring(text, first + 1, at - 1 + F.char_length(value) + width - first)).otherwise(F.substring(text, 1, 200))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """findings with llm_verified, llm_verdict and original_risk_level; FALSE_POSITIVE makes a routed finding LOW."""
    v = verdicts.select(id_column, "norm_value", "category", F.col("verdict").alias("llm_verdict"))
    asked = routable(F.col("raw_type"), F.col("source"), F.col("risk_level"))
    out = findings.withColumn("routed", asked).join(v, [id_column, "norm_value", "category"], "left")
    known = F.col("llm_verdict").isin("FALSE_POSITIVE", "LEGITIMATE")
    demoted = F.col("routed") & F.coalesce(F.col("llm_verdict") == "FALSE_POSITIVE", F.lit(False))
    return (
        out.withColumn("llm_verified", F.when(F.col("routed"), F.coalesce(known, F.lit(False))))
        .withColumn("original_risk_level", F.when(demoted, F.col("risk_level")))
        .withColumn("risk_level", F.when(demoted, "LOW").otherwise(F.col("risk_level")))
    )


def summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count_if("routed").alias("routed"),
        F.count_if(F.col("original_risk_level").isNotNull()).alias("demoted"),
        F.count_if(F.col("routed") & ~F.col("llm_verified")).alias("errors"),
    )


VERDICTS = ("LEGITIMATE", "FALSE_POSITIVE")
PROMPT = """You check what a scanner for personal data has found. You get a JSON object with the value that was found, the type that the scanner gave it, the text around it, and the layer that found it.
Say whether the value really is what its type says, in this text, or something else that only looks like it. Go by the value and its text alone.
Answer with JSON and nothing else: {"verdict": "LEGITIMATE" or "FALSE_POSITIVE", "reason": "one line"}"""
Judge = Callable[[dict], tuple[str, str]]


def json_in(text: str | None) -> dict | None:
    """The object that an answer is, or that stands between its first and last brace."""
    text = (text or "").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def chat_judge(url: str, model: str, timeout: float = 30.0, prompt: str = PROMPT) -> Judge:
    """A judge at a local server's /api/chat, at temperature 0."""

    def judge(question: dict) -> tuple[str, str]:
        said = {"model": model, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": json.dumps(question)}], "stream": False, "options": {"temperature": 0}}
        request = urllib.request.Request(f"{url}/api/chat", json.dumps(said).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            found = json_in(json.load(answer).get("message", {}).get("content", "")) or {}
        return found["verdict"], str(found.get("reason", ""))

    return judge


def available(url: str, model: str, wanted: bool = True, timeout: float = 3.0) -> tuple[bool, str]:
    """(whether to verify, status: enabled, disabled, or skipped and why). Asked once for a scan."""
    if not wanted:
        return False, "disabled"
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=timeout) as answer:
            names = [m.get("name") or "" for m in json.load(answer).get("models", [])]
    except (OSError, ValueError, urllib.error.URLError) as e:
        return False, f"skipped: no answer at {url} ({e})"
    family = model.split(":")[0]
    return (True, "enabled") if any(n == model or n.split(":")[0] == family for n in names) else (False, f"skipped: {model} isn't among {names}")


def ask(findings: DataFrame, texts: DataFrame, judge: Judge, id_column: str = "doc_id", slots: int = 1) -> DataFrame:
    """id, norm_value, category, verdict (ERROR after two tries), reason. Questions are asked in the order of documents, values and categories,
    `slots` at a time: a local server mostly has one."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q in b.to_dict("records"):
                asked = {"value": q["value"], "detected_type": q["category"], "context": q["context"], "source_layer": q["source"]} | ({} if q["exact"] else {"context_note": "approximate"})
                verdict, reason = "ERROR", ""
                for _ in range(2):
                    try:
                        said, why = judge(asked)
                    except Exception:  # noqa: BLE001, S112
                        continue
                    if said in VERDICTS:
                        verdict, reason = said, why
                        break
                rows.append((q["id"], q["norm_value"], q["category"], verdict, reason))
            yield pd.DataFrame(rows, columns=["id", "norm_value", "category", "verdict", "reason"])

    q = questions(findings, id_column).join(texts.select(id_column, "text"), id_column)
    q = q.select(F.col(id_column).alias("id"), "norm_value", "category", "value", "source", context_of(F.col("text"), F.col("value")).alias("context"), (F.instr("text", F.col("value")) > 0).alias("exact"))
    kind = q.schema["id"].dataType.simpleString()
    dealt = q.repartitionByRange(slots, "id").sortWithinPartitions("id", "norm_value", "category")
    return dealt.mapInPandas(of, f"id {kind}, norm_value string, category string, verdict string, reason string").withColumnRenamed("id", id_column)


def rescored(results: DataFrame, verdicts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """results whose findings carry their verdicts, lowered ones at LOW with original_risk_level; scores that are taken of them follow. The
    verdicts of a document meet its row as one map."""
    key = lambda value, category: F.concat_ws("\x01", category, value)
    per = verdicts.groupBy(id_column).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(key(F.col("norm_value"), F.col("category")).alias("k"), F.struct("verdict", "reason").alias("v"))))).alias("_said"))
    none = F.lit(None).cast("string")

    def judged(x: Column) -> Column:
        said = F.col("_said")[key(norm(x["value"]), x["category"])]
        asked = routable(x["raw_type"], x["source"], x["risk_level"]) & said["verdict"].isNotNull()
        down = asked & (said["verdict"] == "FALSE_POSITIVE")
        out = x.withField("llm_verified", F.when(asked, said["verdict"].isin(*VERDICTS))).withField("llm_verdict", F.when(asked & said["verdict"].isin(*VERDICTS), said["verdict"]).otherwise(none))
        out = out.withField("llm_reason", F.when(asked, said["reason"]).otherwise(none)).withField("original_risk_level", F.when(down, x["risk_level"]).otherwise(none))
        return out.withField("risk_level", F.when(down, F.lit("LOW")).otherwise(x["risk_level"]))

    return results.join(per, id_column, "left").withColumn("findings", F.transform("findings", judged)).drop("_said")


def report_part(verified: DataFrame, status: str, model: str | None, id_column: str = "doc_id") -> dict:
    """What a report says of verdicts: counts, and the findings that were lowered. verified: findings of `rescored` results."""
    asked = verified.where("llm_verified is not null")
    n = asked.agg(F.count("*").alias("routed"), F.count_if(F.col("original_risk_level").isNotNull()).alias("demoted"), F.count_if(~F.col("llm_verified")).alias("errors")).first()
    rows = asked.where("original_risk_level is not null").select(F.col(id_column).cast("string").alias("file"), "category", mask_value(F.col("value"), F.col("category")).alias("value"), "original_risk_level", "llm_reason")
    return {"status": status, "model": model, **n.asDict(), "demoted_findings": [r.asDict() for r in rows.orderBy("file", "category", "value").toLocalIterator()]}

"""Alarms for documents that look like identity papers and yet have no identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types, and the reasons that reports print.
DOCUMENT_KEYWORDS = ("PASSPORT", "DRIVER'S LICENCE", "DRIVERS LICENCE", "DRIVING LICENCE", "DRIVER'S LICENSE", "DRIVERS LICENSE", "DRIVING LICENSE", "SOCIAL INSURANCE", "SIN CARD", "PERMANENT RESIDENT", "PR CARD", "STATUS CARD", "CERTIFICATE OF INDIAN STATUS", "HEALTH CARD", "BIRTH CERTIFICATE", "CITIZENSHIP CARD", "PASSEPORT", "PERMIS DE CONDUIRE", "ASSURANCE SOCIALE", "NAS", "RESIDENT PERMANENT", "CARTE SANTE")
REASON = "Document-type indicators present but no identifier was extracted — manual review recommended."
FACE_REASON = "Human portrait detected but no identifier was extracted — possible unreadable identity document; manual review recommended."
UNREADABLE_REASON = "Document yielded little or no readable text and no identifiers — possibly an unreadable document; manual review recommended."
IMAGES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp")
NEVER_IDENTIFIERS = ("gliner", "secrets")


def unaccented(value: Column) -> Column:
    """Upper case without the accents of Latin letters."""
    return F.translate(F.upper(value), "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ", "AAAAAACEEEEIIIINOOOOOUUUUYY")


def normalised_filename(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=[a-z])(?=[A-Z])", " ")
    name = F.regexp_replace(F.lower(name), "[-_.,&+]", " ")
    name = F.regexp_replace(name, r"(?U)(?<=[\p{L}])(?=\d)|(?<=\d)(?=[\p{L}])", " ")
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def keywords_in(text: Column, joined: bool = False) -> Column:
    """Document keywords in an upper-case text, as words; with joined, also without their spaces and apostrophes."""
    from re import escape

    hits = []
    for k in DOCUMENT_KEYWORDS:
        flat = k.replace(" ", "").replace("'", "")
        pattern = rf"(?U)\b(?:{escape(k)}" + (rf"|{escape(flat)}" if joined and flat != k else "") + r")\b"
        hits.append(F.when(text.rlike(pattern), F.lit(k)))
    return F.array_compact(F.array(*hits))


def alarms(results: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of results that alarm: path, triggered_by, matched_keywords, reason, layers_disabled. Optional columns of results:
    faces_detected, ocr_attempted, ocr_confidence, disabled_layers."""
    has = lambda c: c in results.columns
    t = F.coalesce(F.col(text), F.lit(""))
    by_name, by_text = keywords_in(unaccented(normalised_filename(F.col(path))), joined=True), keywords_in(unaccented(t))
    face = F.lower(F.element_at(F.split(F.col(path), r"\."), -1)).isin(*IMAGES) & (F.coalesce(F.col("faces_detected"), F.lit(0)) >= 1) if has("faces_detected") else F.lit(False)
    ocr = F.coalesce(F.col("ocr_attempted"), F.lit(False)) if has("ocr_attempted") else F.lit(False)
    weak = F.col("ocr_confidence") < 40 if has("ocr_confidence") else F.lit(False)
    if has("ocr_confidence"):
        ocr = ocr | F.col("ocr_confidence").isNotNull()
    unread = ocr & ((F.length(F.trim(t)) == 0) | (F.length(F.regexp_replace(t, r"\p{C}", "")) < 200) | F.coalesce(weak, F.lit(False)))
    cleared = F.exists("findings", lambda x: x["category"].startswith("identifier."))
    off = F.array_sort(F.array_except(F.col("disabled_layers"), F.array(*[F.lit(x) for x in NEVER_IDENTIFIERS]))) if has("disabled_layers") else F.expr("cast(array() as array<string>)")
    out = results.select(F.col(path).alias("file"), by_name.alias("n"), by_text.alias("c"), face.alias("face"), unread.alias("unread"), cleared.alias("cleared"), off.alias("layers_disabled"))
    triggers = F.array_compact(F.array(F.when(F.size("n") > 0, F.lit("filename")), F.when(F.size("c") > 0, F.lit("content")), F.when(F.col("face"), F.lit("face")), F.when(F.col("unread"), F.lit("unreadable"))))
    out = out.withColumn("by", F.array_join(triggers, "+")).where((F.col("by") != "") & ~F.col("cleared"))
    note = F.when(F.size("layers_disabled") > 0, F.concat(F.lit(" Layers that were switched off for this scan: "), F.array_join("layers_disabled", ", "), F.lit(". They may be why no identifier was found."))).otherwise("")
    reason = F.when(F.col("by") == "face", FACE_REASON).when(F.col("by") == "unreadable", UNREADABLE_REASON).otherwise(REASON)
    return out.select("file", F.when(F.col("by") == "filename+content", "both").otherwise(F.col("by")).alias("triggered_by"), F.array_sort(F.array_union("n", "c")).alias("matched_keywords"), F.concat(reason, note).alias("reason"), "layers_disabled")

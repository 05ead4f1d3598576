"""Published vectors of the layers, and checks between the native and the sequential side."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tamis.functions import checks, dims, masks
from tamis.functions.spans import spans
from tamis.operators import context_layers as ctx
from tamis.operators import findings as fd
from tamis.operators import native_layers as nl
from tamis.operators import ner_layer, page, zones
from tamis.operators.labels import labels_in

ALL = frozenset(fd.CONTEXT_LAYERS)


def found(text, *layers):
    return [(k, v, round(c, 4)) for _, k, v, c, _ in ctx.detect(text, frozenset(layers) or ALL, date(2026, 8, 6))[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Reference 757 036 793 was received", ("sin_unverified", "757 036 793", 0.55)),
        ("Employee SIN: 757 036 793 is on file", ("sin", "757 036 793", 0.6375)),
        ("Visa 4111 1111 1111 1111 expires next year", ("credit_card", "4111 1111 1111 1111", 0.95)),
        ("Reference 4111 1111 1111 1111 was received", ("credit_card_unverified", "4111 1111 1111 1111", 0.55)),
        ("OHIP number: 9876543217 X", ("health_card_on", "9876543217 X", 0.95)),
        ("9876543217", ("health_card_on_unverified", "9876543217", 0.55)),
        ("Patient PHN 9698658215 on file", ("health_card_bc", "9698658215", 0.95)),
        ("Ontario Health Card: 9876543217\nBC Health Card (PHN): 9123456780", ("health_card_ca", "9123456780", 0.6)),
        ("Ontario driver's licence A1234-56789-01231", ("drivers_license_on", "A1234-56789-01231", 0.6)),
        ("Social Insurance Number: 3185O7522", ("reconstructed_sin", "318507522", 0.55)),
        ("OHIP health card: B327932763", ("reconstructed_health_card_on", "8327932763", 0.55)),
        ("P<CANSAMPLE<<SYNTHETIC<<<<<<<<<<<<<<<<<<<<<<<\nAC01234561CAN9001011F3001019<<<<<<<<<<<<<<04", ("mrz_document_number", "AC0123456", 0.95)),
        ("Contact format.test@example.com. Postal Code T2X 1V4", ("postal_code_ca", "T2X 1V4", 0.6)),
        ("DOB EXP 1980/02/02", ("dob", "1980/02/02", 0.6375)),
    ],
)
def test_vectors(text, want):
    assert want in found(text)


@pytest.mark.parametrize("text", ["Driver's licence A1234-56789-01231", "SSN 123-45-6789 is not a real number", "Expiry: 2020-02-02", "", None, "SIN: 123456789"])
def test_nothing(text):
    assert found(text) == []


def test_failing_layer_is_named():
    rows, failed = ctx.detect("Patient PHN 9698658215, SIN 757 036 793", ALL, None, frozenset({"health_card"}))
    assert failed == ["health_card"]
    assert any(r[1] == "sin" for r in rows)


def test_native(spark):
    t = [("(403) 555-1234 or 4035551234",), ("Phone: 4035551234",), ("bogus 256.256.256.256 and 1.2.3.4.5, 10.0.0.1",), ("go to http://example.com/page.",), (None,), ("",)]
    df = spark.createDataFrame(t, "t string").withColumn("f", nl.regex_native(F.coalesce("t", F.lit(""))))
    got = [[x["value"] for x in r["f"]] for r in df.collect()]
    assert got == [["(403) 555-1234"], ["4035551234"], ["10.0.0.1"], ["http://example.com/page"], [], []]


def test_spans_hold_places(spark):
    text = "é😀 12 and\u0001 345, 6"
    r = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), r"\d+").alias("s")).first()["s"]
    assert [(x["value"], text[x["start"] : x["end"]]) for x in r] == [("12", "12"), ("345", "345"), ("6", "6")]


def test_checksums_agree(spark):
    numbers = [f"{(k * 7919 + 9_000_000_000) % 10_000_000_000:010d}" for k in range(300)] + ["", "abc", "0123456789"]
    nine = [f"{(k * 104_729) % 1_000_000_000:09d}" for k in range(300)]
    c = F.col("v")
    rows = spark.createDataFrame([(n,) for n in numbers + nine], "v string").select("v", checks.valid_ohip(c).alias("o"), checks.valid_bc_phn(c).alias("b"), checks.valid_sin(c).alias("s"), checks.valid_ssn(c).alias("n"), checks.luhn(c, 9).alias("l")).collect()
    for r in rows:
        assert (r["o"], r["b"], r["s"], r["n"], r["l"]) == (page.valid_ohip(r["v"]), page.valid_bc(r["v"]), page.valid_sin(r["v"]), page.valid_ssn(r["v"]), page.luhn(r["v"], 9)), r


def test_icao_digit(spark):
    fields = ["AC0123456", "900101", "L898902C3", "D23145890<<<"]
    rows = spark.createDataFrame([(f,) for f in fields], "v string").select("v", checks.icao_digit(F.col("v")).alias("d")).collect()
    assert all(str(r["d"]) == zones.check_digit(r["v"]) for r in rows)


def test_masks(spark):
    cases = [("132-677-360", "identifier.financial.sin", "132-***-**0"), ("(613) 555-1234", "contact.phone", "(***) ***-1234"), ("4111111111111111", "identifier.financial.credit_card", "**** **** **** 1111"), ("john@example.org", "contact.email", "j***@example.org"), ("abc", "entity.person", "***"), ("Alice", "entity.person", "A***e")]
    rows = spark.createDataFrame([c[:2] for c in cases], "v string, c string").select(masks.mask_value(F.col("v"), F.col("c")).alias("m")).collect()
    assert [r["m"] for r in rows] == [c[2] for c in cases]


def test_regex_layer_reads_whole_texts(spark):
    far = "ab " * 3_400_000
    found = {(k, v) for k, v, _ in ctx.regex_context(ctx.Page(far + "Visa 4111 1111 1111 1111 expires"))}
    assert found == {("credit_card", "4111 1111 1111 1111")}
    assert not list(ctx.regex_context(ctx.Page(far + "Visa 4111 1111 1111 1111 expires"), 10_000_000))
    text = F.concat(F.repeat(F.lit("ab "), 3_400_000), F.lit("mail far.away@example.com"))
    assert [x["value"] for x in spark.range(1).select(nl.regex_native(text).alias("f")).first()["f"]] == ["far.away@example.com"]


def common_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def keywords_by_brute_force(text, kind, start, width=100):
    """Whether an exact keyword, or a word that is like one of over three letters, starts at most `width` from a place."""
    low, words = text.lower(), page.KEYWORDS[kind][0]
    at = {m.start() for w in words for m in re.finditer(rf"(?=\b{re.escape(w)}\b)", low)}
    for m in re.finditer(r"\w+", low):
        for w in words:
            if len(w) > 3 and abs(len(w) - len(m.group())) <= 2 and 2 * common_by_table(w, m.group()) / (len(w) + len(m.group())) >= 0.8:
                at.add(m.start())
    return any(abs(x - start) <= width for x in at)


def test_keywords_equal_brute_force():
    rng = random.Random(4)
    words = ["phone", "xphone", "telefone", "fones", "sin", "sins", "social insurance number", "credit card number", "visa", "visas", "postcode", "e-mail", "emial", "cell", "call", "(", "\n", "é", "a" * 80, "b" * 200, "mastercards", "s.i.n", "s.s.n"]
    for _ in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        p = page.Page(text)
        for _ in range(20):
            kind, start = rng.choice(list(page.KEYWORDS)), rng.randrange(len(text))
            assert p.close(kind, start) == keywords_by_brute_force(text, kind, start), (text, kind, start)


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert page.Pattern(a).common(b) == common_by_table(a, b)


PROVINCES = [
    ("Alberta health card 12345-6789", "health_card_ab", "123456789"),
    ("Northwest Territories A1234567", "health_card_nt", "A1234567"),
    ("New Brunswick 123 456-789", "health_card_nb", "123456789"),
    ("PEI 12345678", "health_card_pe", "12345678"),
    ("Saskatchewan 123456789", "health_card_sk", "123456789"),
    ("Manitoba 123456789", "health_card_mb", "123456789"),
    ("Nunavut 123456789", "health_card_nu", "123456789"),
    ("Yukon 123456789", "health_card_yk", "123456789"),
    ("Nova Scotia 1234567890", "health_card_ns", "1234567890"),
    ("Newfoundland 123456789012", "health_card_nl", "123456789012"),
    ("RAMQ ABCD 1234 5678", "health_card_qc", "ABCD12345678"),
    ("Medicare 123456789", "health_card_ca", "123456789"),
    ("Ontario 9876543210", "health_card_on_unverified", "9876543210"),
    ("British Columbia 9123456780", "health_card_bc_unverified", "9123456780"),
    ("number 9698658215", "health_card_bc_unverified", "9698658215"),
    ("Alberta DL 123456-789", "drivers_license_ab", "123456-789"),
    ("Manitoba DL AA-BB-CC-D123EE", "drivers_license_mb", "AA-BB-CC-D123EE"),
    ("Labrador id card A123456789", "drivers_license_nl", "A123456789"),
    ("NS identification card ABCDE-010123456", "drivers_license_ns", "ABCDE-010123456"),
    ("Québec permis de conduire A1234-567890-12", "drivers_license_qc", "A1234-567890-12"),
    ("Nunavut drivers  license A1234 5678-004", "drivers_license_nu", "A1234 5678-004"),
    ("BC driver's lic# 1234567", "drivers_license_bc", "1234567"),
    ("NB dl 12345", "drivers_license_nb", "12345"),
    ("PEI dl 12345", "drivers_license_pe", "12345"),
    ("SK dl 12345678", "drivers_license_sk", "12345678"),
    ("NWT dl 1234567890", "drivers_license_nt", "1234567890"),
    ("Yukon dl 504896", "drivers_license_yt", "504896"),
]


@pytest.mark.parametrize(("text", "kind", "value"), PROVINCES)
def test_provinces(text, kind, value):
    assert (kind, value) in {(k, v) for k, v, _ in found(text, "health_card", "drivers_license")}


def test_claims():
    assert found("Ontario 0123456789, health card", "health_card") == []  # no number of Ontario's begins with 0, and none takes it
    kinds = [k for k, _, _ in found("DL Alberta BC 123456-789", "drivers_license")]
    assert kinds == ["drivers_license_ab"]  # the bare numbers in it are claimed
    assert not found("Yukon DL exp 504896", "drivers_license")
    near = "Newfoundland and Labrador"
    assert found(near + " " * 285 + "DL A123456789", "drivers_license")[0][0] == "drivers_license_nl"  # a window that cuts the longer name


def test_labels():
    kinds = lambda t: [k for _, _, k in labels_in(t)]
    assert kinds("DOB1980") == ["positive"] and kinds("EXPIRY2024") == ["negative"] and kinds("experience") == []
    assert kinds("DOBDOB") == ["positive"] and kinds("ISSEXP") == ["negative"] and kinds("D0B") == ["positive"] and kinds("naisance") == ["positive"]
    on = lambda t: [v for k, v, _ in found(t, "keyword_context") if k == "dob"]
    assert on("DOB: 1980-01-02 EXP: 2020-01-01") == ["1980-01-02"]
    assert on("born\n:\n1980-01-02") == ["1980-01-02"] and on("born\nof x\n1980-01-02") == []
    assert on("1980-01-02 (date of birth)") == ["1980-01-02"] and on("1980-01-02 2001-03-04 born") == ["2001-03-04"]
    assert on("born 2027-01-01") == [] and on("born 1980-01-02 " * 3) == ["1980-01-02"]


def test_addresses_of_the_keyword_layer():
    pattern = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", re.I)
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "@", ".", "co", " ", "-", "_", "é", "9"]) for _ in range(rng.randrange(1, 25)))
        assert [m.span() for m in pattern.finditer(t)] == list(ctx.addresses(t)), t


def test_gates(spark):
    """Texts that the sequential layers find something in are let in."""
    texts = ["SIN ١٣٠٦٩٢٥٤٤ on file", f"Visa 4  {' '.join('2' * 12)}", "Social Insurance Number: 3185O7522", "postal T2X 1V4", "phone (403)555-1234", "email x@y.co"]
    rows = fd.detect(spark.createDataFrame([(t,) for t in texts], "text string"), fd.CONTEXT_LAYERS).collect()
    for r in rows:
        want = [(k, v) for _, k, v, _, _ in ctx.detect(r["text"], ALL)[0]]
        assert want and [(x["raw_type"], x["value"]) for x in r["raw"] if x["pos"] >= 1000] == want, r["text"]


def test_zones():
    def zone(number, state="CAN", kind="P<"):
        return f"{kind}{state}SAMPLE<<SYNTHETIC".ljust(44, "<") + f"\n{number}{zones.check_digit(number)}CAN9001011F3001019" + "<" * 14 + "04"

    of = lambda t, **g: [(k, v) for k, v, _, _ in zones.mrz(t, zones.Gates(**g))]
    assert of(zone("AB1234<<<").replace("AB1234<<<", "AB1234<KK"))[0] == ("mrz_document_number", "AB1234")
    assert of(zone("AC0123456").replace("AC01", "ACO1"))[0] == ("mrz_document_number", "AC0123456")  # one letter read for a digit
    assert of(zone("AC0123456").replace("AC0123456", "AC0123457"))[0] == ("mrz_unverified", "AC0123457")
    assert of(zone("AC0123456", "XQZ"), states=frozenset({"CAN", "D"})) == [] and of(zone("AC0123456", "D<<"), states=frozenset({"D"}))
    assert of(zone("AC0123456", kind="X<"), types=True) == [] and of(zone("AC0123456"), types=True)
    bad = zone("AC0123456").replace("AC0123456", "AC0123457").replace("9001011", "9001012").replace("3001019", "3001018")
    assert of(bad)[0][0] == "mrz_unverified" and of(bad, corroborated=True) == []
    wrapped = zone("AC0123456").replace("SAMPLE", "SAMPLE\n")
    assert of(wrapped)[0] == ("mrz_document_number", "AC0123456")
    one = "I<CANAC01234561" + "<" * 15 + "\n9001011F3001019CAN" + "<" * 11 + "4\n"
    assert {k for k, _ in of(one)} == {"mrz_document_number", "mrz_dob", "mrz_expiry"}


def test_issuers(spark):
    codes = dims.issuers(spark)
    assert {"CAN", "FRA", "D", "UNO"} <= codes and "UTO" not in codes and 249 <= len(codes) - len(zones.OTHER_ISSUERS) <= 252


def test_semantic_layer(spark):
    assert all(map(ner_layer.structured, ("http://x.y", "10.0.0.1", "2001:db8:1:2", "403-555-1234", "example.com", "SIN")))
    assert not any(map(ner_layer.structured, ("Sinclair", "2020-01-02", "12 Main Street", "Anna", "")))
    words = " ".join(f"w{k}" for k in range(900))
    parts = list(ner_layer.chunks(words))
    assert [len(p.split()) for p in parts] == [350, 350, 300] and parts[1].split()[:50] == parts[0].split()[-50:]
    for t, most in ((words, 100), ("x" * 5000 + " tail", 700), ("short", 1000)):
        parts = list(ner_layer.chunks(t, len, most_tokens=most))
        assert all(len(p) <= most for p in parts) and all(any(w in p for p in parts) for w in t.split() if len(w) <= most)
        assert sum(map(len, parts)) >= len(t) - len(parts)
    assert ner_layer.entities([("person", "Anna\nx", 0.6), ("person", "Anna", 0.9), ("person", "Bo", 0.4), ("location", "10.0.0.1", 0.9), ("thing", "x", 0.9)]) == [("person", "Anna", 0.9)]
    ner = ner_layer.layer(lambda: (lambda parts: [[("person", "Anna", 0.8)] for _ in parts], None))
    docs = spark.createDataFrame([("Anna came", "txt"), ("Anna came", "json"), ("", "txt")], "text string, ext string")
    got = [[x["value"] for x in r["raw"]] for r in fd.detect(docs, ("gliner",), ner=ner).collect()]
    assert got == [["Anna"], [], []]

"""Dimension tables: taxonomy, risk, source priority, scoring."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.zones import OTHER_ISSUERS

# Raw types and their categories.
TAXONOMY: dict[str, str] = {
    "sin": "identifier.financial.sin",
    "sin_context": "identifier.financial.sin",
    "sin_unverified": "identifier.financial_unverified.sin",
    "ssn": "identifier.financial.ssn",
    "ssn_context": "identifier.financial.ssn",
    "credit_card": "identifier.financial.credit_card",
    "credit_card_context": "identifier.financial.credit_card",
    "credit_card_unverified": "identifier.financial_unverified.credit_card",
    "health_card_on": "identifier.government.health_card_on",
    "health_card_bc": "identifier.government.health_card_bc",
    "health_card_on_unverified": "identifier.government_unverified.health_card_on",
    "health_card_bc_unverified": "identifier.government_unverified.health_card_bc",
    "health_card_ab": "identifier.government.health_card_ab",
    "health_card_sk": "identifier.government.health_card_sk",
    "health_card_mb": "identifier.government.health_card_mb",
    "health_card_nb": "identifier.government.health_card_nb",
    "health_card_ns": "identifier.government.health_card_ns",
    "health_card_pe": "identifier.government.health_card_pe",
    "health_card_nl": "identifier.government.health_card_nl",
    "health_card_nu": "identifier.government.health_card_nu",
    "health_card_yk": "identifier.government.health_card_yk",
    "health_card_nt": "identifier.government.health_card_nt",
    "health_card_qc": "identifier.government.health_card_qc",
    "health_card_ca": "identifier.government.health_card_ca",
    "drivers_license": "identifier.government.drivers_license",
    "drivers_license_context": "identifier.government.drivers_license",
    "drivers_license_on": "identifier.government.drivers_license_on",
    "drivers_license_qc": "identifier.government.drivers_license_qc",
    "drivers_license_bc": "identifier.government.drivers_license_bc",
    "drivers_license_ab": "identifier.government.drivers_license_ab",
    "drivers_license_sk": "identifier.government.drivers_license_sk",
    "drivers_license_mb": "identifier.government.drivers_license_mb",
    "drivers_license_ns": "identifier.government.drivers_license_ns",
    "drivers_license_nb": "identifier.government.drivers_license_nb",
    "drivers_license_nl": "identifier.government.drivers_license_nl",
    "drivers_license_pe": "identifier.government.drivers_license_pe",
    "drivers_license_nt": "identifier.government.drivers_license_nt",
    "drivers_license_nu": "identifier.government.drivers_license_nu",
    "drivers_license_yt": "identifier.government.drivers_license_yt",
    "drivers_license_ca": "identifier.government.drivers_license_ca",
    "passport": "identifier.government.passport",
    "passport_ca": "identifier.government.passport_ca",
    "passport_generic": "identifier.government.passport_generic",
    "uci": "identifier.government.uci",
    "status_card_registration": "identifier.government.status_card_registration",
    "reconstructed_sin": "identifier.reconstructed.sin",
    "reconstructed_health_card_on": "identifier.reconstructed.health_card_on",
    "reconstructed_health_card_bc": "identifier.reconstructed.health_card_bc",
    "mrz_document_number": "identifier.government.mrz_document_number",
    "mrz_dob": "identifier.personal.mrz_dob",
    "mrz_expiry": "identifier.government_low.mrz_expiry",
    "mrz_unverified": "identifier.government_unverified.mrz",
    "dob": "identifier.personal.dob",
    "dob_context": "identifier.personal.dob",
    "email": "contact.email",
    "email_context": "contact.email",
    "phone": "contact.phone",
    "phone_context": "contact.phone",
    "postal_code_ca": "contact.address.postal_code",
    "person": "entity.person",
    "organization": "entity.organization",
    "location": "entity.location",
    "date": "entity.date",
    "ip_address": "technical.ip_address",
    "url": "technical.url",
    "aws_access_key": "secret.credential.aws_access_key",
    "aws_secret_key": "secret.credential.aws_secret_key",
    "github_token": "secret.credential.github_token",
    "google_api_key": "secret.credential.google_api_key",
    "stripe_key": "secret.credential.stripe_key",
    "slack_token": "secret.credential.slack_token",
    "private_key": "secret.credential.private_key",
    "jwt": "secret.credential.jwt",
    "api_key": "secret.credential.api_key",
    "access_token": "secret.credential.access_token",
    "secret": "secret.credential.secret",
    "auth_credential": "secret.credential.auth_credential",
    "credential": "secret.credential.credential",
    "password": "secret.credential.password",
    "uri_password": "secret.credential.password",
}
# Risk by the first two parts of a category, else by the first.
RISK: dict[str, str] = {
    "identifier.financial": "HIGH",
    "identifier.financial_unverified": "MEDIUM",
    "identifier.government": "HIGH",
    "identifier.government_unverified": "MEDIUM",
    "identifier.government_low": "LOW",
    "identifier.personal": "MEDIUM",
    "identifier.reconstructed": "MEDIUM",
    "contact": "MEDIUM",
    "entity": "LOW",
    "technical": "LOW",
    "secret.credential": "HIGH",
}
# Layers in the order in which they run, and their priority between equal confidences.
LAYERS: dict[str, int] = {
    "regex": 3,
    "keyword_context": 2,
    "gliner": 1,
    "secrets": 4,
    "health_card": 3,
    "passport": 2,
    "uci": 2,
    "status_card": 2,
    "ocr_recovery": 2,
    "drivers_license": 1,
    "mrz": 3,
}
MIN_CONFIDENCE = 0.30
# Fixed values of scoring: floor and ceiling of a band, and increments by band and risk.
BANDS = {"HIGH": (70, 100), "MEDIUM": (30, 69), "LOW": (1, 29)}
INCREMENTS = {
    "HIGH": {"HIGH": 6.0, "MEDIUM": 2.5, "LOW": 1.0, "UNKNOWN": 0.5},
    "MEDIUM": {"MEDIUM": 8.0, "LOW": 1.5, "UNKNOWN": 0.75},
    "LOW": {"LOW": 6.0, "UNKNOWN": 3.0},
}
DATE_INCREMENT, DATE_CAP, DEFAULT_CONFIDENCE = 0.3, 4.0, 0.8


def issuers(spark: SparkSession) -> frozenset[str] | None:
    """Codes that may issue travel documents: the countries' of ISO 3166, as the JVM knows them, and the others of ICAO 9303. Without
    a JVM at hand None, which stands for any three letters."""
    try:
        locale = spark.sparkContext._jvm.java.util.Locale
        codes = locale.getISOCountries(getattr(locale, "IsoCountryCode").PART1_ALPHA3)
    except Exception:  # noqa: BLE001
        return None
    return frozenset(str(c) for c in codes) | frozenset(OTHER_ISSUERS)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def category(raw_type: Column) -> Column:
    return F.coalesce(literal_map(TAXONOMY)[raw_type], F.concat(F.lit("uncategorized."), raw_type))


def risk(cat: Column) -> Column:
    by = literal_map(RISK)
    return F.coalesce(by[F.substring_index(cat, ".", 2)], by[F.substring_index(cat, ".", 1)], F.lit("UNKNOWN"))

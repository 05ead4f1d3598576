"""DuckDB SQL for the queries."""

from __future__ import annotations

from .functions import dims
from .queries import _PATH, _SEVEN, SECRETS, TEXTS

EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+1[-.\s]?)?(?:\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\b\d{3}[-.\s]\d{3}[-.\s]\d{4})\b"
OCTETS = "list_bool_and(list_transform(string_split(v, '.'), lambda x: try_cast(x as int) between 0 and 255))"


def rows(name: str) -> str:
    return f"(select o_orderkey as doc_id, {TEXTS[name]} as text from orders)"


def luhn(d: str) -> str:
    at = f"substr({d}, i::int, 1)::int"
    return f"(list_sum(list_transform(generate_series(1, length({d})), lambda i: case when (length({d}) - i) % 2 = 1 then case when {at} > 4 then {at} * 2 - 9 else {at} * 2 end else {at} end)) % 10 = 0)"


SIN_OK = f"(substr(v, 1, 1) not in ('0', '8') and {luhn('v')})"
NINE = r"regexp_extract(text, '[0-9]{9}')"


def finding(raw: str, value: str, confidence: str, category: str, risk: str, source: str, where: str) -> str:
    return f"select doc_id, {raw} as raw_type, {value} as value, {confidence} as confidence, {category} as category, {risk} as risk_level from {source} where {where}"


def plain(kind: str, source: str, where: str = "true", confidence: float = 0.95, value: str = "v") -> str:
    return f"select doc_id, '{kind}' as raw_type, {value} as value, {confidence}::double as confidence from {source} where {where}"


def every(pattern: str, text: str = "text", frm: str = "documents", key: str = "doc_id") -> str:
    return f"(select {key}, unnest(regexp_extract_all(coalesce({text}, ''), '{pattern}')) as v from {frm})"


IPS = f"(select * from {every('[0-9.]+')} where regexp_full_match(v, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') and {OCTETS})"
BARE_PHONE = r"(select doc_id, v from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[0-9]{10}\b')) as v from documents) where false)"
CARDS = rf"(select doc_id, v from {every(r'\b(?:\d[ -]*?){13,16}\b')} where length(v) <= 38 and length(regexp_replace(v, '[^0-9]', '', 'g')) >= 13 and {luhn('''regexp_replace(v, '[^0-9]', '', 'g')''')})"
# the regex layer over documents: one finding per type and value
FOUND = f"""
  select distinct doc_id, t, lower(trim(v)) as n, v, c, r, cat from (
    select doc_id, 'email' as t, v, 0.95 as c, 'MEDIUM' as r, 'contact.email' as cat from {every(EMAIL)}
    union all select doc_id, 'phone', v, 0.95, 'MEDIUM', 'contact.phone' from {every(PHONE)}
    union all select doc_id, 'credit_card_unverified', v, 0.55, 'MEDIUM', 'identifier.financial_unverified.credit_card' from {CARDS}
    union all select doc_id, 'ip_address', v, 0.95, 'LOW', 'technical.ip_address' from {IPS})
"""
SCORES = f"""
  select d.doc_id, count(f.t) as n_findings, case when count(f.t) = 0 then 0 when bool_or(f.r = 'MEDIUM')
      then least(69, floor(30 + sum((case f.r when 'MEDIUM' then 8.0 else 1.5 end)::decimal(6, 2) * f.c::decimal(8, 6))))::int
      else least(29, floor(1 + sum(6.0::decimal(6, 2) * f.c::decimal(8, 6))))::int end as score
  from documents d left join ({FOUND}) f using (doc_id) group by d.doc_id
"""
BANDED = f"(select *, case when score >= 70 then 'HIGH' when score >= 30 then 'MEDIUM' when score > 0 then 'LOW' else 'NONE' end as band from ({SCORES}))"
PASSPORTS = f"(select doc_id, regexp_extract(text, 'AB[0-9]{{6}}') as value from {rows('passport')} where text like 'Passport%')"
SECRET_RULES = (("access_token", r"(?i:\b(?:access_?)?token)[\"'']?\s*[:=]\s*[\"'']([0-9A-Za-z_\-]{20,})[\"'']", 0.85), ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 0.95))

ORACLE_SQL: dict[str, str] = {
    "layer_email": plain("email", every(EMAIL)),
    "layer_phone": plain("phone", every(PHONE)),
    "layer_ip": plain("ip_address", IPS),
    "layer_secrets": " union all ".join(f"select doc_id, '{k}' as raw_type, unnest(regexp_extract_all(coalesce(text, ''), '{p}', 1)) as value, {c}::double as confidence from documents" for k, p, c in SECRET_RULES),
    "layer_url": r"""select page_id, regexp_replace(v, '[.,;:)\]}"'']+$', '') as value from (select page_id, unnest(regexp_extract_all(concat(url, ', ', html), 'https?://[^\s<>"'']+')) as v from pages)""",
    "layer_dates": plain("date", every(r"\b(?:(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2})\b", frm=rows("dates"))),
    "layer_card": finding("'credit_card'", "v", "0.95::double", "'identifier.financial.credit_card'", "'HIGH'", f"(select doc_id, regexp_extract(text, '[0-9]{{16}}') as v from {rows('card')})", luhn("v")),
    "layer_sin": finding("'sin'", "v", "0.6375::double", "'identifier.financial.sin'", "'HIGH'", f"(select doc_id, {NINE} as v from {rows('sin')})", SIN_OK),
    "layer_sin_unverified": finding("'sin_unverified'", "v", "0.55::double", "'identifier.financial_unverified.sin'", "'MEDIUM'", f"(select doc_id, {NINE} as v from {rows('sin_bare')})", SIN_OK),
    "layer_ssn": finding("'ssn'", "v", "0.6375::double", "'identifier.financial.ssn'", "'HIGH'", f"(select doc_id, regexp_extract(text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') as v from {rows('ssn')})", "substr(v, 1, 3) not in ('000', '666') and v < '900' and substr(v, 5, 2) <> '00' and substr(v, 8, 4) <> '0000'"),
    "layer_postal": finding("'postal_code_ca'", "v", "0.6::double", "'contact.address.postal_code'", "'MEDIUM'", f"(select doc_id, regexp_extract(text, 'T[0-9]X 1V[0-9]') as v from {rows('postal')})", "true"),
    "layer_dob": finding("'dob'", "v", "0.6375::double", "'identifier.personal.dob'", "'MEDIUM'", f"(select doc_id, regexp_extract(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as v from {rows('dob')})", "v <= '2026-08-06'"),
    "layer_passport": f"select doc_id, 'passport_ca' as raw_type, value, 0.7::double as confidence from {PASSPORTS}",
    "layer_uci": plain("uci", f"(select doc_id, regexp_extract(text, '[0-9]{{2}}-[0-9]{{4}}-[0-9]{{4}}') as v from {rows('uci')} where text like 'UCI%')", confidence=0.60),
    "layer_status_card": plain("status_card_registration", f"(select doc_id, regexp_extract(text, '[0-9]{{10}}') as v from {rows('status')} where text like 'status card%')", confidence=0.60),
    "layer_health_card": f"""
      with t as (select doc_id, regexp_extract(text, '[0-9]{{10}}') as v from {rows('health')}), b as (
        select *, 11 - list_sum(list_transform(generate_series(1, 8), lambda i: substr(v, i::int + 1, 1)::int * [2, 4, 8, 5, 10, 9, 7, 3][i])) % 11 as rest from t
      ), k as (select *, case when rest <= 9 and rest = substr(v, 10, 1)::int then 'bc' when {luhn('v')} then 'on' else 'ca' end as p from b)
      select doc_id, 'health_card_' || p as raw_type, v as value, 0.95::double as confidence, 'identifier.government.health_card_' || p as category, 'HIGH' as risk_level from k where p <> 'ca'
      union all select doc_id, 'health_card_ca', v, 0.60, 'identifier.government.health_card_ca', 'HIGH' from k where p = 'ca'""",
    "layer_drivers_license": finding("'drivers_license_on'", "v", "0.6::double", "'identifier.government.drivers_license_on'", "'HIGH'", f"(select doc_id, regexp_extract(text, 'A[0-9]{{4}}-[0-9]{{5}}-01231') as v from {rows('licence')} where text like '%licence%')", "true"),
    "merge_dedup": finding("'dob'", "v", "0.6375::double", "'identifier.personal.dob'", "'MEDIUM'", f"(select doc_id, regexp_extract(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as v from {rows('dob')})", "v <= '2026-08-06'"),
    "reconcile_rules": f"""with t as (select doc_id, {NINE} as v from {rows('both')})
      select doc_id, case when {SIN_OK} then 'sin' else 'passport_generic' end as raw_type, v as value, 0.6::double as confidence,
        case when {SIN_OK} then 'identifier.financial.sin' else 'identifier.government.passport_generic' end as category, 'HIGH' as risk_level from t""",
    "taxonomy_risk": "select * from (values " + ", ".join(f"('{t}', '{c}', '{dims.RISK.get('.'.join(c.split('.')[:2])) or dims.RISK.get(c.split('.')[0], 'UNKNOWN')}')" for t, c in {**dims.TAXONOMY, "unheard_of": "uncategorized.unheard_of"}.items()) + ") t(raw_type, category, risk_level)",
    "score_file": f"select doc_id, score, band, n_findings::int as n_findings from {BANDED}",
    "risk_bands": f"select band, count(*) as n from {BANDED} group by band",
    "scan_summary": f"select count(*) as scanned, 0::bigint as failed, count_if(band = 'HIGH')::bigint as high, count_if(band = 'MEDIUM')::bigint as medium, count_if(band = 'LOW')::bigint as low, count_if(band = 'NONE')::bigint as no_pii, 0::bigint as skipped from {BANDED}",
    "source_counts": f"select s as source, (case s when 'regex' then (select count(*) from ({FOUND})) when 'secrets' then (select count(*) from (select distinct doc_id, raw_type, lower(value) from ({{secrets}}))) else 0 end)::bigint as n from (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in dims.LAYERS)}) t(s)",
    "top_files": f"select doc_id, score, band from {BANDED} order by score desc, doc_id limit 10",
    "mask_values": f"""select doc_id, t as raw_type, v as value, case t when 'email' then substr(v, 1, 1) || repeat('*', instr(v, '@') - 2) || substr(v, instr(v, '@'))
        when 'phone' then regexp_replace(substr(v, 1, length(v) - 4), '[0-9]', '*', 'g') || right(v, 4) else substr(v, 1, 1) || '***' || right(v, 1) end as masked
      from ({FOUND}) where t in ('email', 'phone', 'ip_address')""",
    "mismatch_alarm": f"""with t as (select {_PATH} as file, o_orderkey % 5 as k, {NINE.replace('text', TEXTS['sin_bare'])} as v from orders), a as (
        select file, file not like '%compass%' as by_name, k = 1 as by_text, k = 0 and {SIN_OK} as cleared from t)
      select file, case when by_name and by_text then 'both' when by_name then 'filename' else 'content' end as triggered_by, count(*) as n
      from a where (by_name or by_text) and not cleared group by all""",
    "verify_demote": f"select doc_id, value, case when doc_id % 6 = 0 then 'LOW' else 'HIGH' end as risk_level, case when doc_id % 6 = 0 then 'HIGH' end as original_risk_level, doc_id % 6 in (0, 2) as llm_verified from {PASSPORTS}",
    "verification_summary": f"select count(*) as routed, count_if(doc_id % 6 = 0)::bigint as demoted, count_if(doc_id % 6 = 4)::bigint as errors from {PASSPORTS}",
    "compare_runs": f"select doc_id, 'NONE' as before_band, 'HIGH' as after_band from {PASSPORTS}",
    "eval_prf": f"""with n as (select (select count(*) from orders) as want, count(*) as got from {PASSPORTS})
      select b as bucket, want, got, got as hit, 1.0::double as precision, got / want as recall, 2 * (got / want) / (1 + got / want) as f1 from n, (values ('all'), ('passport_ca')) t(b)""",
    "layer_ocr_recovery": finding("'reconstructed_sin'", "v", "0.55::double", "'identifier.reconstructed.sin'", "'MEDIUM'", f"(select doc_id, replace(regexp_extract(text, '[0-9O]{{9}}'), 'O', '0') as v, text from {rows('ocr')})", f"text like '%O%' and text ~ '.*Number: [0-9O]*O.*' and length(v) - length(replace(v, '0', '')) <= 6 and {SIN_OK}"),
    "layer_mrz": f"""with t as (select o_orderkey as doc_id, 'AC' || {_SEVEN} as n, o_orderkey % 3 = 0 as wrong from orders)
      select doc_id, case when wrong then 'mrz_unverified' else 'mrz_document_number' end as raw_type, n as value, case when wrong then 0.55 else 0.95 end::double as confidence,
        case when wrong then 'identifier.government_unverified.mrz' else 'identifier.government.mrz_document_number' end as category, case when wrong then 'MEDIUM' else 'HIGH' end as risk_level from t
      union all select doc_id, 'mrz_dob', '900101', 0.95, 'identifier.personal.mrz_dob', 'MEDIUM' from t
      union all select doc_id, 'mrz_expiry', '300101', 0.95, 'identifier.government_low.mrz_expiry', 'LOW' from t""",
    "layer_phone_bare": plain("phone", f"(select doc_id, regexp_extract(text, '[0-9]{{10}}') as v from {rows('bare')} where text like 'Phone%')"),
    "layer_secret_types": " union all ".join(f"select o_orderkey as doc_id, '{kind}' as raw_type, {value} as value, {c}::double as confidence from orders where o_orderkey % 13 = {k}" for k, ((kind, _, value), c) in enumerate(zip(SECRETS, (0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.85, 0.85, 0.80, 0.80, 0.90), strict=True))),
    "reconcile_r4": f"""with t as (select doc_id, regexp_extract(text, '[0-9]{{3}} [0-9]{{3}} [0-9]{{3}}') as shown, replace(regexp_extract(text, '[0-9]{{3}} [0-9]{{3}} [0-9]{{3}}'), ' ', '') as v from {rows('r4')})
      select doc_id, case when {SIN_OK} then 'sin' else 'health_card_nb' end as raw_type, case when {SIN_OK} then shown else v end as value, 0.6::double as confidence,
        case when {SIN_OK} then 'identifier.financial.sin' else 'identifier.government.health_card_nb' end as category, 'HIGH' as risk_level from t""",
    "reconcile_r6": finding("'health_card_ab'", "v", "0.6::double", "'identifier.government.health_card_ab'", "'HIGH'", f"(select doc_id, {NINE} as v from {rows('r6')})", "true"),
    "mask_identifiers": f"""select doc_id, 'credit_card' as raw_type, '**** **** **** ' || right(v, 4) as masked from (select doc_id, regexp_extract(text, '[0-9]{{16}}') as v from {rows('card')}) where {luhn('v')}
      union all select doc_id, 'sin_unverified', substr(v, 1, 3) || '*****' || right(v, 1) from (select doc_id, {NINE} as v from {rows('sin_bare')}) where {SIN_OK}""",
    "score_high": f"""select doc_id, case when {SIN_OK} then 70 + floor(6.0 * 0.6375) else 0 end::int as score, case when {SIN_OK} then 'HIGH' else 'NONE' end as band, case when {SIN_OK} then 1 else 0 end::int as n_findings,
        case when {SIN_OK} then 'identifier.financial.sin' end as top_category from (select doc_id, {NINE} as v from {rows('sin')})""",
    "ext_filter": f"select {_PATH} as path, count(*) as n from orders where o_orderkey % 4 in (1, 3) group by all",
    "size_filter": "select page_id || '.txt' as path, 'too_large' as reason, round(strlen(html) / 1048576, 2) as size_mb, 1::bigint as count from pages where strlen(html) > 2048",
}
ORACLE_SQL["reconcile_r2"] = ORACLE_SQL["layer_health_card"].replace(TEXTS["health"], TEXTS["r2"])
ORACLE_SQL["source_counts"] = ORACLE_SQL["source_counts"].replace("{secrets}", ORACLE_SQL["layer_secrets"])

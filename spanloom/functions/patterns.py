"""What the built-in detectors match.

(detector, entity type, confidence, pattern, cheap test that a text must pass). Where a pattern has a group, the group ends
the match and is the span.
"""

from __future__ import annotations

import re

STREET_TYPES = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Close|Crescent"
STREET_WORD = r"(?:[A-ZÄÖÜ][A-Za-zäöüß.'\-]*|\d{1,3}(?:st|nd|rd|th))"
MONTH_NAMES = "January February March April May June July August September October November December".split()
MONTHS = "|".join([*MONTH_NAMES, *[m[:3] for m in MONTH_NAMES]])
ORDINAL = "(?:st|nd|rd|th)?"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
DATE = (
    r"(?i)\b(?:\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
    r"|\d{4}/\d{1,2}/\d{1,2}"
    r"|\d{1,2}[./]\d{1,2}[./]\d{2,4}"
    rf"|\d{{1,2}}{ORDINAL}[ \t]+(?:of[ \t]+)?(?:{MONTHS})\.?,?[ \t]+\d{{2,4}}"
    rf"|(?:{MONTHS})\.?[ \t]+\d{{1,2}}{ORDINAL},?[ \t]+\d{{2,4}}"
    rf"|(?-i:{MONTHS})[ \t]+\d{{4}}"
    rf"|\d{{1,2}}{ORDINAL}[ \t]+(?:of[ \t]+)?(?-i:{MONTHS})\.?"
    rf"|(?-i:{MONTHS})\.?[ \t]+\d{{1,2}}{ORDINAL})\b"
)
LABELS = "patient|case|file|account|acct|reference|ref|invoice|policy|member|customer|tax|vat|nino|nhs|passport|licence|license|driver|dl"
LABELLED = rf"(?i)\b(?:{LABELS})\b(?:\s+(?:number|no\.?|id|ref|is|was|of))*\s*[:#\-]?\s*((?-i:[A-Z]{{0,4}})[\s\-]?\d(?:[\d\-/]|\.(?=\d)){{2,}})"
LABEL = re.compile(f"(?:{LABELS})", re.IGNORECASE)
LABEL_TYPES = {
    "patient": "PATIENT_ID",
    "case": "CASE_ID",
    "file": "CASE_ID",
    "reference": "CASE_ID",
    "ref": "CASE_ID",
    "tax": "GOV_ID",
    "vat": "GOV_ID",
    "nino": "GOV_ID",
    "nhs": "GOV_ID",
    "passport": "GOV_ID",
    "licence": "GOV_ID",
    "license": "GOV_ID",
    "driver": "GOV_ID",
    "dl": "GOV_ID",
}
IBAN_START = r"[A-Z](?=[A-Z]\d{2}(?: ?[A-Z0-9]{1,4}){2,8}\b)"
IBAN_WHOLE = r"([A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){2,8})\b"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
DIGIT_RUN, MOST_CARD_DIGITS = r"(?<!\d)\d(?:[ \-]?\d){12,}", 19
CARD_PART = r"(?<!\d)\d{13,19}(?!\d)"
PHONE = r"(?<![\d.])\+?\d[\d \t().\-]{5,17}\d(?!\d)"
INITIALS = r"\b(?:[^\W\d_]\.){2,3}"
INITIALS_STOP = "U.S. U.K. U.N. E.U. A.M. P.M. B.C. A.D. I.E. E.G. N.B. P.S. U.S.A. D.C. A.K.A. E.T.C.".split()

SIMPLE = (
    ("email", "EMAIL", 0.99, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "@"),
    ("url", "URL", 0.98, r"(?i)\bhttps?://[^\s<>()\[\]{}\"']+", "://"),
    ("ipv4", "IP", 0.9, rf"(?<!\d)(?<!\d\.)(?:{OCTET}\.){{3}}{OCTET}(?!\d)(?!\.\d)", "."),
    (
        "ipv6",
        "IP",
        0.9,
        r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
        r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Fa-f:])",
        ":",
    ),
    ("us_ssn", "GOV_ID", 0.9, r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "-"),
    ("street_en", "ADDRESS", 0.85, rf"\b\d{{1,5}}[A-Za-z]?\s+(?:{STREET_WORD}\s+){{1,3}}(?:{STREET_TYPES})\b\.?", None),
    ("street_de", "ADDRESS", 0.85, r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|weg|platz|allee|ring)\s+\d{1,4}[a-z]?\b", None),
    ("uk_postcode", "ADDRESS", 0.85, r"\b[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}\b", None),
    ("us_state_zip", "ADDRESS", 0.8, r",\s*([A-Z]{2}\s+\d{5}(?:-\d{4})?)\b", ","),
    ("zip_labelled", "ADDRESS", 0.8, r"(?i)\b(?:zip|postal|post)[ \t]*(?:code)?[ \t]*[:#]?[ \t]*(\d{5}(?:-\d{4})?)\b", None),
    (
        "zip_after_unit",
        "ADDRESS",
        0.75,
        r"(?i)(?:Suite|Ste|Apt|Apartment|Unit|Floor|Fl|Rm|Room|P\.?O\.? Box|Box)\.?[ \t]*#?[ \t]*[0-9A-Za-z]+[ \t]*,[ \t]*(\d{5}(?:-\d{4})?)\b",
        ",",
    ),
    ("bic", "ACCOUNT_ID", 0.9, r"(?i)\b(?:BIC|SWIFT)\b\s*(?:code)?\s*[:#]?\s*((?-i:[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?))\b", None),
    ("mac", "MAC", 0.95, r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])", None),
    ("eth", "CRYPTO", 0.97, r"\b0x[a-fA-F0-9]{40}\b", "0x"),
    ("btc", "CRYPTO", 0.9, r"\b(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,41})\b", None),
    (
        "coord",
        "COORDINATES",
        0.8,
        r"[-+]?\d{1,2}\.\d{3,}[ \t]*,[ \t]*[-+]?\d{1,3}\.\d{3,}|\[[-+]?\d{1,3}\.\d+[ \t]*,[ \t]*[-+]?\d{1,3}\.\d+\]",
        ".",
    ),
    ("case_num", "CASE_ID", 0.8, r"\b(?:AZ[ \t]+)?\d{1,4}[ \t]+[A-Z][a-z]?[ \t]+\d{1,4}(?:[ \t]*/[ \t]*\d{2,4})?\b", None),
    ("ref_num", "CASE_ID", 0.7, r"\b\d{3,6}/\d{2,4}\b", "/"),
    ("initials", "PERSON", 0.55, INITIALS, "."),
    ("date", "DATE", 0.7, DATE, None),
    (
        "unit",
        "ADDRESS",
        0.8,
        r"(?i)\b(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Fl|Room|Rm|Bldg|Building)\.?[ \t]*#?[ \t]*(?=[A-Za-z]?\d)[0-9A-Za-z][0-9A-Za-z\-]{0,5}\b",
        None,
    ),
    ("age", "AGE", 0.8, r"(?i)\b\d{1,3}[ \t]*-?[ \t]*years?[ \t]*-?[ \t]*old\b|\b\d{1,3}-year-old\b|\baged?[ \t:]+\d{1,3}\b", None),
    (
        "time",
        "TIME",
        0.65,
        r"(?<![\d:])\d{1,2}:\d{2}(?::\d{2})?(?![\d:])(?:[ \t]*[AaPp]\.?[Mm]\.?\b)?|\b\d{1,2}[ \t]*[AaPp]\.?[Mm]\.?\b",
        None,
    ),
)
#: What a text has somewhere if a detector finds anything in it, so that the detector is left out at little cost: a pattern that starts
#: with what is quickly found, or one of the words, in the text without case (`folded`).
HINTS = {
    "ipv4": r"\d\.\d",
    "ipv6": r"::|(?::[0-9A-Fa-f]{1,4}){7}",
    "us_ssn": r"\d-\d",
    "street_en": r"\d[A-Za-z]?\s",
    "uk_postcode": r"\s\d[A-Z]{2}",
    "zip_after_unit": r",[ \t]*\d{5}",
    "mac": r"[:-][0-9A-Fa-f]{2}[:-]",
    "coord": r"\d\.\d",
    "case_num": r"\d[ \t]+[A-Z]",
    "initials": r"\.[^\W\d_]\.",
    "date": r"\d[-/.]\d",
    "time": r"\d:\d|\d[ \t]*[AaPp]\.?[Mm]",
}
HINT_WORDS = {
    "street_de": "strasse gasse weg platz allee ring".split(),
    "zip_labelled": "zip post".split(),
    "bic": "bic swift".split(),
    "date": [m[:3].lower() for m in MONTH_NAMES],
    "unit": "apt apartment suite ste unit fl room rm bldg building".split(),
    "age": "year age".split(),
    "labelled_id": LABELS.split("|"),
}


def folded(text: str) -> str:
    """The text without case, where whatever (?i) takes for a letter from a to z is that letter."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").casefold()


#: Detectors whose matches may have no digit.
WITHOUT_DIGITS = frozenset(("email", "url", "ipv6", "bic", "mac", "eth", "initials"))

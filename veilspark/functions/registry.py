"""Label vocabularies, patterns, thresholds and maps.

The tables of this module are fixed values: results depend on them to the letter."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Entity classes of the PII vocabulary.
PII_CLASSES = (
    "GIVENNAME", "SURNAME", "TITLE", "CITY", "STREET", "BUILDINGNUM", "ZIPCODE", "IDCARDNUM", "PASSPORTNUM", "DRIVERLICENSENUM",
    "SOCIALNUM", "TAXNUM", "CREDITCARDNUMBER", "EMAIL", "TELEPHONENUM", "DATE", "TIME", "AGE", "SEX", "GENDER",
)
#: Classes of the model with an I-only vocabulary, all shared with the arbiter.
RESTRICTED_CLASSES = (
    "GIVENNAME", "SURNAME", "EMAIL", "TELEPHONENUM", "CITY", "STREET", "ZIPCODE", "SOCIALNUM", "TAXNUM", "CREDITCARDNUMBER", "DRIVERLICENSENUM", "IDCARDNUM", "BUILDINGNUM",
)
BIOMEDICAL_CLASSES = ("Chemical", "Disease")
FINANCIAL_CLASSES = (
    "Advisors.GENERIC_CONSULTING_COMPANY", "Advisors.LEGAL_CONSULTING_COMPANY", "Generic_Info.ANNUAL_REVENUES",
    "Parties.ACQUIRED_COMPANY", "Parties.BUYING_COMPANY", "Parties.SELLING_COMPANY",
)


def bio_labels(classes) -> list[str]:
    return ["O"] + [f"{p}-{c}" for c in classes for p in "BI"]


#: (class, pattern, validator, overrides any label), in order of priority. Compiled without regard to case.
PATTERNS = (
    (
        "CREDITCARDNUMBER",
        r"(?:\b(?:4[0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}|5[1-5][0-9]{2}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}"
        r"|2(?:2[2-9][1-9]|[3-6][0-9]{2}|7[01][0-9]|720)[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}|3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{5}"
        r"|3(?:0[0-5]|[68][0-9])[0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{4}|6(?:011|5[0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4})\b|\b(?:\d[\s\-.]?){12,18}\d\b)",
        "card",
        True,
    ),
    ("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", None, False),
    ("SOCIALNUM", r"\b\d{3}-\d{2}-\d{4}\b", "ssn", False),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "iban", False),
    ("TELEPHONENUM", r"\b(?:\+?\d{1,3}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{1,4})?|\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})\b", None, False),
    ("DATE", r"\b(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/\d{2,4}|(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./]\d{2,4})\b", None, False),
    ("ZIPCODE", r"\b(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b", None, False),
    ("PASSPORTNUM", r"\b(?:[A-Z]{1,2}\d{6,9}|\d{2}[A-Z]{2}\d{5})\b", None, False),
    ("TAXNUM", r"\b(?:\d{2}-\d{7}|[A-Z]{2}\d{8,11})\b", None, False),
    ("DRIVERLICENSENUM", r"\b[A-Z]\d{6,14}\b", None, False),
)

#: Classes whose predictions must be confirmed by a pattern.
VALIDATED_CLASSES = ("SOCIALNUM",)

#: Dataset label -> model class, the full map; O: no PII here.
NEMOTRON_FULL = {
    "first_name": "GIVENNAME", "last_name": "SURNAME", "middle_name": "GIVENNAME", "name": "GIVENNAME", "user_name": "GIVENNAME", "email": "EMAIL", "phone_number": "TELEPHONENUM",
    "cell_phone": "TELEPHONENUM", "fax_number": "TELEPHONENUM", "city": "CITY", "street_address": "STREET", "zipcode": "ZIPCODE", "postcode": "ZIPCODE", "ssn": "SOCIALNUM",
    "social_security_number": "SOCIALNUM", "tax_id": "TAXNUM", "driver_license": "DRIVERLICENSENUM", "drivers_license": "DRIVERLICENSENUM", "national_id": "IDCARDNUM",
    "passport_number": "PASSPORTNUM", "credit_debit_card": "CREDITCARDNUMBER", "date": "DATE", "date_of_birth": "DATE", "date_time": "DATE", "time": "TIME", "age": "AGE", "gender": "GENDER",
    "sexuality": "GENDER", "company_name": "O", "organization": "O", "occupation": "O", "url": "O", "ip_address": "O", "ipv4": "O", "ipv6": "O", "country": "O", "state": "O", "account_number": "O",
}
#: Labels left out of unbiased evaluation.
NEMOTRON_EXCLUDED = ("middle_name", "name", "user_name", "fax_number", "date_time", "sexuality")
NEMOTRON_CLEAN = {k: v for k, v in NEMOTRON_FULL.items() if k not in NEMOTRON_EXCLUDED}
#: Answers of an arbiter that are accepted for a model class.
CLASS_ALIASES = {
    "first_name": "GIVENNAME", "last_name": "SURNAME", "middle_name": "GIVENNAME", "phone_number": "TELEPHONENUM", "cell_phone": "TELEPHONENUM", "fax_number": "TELEPHONENUM",
    "street_address": "STREET", "zipcode": "ZIPCODE", "postcode": "ZIPCODE", "ssn": "SOCIALNUM", "social_security_number": "SOCIALNUM", "tax_id": "TAXNUM", "driver_license": "DRIVERLICENSENUM",
    "drivers_license": "DRIVERLICENSENUM", "certificate_license_number": "DRIVERLICENSENUM", "national_id": "IDCARDNUM", "passport_number": "PASSPORTNUM",
    "credit_debit_card": "CREDITCARDNUMBER", "date_of_birth": "DATE", "sexuality": "GENDER",
}
#: Category of each class in the schema shared by all systems.
UNIFIED = {
    "PERSON": ("GIVENNAME", "SURNAME", "TITLE"), "LOCATION": ("CITY", "STREET", "BUILDINGNUM", "ZIPCODE"), "PHONE_NUMBER": ("TELEPHONENUM",), "EMAIL_ADDRESS": ("EMAIL",), "DATE_TIME": ("DATE", "TIME"),
    "GOV_ID": ("SOCIALNUM", "PASSPORTNUM", "DRIVERLICENSENUM", "IDCARDNUM", "TAXNUM"), "CREDIT_CARD": ("CREDITCARDNUMBER",), "AGE": ("AGE",), "GENDER": ("GENDER", "SEX"),
}
#: Integer tags of the token datasets.
CONLL_TAGS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
BC5CDR_TAGS = ("O", "B-Chemical", "B-Disease", "I-Disease", "I-Chemical")

ENTROPY_THRESHOLD, CONFIDENCE_THRESHOLD = 0.583, 0.787
PII_THRESHOLDS = {"CREDITCARDNUMBER": (0.4, 0.9), "TELEPHONENUM": (0.5, 0.85), "SOCIALNUM": (0.4, 0.9)}
#: Sliding window: content tokens of a window, and its stride.
WINDOW, STRIDE = 510, 382
MASK = "█" * 8


@dataclass(frozen=True)
class RouteConfig:
    """What is sent to the arbiter. thresholds: class -> (entropy, confidence); routable None: every class."""

    entropy: float = ENTROPY_THRESHOLD
    confidence: float = CONFIDENCE_THRESHOLD
    routable: frozenset | None = None
    blocked: frozenset = frozenset()
    routable_inside: frozenset | None = None
    thresholds: dict = field(default_factory=dict)
    selective: bool = True
    block_inside: bool = True
    o_multiplier: float = 1.5


def _config(classes, **more) -> RouteConfig:
    return RouteConfig(routable=frozenset(classes), routable_inside=frozenset(classes), **more)


PII_ROUTES = _config(PII_CLASSES, thresholds=PII_THRESHOLDS)
BIOMEDICAL_ROUTES = _config(BIOMEDICAL_CLASSES)
FINANCIAL_ROUTES = _config(FINANCIAL_CLASSES, entropy=0.5, confidence=0.8)

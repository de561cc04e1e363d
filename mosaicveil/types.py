"""Entity types, reporting classes, the span schema and the configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Entity type -> (reporting class, whether its pseudonym is made character by character).
ENTITY = {
    "PERSON": ("Names", False), "ORG": ("Organizations", False), "EMAIL": ("Contacts", False), "PHONE": ("Contacts", True),
    "URL": ("Contacts", False), "DOMAIN": ("Contacts", False), "ADDRESS": ("Addresses", False), "DOB": ("DOB", False),
    "PAN": ("Identifiers", True), "AADHAAR": ("Identifiers", True), "CIN": ("Identifiers", True), "LLPIN": ("Identifiers", True),
    "DIN": ("Identifiers", True), "SEBI_REG": ("Identifiers", True), "GSTIN": ("Identifiers", True), "PASSPORT": ("Identifiers", True),
    "IFSC": ("Financial", True), "BANK_ACCOUNT": ("Financial", True), "CREDIT_CARD": ("Financial", True),
    "IP_ADDRESS": ("Identifiers", False), "SSN": ("Identifiers", True),
}
#: Order in which detections enter the dictionary; all other types come last.
REGISTER_ORDER = ("ORG", "PERSON", "ADDRESS", "EMAIL", "URL", "DOMAIN")

SPAN = "struct<start:int,end:int,type:string,text:string,score:double,source:string>"
SPANS = f"array<{SPAN}>"


@dataclass(frozen=True)
class Config:
    """Settings of detection and pseudonymisation. as_of bounds dates of birth; salt keys the pseudonyms and is never written."""

    as_of: str = "2026-01-01"
    min_score: float = 0.5
    disabled: tuple[str, ...] = ()
    allow: tuple[str, ...] = ("Reserve Bank of India", "National Stock Exchange of India Limited", "Securities and Exchange Board of India", "Registrar of Companies", "Government of India")
    allow_domains: tuple[str, ...] = ("gov.in", "nic.in", "rbi.org.in", "nseindia.com", "bseindia.com")
    salt: str = field(default="change-me", repr=False)


def dim_entity_type(spark: SparkSession) -> DataFrame:
    """type, class, is_alnum, register_rank: one row for each type."""
    rank = {t: i for i, t in enumerate(REGISTER_ORDER)}
    return spark.createDataFrame([(t, c, a, rank.get(t, len(rank))) for t, (c, a) in ENTITY.items()], "type string, class string, is_alnum boolean, register_rank int")

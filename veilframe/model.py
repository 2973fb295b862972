"""Names shared by all modules: labels, handling states, generator kinds, schemas."""

from __future__ import annotations

# Handling states of a label (case-sensitive).
OFF = "Off"
SYNTHESIS = "Synthesis"
REDACTION = "Redaction"
GROUPING_SYNTHESIS = "GroupingSynthesis"
REPLACEMENT_SYNTHESIS = "ReplacementSynthesis"
STATES = [OFF, SYNTHESIS, REDACTION, GROUPING_SYNTHESIS, REPLACEMENT_SYNTHESIS]

# The built-in entity labels.
LABELS = [
    "CC_EXP",
    "CREDIT_CARD",
    "CVV",
    "DATE_TIME",
    "DOB",
    "EMAIL_ADDRESS",
    "EVENT",
    "GENDER_IDENTIFIER",
    "HEALTHCARE_ID",
    "IBAN_CODE",
    "IP_ADDRESS",
    "LANGUAGE",
    "LAW",
    "LOCATION",
    "LOCATION_ADDRESS",
    "LOCATION_CITY",
    "LOCATION_COMPLETE_ADDRESS",
    "LOCATION_COUNTRY",
    "LOCATION_STATE",
    "LOCATION_ZIP",
    "MEDICAL_LICENSE",
    "MICR_CODE",
    "MONEY",
    "NAME_FAMILY",
    "NAME_GIVEN",
    "NRP",
    "NUMERIC_PII",
    "NUMERIC_VALUE",
    "OCCUPATION",
    "ORGANIZATION",
    "PASSWORD",
    "PERSON",
    "PERSON_AGE",
    "PHONE_NUMBER",
    "PRODUCT",
    "PROJECT_NAME",
    "URL",
    "USERNAME",
    "US_BANK_NUMBER",
    "US_DRIVER_LICENSE",
    "US_ITIN",
    "US_PASSPORT",
    "US_ROUTING_TRANSIT_NUMBER",
    "US_SSN",
    "WORK_OF_ART",
]
#: The two families in which mentions are linked.
PERSON_LABELS = [
    "GENDER_IDENTIFIER",
    "NAME_FAMILY",
    "NAME_GIVEN",
    "NRP",
    "OCCUPATION",
    "PERSON",
]
PLACE_LABELS = [x for x in LABELS if x.startswith("LOCATION")]
DEPRECATED_LABELS = [
    "PERSON",
    "PROJECT_NAME",
    "US_DRIVER_LICENSE",
    "USERNAME",
    "WORK_OF_ART",
]

# Generator kinds.
GENERATORS = [
    "CcExp",
    "CompanyName",
    "CreditCard",
    "Cvv",
    "DateTime",
    "Email",
    "HipaaAddressGenerator",
    "IpAddress",
    "MicrCode",
    "Money",
    "Name",
    "NumericValue",
    "PersonAge",
    "PhoneNumber",
    "Scramble",
    "Ssn",
    "Url",
]

#: Generator a label uses unless its options say otherwise; the rest are scrambled.
GENERATOR_OF = {
    "CC_EXP": "CcExp",
    "CREDIT_CARD": "CreditCard",
    "CVV": "Cvv",
    "DATE_TIME": "DateTime",
    "DOB": "DateTime",
    "EMAIL_ADDRESS": "Email",
    "IP_ADDRESS": "IpAddress",
    "LOCATION": "HipaaAddressGenerator",
    "LOCATION_ADDRESS": "HipaaAddressGenerator",
    "LOCATION_CITY": "HipaaAddressGenerator",
    "LOCATION_COMPLETE_ADDRESS": "HipaaAddressGenerator",
    "LOCATION_STATE": "HipaaAddressGenerator",
    "LOCATION_ZIP": "HipaaAddressGenerator",
    "MICR_CODE": "MicrCode",
    "MONEY": "Money",
    "NAME_FAMILY": "Name",
    "NAME_GIVEN": "Name",
    "NUMERIC_VALUE": "NumericValue",
    "ORGANIZATION": "CompanyName",
    "PERSON": "Name",
    "PERSON_AGE": "PersonAge",
    "PHONE_NUMBER": "PhoneNumber",
    "URL": "Url",
    "US_ITIN": "Ssn",
    "US_SSN": "Ssn",
}

# Score by origin of a span; a higher score wins when start and length are equal.
SCORE_PATH_RULE = 1.0
SCORE_USER_RULE = 0.95
SCORE_CONTEXT = 0.92
SCORE_PATTERN = 0.9
SCORE_DICTIONARY = 0.8
SCORE_BARE_NUMBER = 0.7

# Processing states of a file, and those in which annotations can be scored.
FILE_STATES = ["Completed", "Failed", "Queued", "Running"]
SCORABLE_STATES = ["ReadyForReview", "ReviewInProgress", "Reviewed"]

#: Gold annotations, one file per row.
GOLD_SCHEMA = "text string, spans array<struct<start:int,end:int>>, fileName string"

#: Transcripts; times are milliseconds.
TRANSCRIPT_SCHEMA = (
    "text string, language string, segments array<struct<"
    "start:double,end:double,id:int,text:string,"
    "words:array<struct<start:double,end:double,word:string>>>>"
)

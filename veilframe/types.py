"""Names, priorities and row types shared by all parts."""

from __future__ import annotations

# Entity types, and the priorities by which overlapping spans are settled.
ENTITY_TYPES = (
    "PERSON", "PHONE", "PHONE_NUMBER", "EMAIL", "EMAIL_ADDRESS", "IDCN", "CN_ID_CARD", "ORG", "ORGANIZATION", "ADDRESS", "LOCATION", "URL", "ACCOUNT_NUMBER",
    "SECRET", "CREDIT_CARD", "CRYPTO", "IBAN_CODE", "US_BANK_NUMBER", "US_SSN", "US_DRIVER_LICENSE", "US_PASSPORT", "IP_ADDRESS", "DATE_TIME", "NRP", "UNKNOWN",
)
SOURCE_PRIORITY = {"schema": 100, "regex": 90, "privacy_filter": 80, "llm_judge": 70, "llm_scan": 60, "heuristic": 50}
TYPE_PRIORITY = {"SECRET": 110, "ACCOUNT_NUMBER": 105, "PHONE": 100, "EMAIL": 100, "IDCN": 100, "URL": 95, "ADDRESS": 50, "ORG": 40, "PERSON": 30}

SPAN = "struct<seq:int,start:int,end:int,text:string,type:string,source:string,confidence:double,reason:string>"
SEGMENT = "struct<seg_no:int,text:string,location:string,start_offset:int,end_offset:int,metadata:map<string,string>>"
REPLACEMENT = "struct<start:int,end:int,original:string,masked:string>"

#: What a value of a kind found by a language model is called here; every other kind is UNKNOWN.
MODEL_TYPES = {
    "PERSON": "PERSON", "NAME": "PERSON", "PHONE": "PHONE", "PHONE_NUMBER": "PHONE", "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "ID": "IDCN", "IDCN": "IDCN",
    "CN_ID_CARD": "IDCN", "ADDRESS": "ADDRESS", "LOCATION": "ADDRESS", "DATE": "DATE_TIME", "DATE_TIME": "DATE_TIME", "URL": "URL",
}
#: Labels of the token-classification model.
FILTER_LABELS = {
    "account_number": "ACCOUNT_NUMBER", "private_address": "ADDRESS", "private_date": "DATE_TIME", "private_email": "EMAIL", "private_person": "PERSON",
    "private_phone": "PHONE", "private_url": "URL", "secret": "SECRET",
}

"""Relations of the engine, as Spark types."""

from __future__ import annotations

import pyarrow as pa

# The closed set of entity types.
ENTITY_TYPES = (
    "PERSON EMAIL PHONE ADDRESS DATE DOB ORGANIZATION LOCATION IBAN CREDIT_CARD IP URL GOV_ID PATIENT_ID CASE_ID ACCOUNT_ID MAC COORDINATES CRYPTO AGE TIME"
).split()

SPAN_SQL = "struct<seq:int,start:int,end:int,entity_type:string,value:string,confidence:double,detector:string>"
SPANS_SQL = f"array<{SPAN_SQL}>"
MATCH_SQL = "struct<start:int,end:int,value:string>"

SPAN_ARROW = {"seq": pa.int32(), "start": pa.int32(), "end": pa.int32(), "entity_type": pa.string(), "value": pa.string(), "confidence": pa.float64(), "detector": pa.string()}
ENTITY_SQL = f"struct<entity_type:string,entity_key:string,canonical:string,idx:int,first:int,confidence:double,members:{SPANS_SQL}>"

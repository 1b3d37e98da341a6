"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from .functions.numbers import VALUE
from .functions.periods import PERIOD

SCOPE = (
    f"struct<period:{PERIOD},basis:string,segment:string,geography:string,accounting:string,modality:string,vintage:date>"
)
RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
EVIDENCE = (
    "struct<document_id:string,page:int,char_start:int,char_end:int,quote:string,"
    f"rects:array<{RECT}>,block_id:string,kind:string>"
)
PROVENANCE = "struct<extractor:string,prompt_version:string,pipeline_run_id:string,extracted_at:timestamp>"
CLAIM_FIELDS = (
    "id string, seq bigint, subject_id string, predicate_id string, subject_raw string, predicate_raw string, "
    f"value {VALUE}, scope {SCOPE}, evidence array<{EVIDENCE}>, confidence double, scale_inferred boolean, provenance {PROVENANCE}"
)
CLAIM_NAMES = [
    "id",
    "seq",
    "subject_id",
    "predicate_id",
    "subject_raw",
    "predicate_raw",
    "value",
    "scope",
    "evidence",
    "confidence",
    "scale_inferred",
    "provenance",
]

#: Fixed values.
RELATIONS = ["corroboration", "contradiction", "reconciled", "ambiguous", "unrelated"]
AXES = ["period", "basis", "segment", "geography", "accounting", "modality"]
UNKNOWN = "unknown"

"""Column types of documents, spans, mappings and findings."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,category:string,text:string,score:double,source:string,detector:string,structured:boolean,seq:int>"
SEGMENT = "struct<start:int,end:int,kind:string>"
ENTRY = "struct<placeholder:string,category:string,canonical:string,surfaces:array<string>,offsets:array<struct<start:int,end:int>>>"
REVIEW = "struct<start:int,end:int,category:string,text:string,score:double,placeholder:string,reason:string>"
FINDING = "struct<category:string,text:string,start:int,end:int,detector:string>"
#: What de-identification adds to a document's own columns.
RESULT = (
    f"masked_text string, spans array<{SPAN}>, segments array<{SEGMENT}>, mapping array<{ENTRY}>, review array<{REVIEW}>, findings array<{FINDING}>, blocked boolean, patient_key string, date_shift_days int, n_candidates int"
)
GOLD_NOTE = "text string, spans array<struct<start:int,end:int,label:string>>, source string, split string"

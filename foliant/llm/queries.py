"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import infill, jaccard, negatives
from .decontamination import op9_decontamination
from .language import op7_language
from .licenses import op6_licenses
from .media import op8_media
from .mixing import op2_mixing
from .sharding import op5_sharding
from .simhash import op10_simhash
from .substrings import op1_substrings
from .urls import op4_urls
from .warc import op3_warc

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_urls": op4_urls,
    "op5_sharding": op5_sharding,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_media": op8_media,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_negatives": negatives.op12_negatives,
    "op13_infill": infill.op13_infill,
}
#: For the others: SQL has no XXH64, CRC-32, base32, JPEG or trained model; tests/llm holds each query against brute force instead.
SQL: dict[str, str] = {"op11_jaccard": jaccard.SQL, "op12_negatives": negatives.SQL, "op13_infill": infill.SQL}

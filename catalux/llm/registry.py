"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontamination
from .licenses import op2_licenses
from .line_dedup import OP6_SQL, op6_line_dedup
from .minhash import OP3_SQL, op3_minhash
from .packing import op9_packing
from .pii import op10_pii
from .quality import op7_quality
from .resampling import OP13_SQL, op13_resampling
from .secret_scan import op12_secrets
from .spelling import OP11_SQL, op11_spelling
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .suffix_dedup import OP4_SQL, op4_suffix_dedup
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_licenses": op2_licenses,
    "op3_minhash": op3_minhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_spelling": op11_spelling,
    "op12_secrets": op12_secrets,
    "op13_resampling": op13_resampling,
}
SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_minhash": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_spelling": OP11_SQL,
    "op13_resampling": OP13_SQL,
}

"""The subpackage's queries and their SQL, for the entry file."""

from __future__ import annotations

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .media import op2_media
from .mixing import mixing_sql, op6_mix_sources
from .ngram_join import op5_ngram_join
from .packing import op4_packing
from .quality import op8_quality
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op7_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_media": op2_media,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_mix_sources": mixing_sql(),
    "op9_url_filter": OP9_SQL,
}

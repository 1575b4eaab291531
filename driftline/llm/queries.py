"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from functools import wraps

from ..plans.shipping import ship
from . import decontamination, license_scan, line_dedup, media_avi, mixing, ngram_join, quality, sharding, substring_dedup, token_files


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_token_files": token_files.op2_token_files,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_quality": quality.op5_quality,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_media": media_avi.op7_media,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "media_clips": media_avi.media_clips,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}
ORACLES = {"op3_decontamination": decontamination.SQL, "op9_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}

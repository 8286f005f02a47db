"""All registered queries of this subpackage."""

from __future__ import annotations

from turnloom.llm import alignment, byte_bpe_sql, centroids, decontamination, fingerprints, language, line_dedup, near_dedup, personal_data, quality, secrets, sentencepiece_codec, token_files  # noqa: F401
from turnloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

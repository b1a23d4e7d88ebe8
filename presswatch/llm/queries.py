"""All registered queries of this folder."""

from __future__ import annotations

from presswatch.llm import (  # noqa: F401
    q01_tokens,
    q02_quality,
    q03_lines,
    q04_decontaminate,
    q05_secrets,
    q06_repeats,
    q07_outliers,
    q08_near,
    q09_ppm,
    q10_bpe,
    q11_licences,
    q12_runs,
    q13_repair,
)
from presswatch.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

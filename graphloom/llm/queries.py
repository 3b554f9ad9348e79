"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_tokens, op2_language, op3_substrings, op4_chat, op5_simhash, op6_packing, op7_mixing, op8_media, op9_urls, op10_quality

_MODULES = [op1_tokens, op2_language, op3_substrings, op4_chat, op5_simhash, op6_packing, op7_mixing, op8_media, op9_urls, op10_quality]


def _name(module) -> str:
    return module.__name__.rpartition(".")[2]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {_name(m): getattr(m, _name(m)) for m in _MODULES}
ORACLES: dict[str, str] = {_name(m): m.ORACLE for m in _MODULES if hasattr(m, "ORACLE")}

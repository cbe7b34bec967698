"""Operators for preparing training text, each with one registered query."""

from . import (  # noqa: F401
    chat_format,
    chosen_path,
    decontaminate,
    filter_audit,
    html_extract,
    maxent_lm,
    mixing,
    pii,
    prefix_trie,
    quality_fm,
    quality_rules,
    simhash,
    token_codes,
)
from .common import ORACLES, QUERIES  # noqa: F401

"""All queries of this package; importing it registers them."""

from __future__ import annotations

import corpus_pipeline

from . import (  # noqa: F401
    decontaminate,
    fuzzy_lines,
    hilbert,
    markov,
    mixing,
    near_duplicates,
    quality,
    ranked_search,
    repeated_passages,
    repeated_strings,
    token_files,
    vector_duplicates,
    whitening,
)
from .registry import QUERIES, SQL

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

"""All corpus queries and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from barloom.llm import chat, collocations, decontaminate, licenses, media, neardup, packing, pieces, pii, quality, resample, toxicity, urlfilter

MODULES = (media, chat, decontaminate, licenses, urlfilter, neardup, pii, pieces, toxicity, quality, packing, resample, collocations)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()} | own

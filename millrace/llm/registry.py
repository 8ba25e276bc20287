"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import alignment, compression_quality, decontamination, licenses, mixing, nearest, quality_rules, secrets, sharding, simhash, spelling, tokens, warc

MODULES = (sharding, simhash, warc, decontamination, compression_quality, mixing, secrets, tokens, licenses, quality_rules, spelling, nearest, alignment)


def queries() -> dict:
    import corpus_pipeline

    return {**{name: f for m in MODULES for name, f in m.QUERIES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

"""The queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import columns, corpus, evaluation, exact, planted, results, spoken, stored

QUERIES = {**corpus.QUERIES, **results.QUERIES, **exact.QUERIES, **stored.QUERIES, **evaluation.QUERIES, **planted.QUERIES, **columns.QUERIES, **spoken.QUERIES}
ORACLES = {**corpus.ORACLES, **results.ORACLES, **exact.ORACLES, **stored.ORACLES, **evaluation.ORACLES, **planted.ORACLES, **columns.ORACLES, **spoken.ORACLES}

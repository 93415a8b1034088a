"""The queries of this folder."""

from __future__ import annotations

from lexiforge.llm import bestfit, decontaminate, langid, linededup, manifest, merkle, packing, periodic, pii, simhash, tokencount, tokenfile, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (simhash, packing, pii, tokencount, toxicity, tokenfile, merkle, linededup, decontaminate, langid, manifest, periodic, bestfit):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

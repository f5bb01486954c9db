"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from barograph.llm import context_mixing, hard_negatives, media, minhash, nbest_pieces, packing, quality_rules, repair, sharding, simple8b, toxicity, warc, winnowing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (context_mixing, hard_negatives, media, minhash, nbest_pieces, packing, quality_rules, repair, sharding, simple8b, toxicity, warc, winnowing):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

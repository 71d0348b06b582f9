"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, lattice, mixing, oracles, pieces, quality, shards, simhash, suffixes, tokens, warc

QUERIES = {
    "op4_shards": shards.op4_shards,
    "op7_suffixes": suffixes.op7_suffixes,
    "op1_lattice": lattice.op1_lattice,
    "op8_pieces": pieces.op8_pieces,
    "op2_chat": chat.op2_chat,
    "op10_token_counts": tokens.op10_token_counts,
    "op6_warc": warc.op6_warc,
    "op3_simhash": simhash.op3_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op9_quality_rules": quality.op9_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op4_shards": shards.OP4_SQL,
    "op5_mixing": oracles.OP5,
    "op6_warc": oracles.OP6,
    "op9_quality_rules": oracles.OP9,
    "op7_suffixes": suffixes.OP7_SQL,
    "op1_lattice": lattice.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
}

"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, chat, decontaminate, langid, merkle, mixing, neardup, packing, pii, suffixdedup, toxicity, warc, winnow

QUERIES = {
    "op1_suffix_dedup": suffixdedup.op1_suffix_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_langid": langid.op3_langid,
    "op4_pii": pii.op4_pii,
    "op5_hyperminhash": neardup.op5_hyperminhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat": chat.op7_chat,
    "op8_winnowing": winnow.op8_winnowing,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "op11_align": align.op11_align,
    "op12_merkle": merkle.op12_merkle,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op1_suffix_dedup": suffixdedup.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_hyperminhash": neardup.OP5_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_merkle": merkle.OP12_SQL,
}

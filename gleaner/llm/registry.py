"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from gleaner.llm import bytebpe, chat, crosstok, decontaminate, language, licenses, linededup, mixing, quality, repair, sharding, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_language_id": language.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_chat": chat.op7_chat,
    "op8_sharding": sharding.op8_sharding,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality": quality.op10_quality,
    "op11_crosstok": crosstok.op11_crosstok,
    "op12_repair": repair.op12_repair,
    "op13_byte_bpe": bytebpe.op13_byte_bpe,
}
ORACLES: dict[str, str] = {"op4_mixing": mixing.MIXING_SQL, "op6_line_dedup": linededup.LINES_SQL, "op7_chat": chat.CHAT_SQL, "op9_licenses": licenses.LICENSES_SQL, "op12_repair": repair.REPAIR_SQL}

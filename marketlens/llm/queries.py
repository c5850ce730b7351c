"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontam, fingerprint, hnsw, langid, licenses, lm, minhash, mixing, ranking, spelling, toxicity, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_licenses": licenses.op2_licenses,
    "op3_hnsw": hnsw.op3_hnsw,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_langid": langid.op5_langid,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat": chat.op7_chat,
    "op8_lm": lm.op8_lm,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_warc": warc.op10_warc,
    "op11_ranking": ranking.op11_ranking,
    "op12_fingerprint": fingerprint.op12_fingerprint,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {"op2_licenses": licenses.OP2_SQL, "op6_mixing": mixing.OP6_SQL, "op7_chat": chat.OP7_SQL, "op10_warc": warc.OP10_SQL, "op11_ranking": ranking.OP11_SQL, "op13_spelling": spelling.OP13_SQL}

"""The corpus operators' queries and SQL by name."""

from __future__ import annotations

from . import annulus, decontam, importance, langid, line_dedup, media, packing, pii, secrets, simhash, token_counts, token_files, toxicity

QUERIES = {
    "op1_media": media.op1_media,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_langid": langid.op4_langid,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_decontam": decontam.op9_decontam,
    "op10_secrets": secrets.op10_secrets,
    "op11_annulus": annulus.op11_annulus,
    "op12_token_files": token_files.op12_token_files,
    "op13_importance": importance.op13_importance,
}
ORACLES = {**line_dedup.ORACLE, **decontam.ORACLE, **annulus.ORACLE, **importance.ORACLE}

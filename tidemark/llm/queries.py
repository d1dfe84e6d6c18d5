"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import conversations, decontaminate, langid, licenses, line_dedup, lm, near_dedup, packing, phrases, quality, secrets, token_store, urls

QUERIES = {"op2_brown_lm": lm.op2_brown_lm, "op6_order_minhash": near_dedup.op6_order_minhash, "op8_license_scan": licenses.op8_license_scan, "op10_language_id": langid.op10_language_id, "op1_secret_scan": secrets.op1_secret_scan, "op4_token_store": token_store.op4_token_store, "op7_packing": packing.op7_packing, "op5_quality_rules": quality.op5_quality_rules, "op3_decontaminate": decontaminate.op3_decontaminate, "op9_line_dedup": line_dedup.op9_line_dedup, "op13_url_filter": urls.op13_url_filter, "op11_collocations": phrases.op11_collocations, "op12_conversation_repair": conversations.op12_conversation_repair}
SQL = {"op3_decontaminate": decontaminate.OP3_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op13_url_filter": urls.OP13_SQL, "op11_collocations": phrases.OP11_SQL}

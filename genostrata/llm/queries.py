"""Queries of the training-data operators, and SQL for those that SQL can express."""

from genostrata.llm import bpe, chat, credential_scan, decontaminate, fertility, lang_id, line_dedup, merkle, mixing, near_dedup, quality_model, repair, url_lists

QUERIES = {
    "op1_template_decontamination": decontaminate.op1_template_decontamination,
    "op2_pfair_mixing": mixing.op2_pfair_mixing,
    "op3_chat_snapshots": chat.op3_chat_snapshots,
    "op4_credential_linking": credential_scan.op4_credential_linking,
    "op5_token_fertility": fertility.op5_token_fertility,
    "op6_subword_quality": quality_model.op6_subword_quality,
    "op7_temporal_url_lists": url_lists.op7_temporal_url_lists,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_compression_langid": lang_id.op9_compression_langid,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_bpe_codec": bpe.op13_bpe_codec,
}

ORACLES: dict[str, str] = {
    "op3_chat_snapshots": chat.OP3_SQL,
    "op4_credential_linking": credential_scan.OP4_SQL,
    "op7_temporal_url_lists": url_lists.OP7_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
}

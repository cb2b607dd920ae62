"""The queries of this subpackage, and the SQL of those that SQL can express."""

from tidemark.llm import chat, compaction, decontam, langid, merkle, mixing, repair, sentences, simhash, suffixes, tokens, urls, winnow

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_tokens": tokens.op2_tokens,
    "op3_langid": langid.op3_langid,
    "op4_simhash": simhash.op4_simhash,
    "op5_winnowing": winnow.op5_winnowing,
    "op6_compaction": compaction.op6_compaction,
    "op7_decontam": decontam.op7_decontam,
    "op8_sentences": sentences.op8_sentences,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle": merkle.op11_merkle,
    "op12_urls": urls.op12_urls,
    "op13_repair": repair.op13_repair,
}
SQL = {"op1_chat": chat.OP1_SQL, "op6_compaction": compaction.OP6_SQL, "op8_sentences": sentences.OP8_SQL, "op10_mixing": mixing.OP10_SQL, "op11_merkle": merkle.OP11_SQL}

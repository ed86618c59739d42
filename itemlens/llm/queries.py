"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from itemlens.llm import bpe, credentials, dialogue, hamming, html_text, language, merkle, multiset, packing, shards, simhash, substrings, wordtable

QUERIES = {f.__name__: f for f in (
    bpe.op1_bpe, simhash.op2_simhash, multiset.op3_multiset, substrings.op4_repeats, shards.op5_jump_shards,
    credentials.op6_secrets, html_text.op7_page_text, hamming.op8_nearest_codes, language.op9_language, packing.op10_pack,
    merkle.op11_merkle, dialogue.op12_dialogue, wordtable.op13_word_table)}
SQL: dict[str, str] = {
    "op4_repeats": substrings.SQL_REPEATS, "op5_jump_shards": shards.SQL_SHARDS, "op6_secrets": credentials.SQL_SECRETS, "op8_nearest_codes": hamming.SQL_NEAREST,
    "op11_merkle": merkle.SQL_MERKLE, "op12_dialogue": dialogue.SQL_DIALOGUE}

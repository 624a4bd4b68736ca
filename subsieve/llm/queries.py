"""Names of this subpackage's queries and their SQL."""

from . import backoff, bpe, jpeg, lexical, mixing, nearest, quality, repeats, secrets, simhash, variants, warc, wordbpe

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "op2_jpeg": jpeg.op2,
    "op3_warc": warc.op3,
    "op4_secrets": secrets.op4,
    "op5_backoff": backoff.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_suffix_array": repeats.op7,
    "op8_simhash": simhash.op8,
    "op9_multi_index": nearest.op9,
    "op10_quality": quality.op10,
    "op11_word_bpe": wordbpe.op11,
    "op12_spelling_variants": variants.op12,
    "op13_lexical_search": lexical.op13,
}
ORACLES = {"op1_source_mixing": mixing.OP1_SQL, "op3_warc": warc.OP3_SQL, "op5_backoff": backoff.OP5_SQL, "op13_lexical_search": lexical.OP13_SQL}

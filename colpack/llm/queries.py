"""The registered queries of this subpackage: each applies one operator to its whole table."""

import public_tokenizers

from colpack.llm import audio, byte_bpe, licenses, packing, passages, pii, quality, secrets, simhash, token_counts
from colpack.llm.common import documents


def op1_chroma_fingerprints(spark, sf_dir):
    """The tables hold no recordings, so the whole texts' bytes are taken for 8-bit samples, with frames short enough for texts; classes, not all links."""
    return audio.align_recordings(documents(spark, sf_dir), frame=256, hop=64, every=False)


def op2_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_pii_pseudonyms(spark, sf_dir):
    """The tables are synthetic, so this query's key is no secret; the operator has no default."""
    return pii.pseudonymize(documents(spark, sf_dir), "colpack-pseudonym-key")


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_license_scans(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op9_substring_dedup(spark, sf_dir):
    return passages.repeated_passages(documents(spark, sf_dir))


def op10_secret_scans(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


def queries():
    found = (op1_chroma_fingerprints, op2_quality_rules, op3_byte_bpe, op4_best_fit_packing, op5_pii_pseudonyms, op6_simhash_near_dedup, op7_token_counts, op8_license_scans, op9_substring_dedup, op10_secret_scans)
    return {f.__name__: f for f in found}

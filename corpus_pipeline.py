"""The corpus pipeline: from raw documents to packed training sequences.

Quality rules drop documents, SimHash near-dedup leaves one of each group, substring dedup cuts
passages that earlier documents hold, secret scans mask credentials, and best-fit packing lays out
what is left.  Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.
"""

import functools

import public_tokenizers

from colpack.llm import packing, passages, quality, secrets, simhash
from colpack.llm.common import discard, materialize, owned, release


def quality_rules(spark, docs, sf_dir):
    """Operator 2: documents that the rules' posterior rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """Operator 6: one document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark, docs, sf_dir):
    """Operator 9: passages that an earlier document holds are cut."""
    return passages.cut_repeats(docs)


def secret_scans(spark, docs, sf_dir):
    """Operator 10: credentials are masked."""
    return secrets.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Operator 4: pieces and their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _stage(stage, before):
    """(name, stage): it owns what it writes on its way, and first drops what the stage before it wrote and docs don't read."""

    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        if before:
            release(docs, before.__name__)
        with owned(stage.__name__):
            return stage(spark, docs, sf_dir)

    return stage.__name__, run_stage


_IN_ORDER = (quality_rules, near_dedup, substring_dedup, secret_scans, best_fit_packing)
STAGES = [_stage(stage, before) for before, stage in zip((None, *_IN_ORDER), _IN_ORDER)]

#: No SQL: expectation-maximisation, chaining and grammar inference are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of sf_dir's documents; what a stage returns is written once for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # input tables are none of ours and stay
    return STAGES[-1][1](spark, docs, sf_dir)

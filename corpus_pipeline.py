"""Corpus pipeline: quality rules, then the stages that follow in STAGES.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. Extra columns of docs are carried; see each operator for its
defined cases.
"""

from ratinglab.llm import jaccard, pieces, pii, quality, tiling
from ratinglab.llm.common import table, written


def quality_rules(spark, docs, sf_dir):
    """Documents that the threshold table rejects go."""
    return quality.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: the smallest doc_id."""
    return jaccard.representatives(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold at least half of a benchmark item go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark, docs, sf_dir):
    """Personal data are replaced in the texts."""
    return pii.replace(docs)


def sentence_pieces(spark, docs, sf_dir):
    """doc_id, number of ids, and the digests of the ids and of the text decoded from them."""
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", surrogates),
    ("sentencepiece encoding and decoding", sentence_pieces),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages, each one operator of ``sigmill.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. ``docs`` needs
doc_id, text and source; columns of any other names go along, and none clashes
with what a stage makes. Null and empty texts are not toxic, near-duplicates of
one another (one stays), left as they are by the cuts, and not drawn, as they
have no words. A null doc_id or source is a value like any other. Repeated rows
are copies: one stays. Empty documents give empty results. Stages with Python
workers bound the bytes of a batch (``common.bound_batches``) for the session,
as the workers of all stages share an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.llm.common import bound_batches, documents, materialize, whole_rows
from sigmill.llm.mixing import draw
from sigmill.llm.packing import pack_documents
from sigmill.llm.simhash import keep_one
from sigmill.llm.suffix_dedup import remove_repeats
from sigmill.llm.toxicity import chain_labels, toxicity


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain finds toxic go."""
    bound_batches(spark)
    labels = chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(whole_rows(docs), labels, keep=("row",)).where(~F.col("toxic_flag")).select("row.*")


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group with a similarity of 0.8 or more stays."""
    bound_batches(spark)
    return keep_one(docs, shingle=5, similarity=0.8)


def cut_repeats(spark, docs, sf_dir):
    """Bytes of 200-byte strings that occur elsewhere are cut; n_chars follows."""
    bound_batches(spark)
    cut = remove_repeats(whole_rows(docs), length=200, keep=("row",))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark, docs, sf_dir):
    """Sources are drawn to weights 5, 2, 1 in turn; a document may stay out or come twice."""
    return draw(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pack(spark, docs, sf_dir):
    """Token sequences of at most 1024 ids that hold all documents."""
    import public_tokenizers

    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashing, classifiers and suffix arrays are beyond SQL; the tests hold each
#: stage against a plain version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

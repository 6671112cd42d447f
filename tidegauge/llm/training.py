"""Labelled rows for the classifiers.

Labels are learnt only from documents whose ``crc32`` of the id as text leaves a remainder
other than ``HELD_OUT`` modulo 4. A label row without an id or a label counts for nothing; of
several rows for one document the largest label holds. At most ``most`` documents are used, chosen
by a hash of the id alike at every size (a documented parameter of the two operators), so
that the sample's ids and labels, two numbers each, may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the sample, at most ``most`` rows, whatever else the tables hold.

    The documents are pruned to two columns of names of our own before anything is joined, so their
    other columns can't clash. A document whose id repeats is learnt from once, with the text of the
    least hash: a partial aggregate, so an id that a third of all rows have is one row for each task.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("int").alias("label"))
    n = own.count()
    if n > most:
        # a little less than the share, so that the bound holds whatever the hashes are like
        share = int(0.95 * most / n * 2**31)
        own = own.where(F.pmod(F.xxhash64("key"), F.lit(2**31)) < share).limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(own), F.col("id") == F.col("key"))
    return met.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))

"""The bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, and the longest text among them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], allowed: Column | None = None, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text"):
    """Arrow table (key, text, *columns) of at most ``rows`` labelled documents, the same for the same input.

    Rows are chosen by a hash of the key among those that ``allowed`` admits and
    that have all labels. The choice is made on the label table; its at most
    ``rows`` keys are then looked up in one scan of the documents.
    """
    usable = labels.where(F.col(key).isNotNull() & F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    if allowed is not None:
        usable = usable.where(allowed)
    chosen = usable.groupBy(key).agg(*[F.max(c).cast("int").alias(c) for c in columns]).orderBy(F.xxhash64(F.col(key)), key).limit(rows)
    held = docs.select(key, text).where(F.length(text) <= SAMPLE_CHARS).join(F.broadcast(chosen), key)  # at most ``rows`` rows
    return held.orderBy(F.xxhash64(F.col(key), F.col(text))).limit(rows).toArrow()

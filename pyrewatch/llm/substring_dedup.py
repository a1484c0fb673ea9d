"""Removal of repeated word passages by a compressed FM-index per shard.

Each word covered by a window of 50 consecutive words that also starts in a document with a smaller id is removed;
windows are judged on the input. ``repeats`` routes the candidate passages; a shard builds an FM-index of its passages
over a wavelet matrix and streams them through it by backward search.

Defined results: null text has no words; texts under 50 words, equal ids and repeated rows remove nothing from each
other; a null id counts as larger than any; an empty table gives no rows; extra columns are ignored, and kept as they
are by ``drop_repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.fm_index import ShardIndex
from pyrewatch.llm.repeats import NO_ID, Segment, Windows, digests, repeats, text_keys

WORDS = Windows(words=True, size=50, gram=20, cut=512)
#: Bytes of a shard, about six per word.
SHARD_BYTES = 4 << 20


def smallest_ids(segments: list[Segment], kind: Windows) -> list[np.ndarray]:
    """For every window of every segment, the smallest id among all segments that hold the same words."""
    names: dict[bytes, int] = {}
    streams = [np.array([names.setdefault(w, len(names) + 1) for w in s.content.split()], np.int64) for s in segments]
    stop = np.zeros(1, np.int64)
    text = np.concatenate([part for stream in streams for part in (stream, stop)])
    ids = np.repeat(np.array([s.smallest for s in segments], np.int64), [len(s) + 1 for s in streams])
    return ShardIndex(text, len(names) + 1, ids, kind.size).statistics(streams)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_removed, kept_sha256."""
    return digests(docs, WORDS, smallest_ids, SHARD_BYTES).withColumnRenamed("n", "n_words").drop("n_spans")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; texts without any stay as they are.

    A changed text is its kept words joined by one space; ``n_chars`` follows if there is such a column. A copy of a
    text with a smaller id becomes empty if it has a window.
    """
    columns = docs.columns
    changed = repeats(docs, WORDS, smallest_ids, SHARD_BYTES, with_text=True).select(
        F.col("key").alias("__key"), F.col("check").alias("__check"), F.col("kept").cast("string").alias("__kept"))
    keys = text_keys()
    rows = docs.withColumn("__k", keys[0]).withColumn("__c", keys[1])
    several = (rows.groupBy("__k", "__c").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).alias("__first"),
                                              F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    words = F.size(F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = (rows.join(several.withColumnsRenamed({"__k": "__k2", "__c": "__c2"}),
                      (F.col("__k") == F.col("__k2")) & (F.col("__c") == F.col("__c2")), "left")
                .join(changed, (F.col("__k") == F.col("__key")) & (F.col("__c") == F.col("__check")), "left"))
    copy = (F.col("__first") < F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))) & (words >= WORDS.size)
    text = F.when(copy, F.lit("")).otherwise(F.coalesce("__kept", "text"))
    rows = rows.withColumn("__text", text)
    out = []
    for name in columns:
        own = F.col(f"`{name}`")
        if name == "text":
            own = F.col("__text").alias("text")
        elif name == "n_chars":
            changed_size = F.char_length("__text").cast(docs.schema[name].dataType)
            own = F.when(F.col("__text") != F.col("text"), changed_size).otherwise(own).alias(name)
        out.append(own)
    return rows.select(*out)

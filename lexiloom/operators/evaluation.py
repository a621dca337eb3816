"""Evaluation: chunk precision and recall, attachment accuracy, confusion counts, tree depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.corpus import SENTENCE


def chunks(tokens: DataFrame, predicted: str = "chunk", gold: str = "chunk_ref") -> DataFrame:
    """One row: phrases right (pp), predicted but wrong (np), missed (pn), sentences all right, precision, recall, F1.

    A phrase is right if both begin at its first token and both begin anew, or the sentence ends, at the same next place.
    """
    w = Window.partitionBy(*SENTENCE).orderBy("idx")
    flags = tokens.select(*SENTENCE, "idx", F.col(predicted).alias("p"), F.col(gold).alias("g"))
    # The first token begins a phrase in both.
    first = F.row_number().over(w) == 1
    marks = flags.withColumn("p", F.col("p") | first).withColumn("g", F.col("g") | first).where("p or g")
    agree = (F.col("p") & F.col("g")).cast("int")
    marks = marks.select(*SENTENCE, "idx", "p", "g", agree.alias("agree"), F.lead(agree).over(w).alias("next"))
    right = (F.col("agree") == 1) & (F.coalesce("next", F.lit(1)) == 1)
    each = marks.groupBy(*SENTENCE).agg(F.count_if(right).alias("pp"), F.count_if(F.col("p") & ~right).alias("np"), F.count_if(F.col("g") & ~right).alias("pn"))
    total = each.agg(F.sum("pp").alias("pp"), F.sum("np").alias("np"), F.sum("pn").alias("pn"), F.count_if((F.col("np") == 0) & (F.col("pn") == 0)).alias("complete"), F.count("*").alias("sentences"))
    return rates(total)


def rates(total: DataFrame) -> DataFrame:
    """Precision, recall and F1 of one row of counts."""
    p, r = F.col("pp") / (F.col("pp") + F.col("np")), F.col("pp") / (F.col("pp") + F.col("pn"))
    return total.select("*", F.round(p, 6).alias("prec"), F.round(r, 6).alias("rec"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def attachments(arcs: DataFrame, predicted: str = "est_did", gold: str = "did") -> DataFrame:
    """One row: arcs but the root's that are right, and sentences that are right as a whole (single phrases are)."""
    last = F.max("id").over(Window.partitionBy(*SENTENCE))
    own = arcs.withColumn("_last", last)
    arc = F.col("id") < F.col("_last")
    each = own.groupBy(*SENTENCE).agg(F.count_if(arc).alias("arcs"), F.count_if(arc & (F.col(predicted) == F.col(gold))).alias("ok"))
    total = each.agg(F.sum("ok").alias("partial"), F.sum("arcs").alias("arcs"), F.count_if(F.col("ok") == F.col("arcs")).alias("complete"), F.count("*").alias("sentences"))
    return accuracy(total)


def accuracy(total: DataFrame) -> DataFrame:
    """The share of right arcs beside one row of counts."""
    return total.select("*", F.round(F.col("partial") / F.col("arcs"), 6).alias("accuracy"))


def binary(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row of confusion counts; scores from 0 up are positive."""
    up, yes = F.col(score) >= 0, F.col(y) > 0
    total = scored.agg(F.count_if(up & yes).alias("pp"), F.count_if(~up & yes).alias("pn"), F.count_if(up & ~yes).alias("np"), F.count_if(~up & ~yes).alias("nn"), F.count("*").alias("n"))
    return total.select("*", F.round((F.col("pp") + F.col("nn")) / F.col("n"), 6).alias("acc"))


def depths(arcs: DataFrame, head: str = "did") -> DataFrame:
    """(sentence, id, depth): steps from every phrase to its root. Heads lie to the right, so one pass from right to left
    over a sentence's heads gives all depths, whatever the trees' height."""
    rows = arcs.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("id", F.col(head).alias("h")))).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = b.column("h").flatten().to_pylist()
            size = b.column("h").value_lengths().to_numpy()
            depth = np.zeros(len(heads), np.int32)
            at = np.r_[0, np.cumsum(size)].tolist()
            for s, e in zip(at[:-1], at[1:]):
                own = [0] * (e - s)
                for i in range(e - s - 1, -1, -1):
                    h = heads[s + i]
                    own[i] = own[h] + 1 if h > i else 0
                depth[s:e] = own
            number = np.arange(len(heads)) - np.repeat(np.array(at[:-1]), size)
            of = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in SENTENCE), pa.array(number.astype(np.int32)), pa.array(depth)], names=[*SENTENCE, "id", "depth"])

    return rows.select(*SENTENCE, F.col("a.h").alias("h")).mapInArrow(run, "doc_id long, line_no int, id int, depth int")

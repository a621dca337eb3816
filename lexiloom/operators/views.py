"""Plain-text views: phrases with marked errors, and dependency trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.corpus import SENTENCE

BLUE, RED, END = "\x1b[34m", "\x1b[31m", "\x1b[0m"


def chunk_view(tokens: DataFrame, predicted: str = "chunk", gold: str = "chunk_ref", colour: bool = False) -> DataFrame:
    """(sentence, view): tokens with ``│`` between phrases; missed borders blue and false ones red, or ``-`` and ``+``."""
    p, g = F.col(predicted), F.col(gold)
    missed, wrong = (f"{BLUE}│{END}", f"{RED}│{END}") if colour else ("│-", "│+")
    bar = F.when(F.col("idx") == 0, "").when(p & g, "│").when(g, missed).when(p, wrong).otherwise("")
    rows = tokens.select(*SENTENCE, "idx", F.concat(bar, "surface").alias("t"))
    return rows.groupBy(*SENTENCE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ").alias("view"))


def draw(texts: list[str], heads: list[int], gold: list[int] | None = None) -> str:
    """One line a phrase, indented so that lines of arcs lead to the head below; a wrong arc names its gold head."""
    n = len(heads)
    depth = [0] * n
    for i in range(n - 1, -1, -1):
        if heads[i] > i:
            depth[i] = depth[heads[i]] + 1
    lines = []
    for i in range(n):
        arc = "" if heads[i] < 0 else "──┐"
        note = f" ({gold[i]})" if gold is not None and gold[i] != heads[i] else ""
        lines.append(f"{i:>3}: {'   ' * (max(depth) - depth[i])}{texts[i]}{arc}{note}")
    return "\n".join(lines)


def tree_view(phrases: DataFrame, head: str = "est_did", gold: str = "did") -> DataFrame:
    """(sentence, view) from phrases (sentence, id, text, head, gold)."""
    rows = phrases.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("id", "text", F.col(head).alias("h"), F.col(gold).alias("g")))).alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            views = [draw([x["text"] for x in r], [x["h"] for x in r], [x["g"] for x in r]) for r in b["r"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "line_no": b["line_no"], "view": views})

    return rows.mapInPandas(run, "doc_id long, line_no int, view string")

"""Retrieval for fact checking: nearest rows, a bounded context, and a language model that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import top_k

#: Characters of context in a prompt.
CONTEXT_SIZE = 2000

LanguageModel = Callable[[str], str]


def retrieve(df: DataFrame, vector: str, query: Sequence[float], ret: str, text: str, k: int = 1) -> DataFrame:
    """(ret, text, sim) of the ``k`` rows nearest to the query."""
    return top_k(df, vector, query, k, [ret], alias="sim").select(ret, text, "sim")


def context_frame(rows: DataFrame, title: str, text: str, size: int = CONTEXT_SIZE) -> DataFrame:
    """(n, context): one row, each article cut to an equal share of ``size``. ``rows`` are few: the retrieved ones."""
    n = rows.count()
    share = max(0, size // max(1, n) - 1)
    parts = rows.select(
        F.concat(F.lit("\n---------\n"), F.col(title).cast("string"), F.lit(": \n\n"), F.substring(text, 1, share), F.lit("\n")).alias("part"),
        *([F.col("sim")] if "sim" in rows.columns else [F.lit(0).alias("sim")]),
        F.col(title).cast("string").alias("title"),
    )
    gathered = F.array_sort(F.collect_list(F.struct("sim", "title", "part")))
    return parts.agg(F.count("*").alias("n"), F.concat_ws("", F.transform(gathered, lambda x: x["part"])).alias("context"))


def prompt(fact: str, context: str | None) -> str:
    """The question to a language model."""
    ask = f"Is the following statement true? Give reasons.\n\n{fact}"
    if context is None:
        return ask
    return f"{context}\n\nUse the articles above and name those that you rely on. {ask}"


def fact_check(fact: str, rows: DataFrame, title: str, text: str, llm: LanguageModel, use_context: bool = True) -> str:
    """The language model's answer, with or without the retrieved rows."""
    context = context_frame(rows, title, text).first()["context"] if use_context else None
    return llm(prompt(fact, context))

"""Tables from a service that gives one item for an index."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import TableSchema

#: Items of the full article collection.
ARTICLES = 6_458_670
ARTICLE_SCHEMA = "(idx_data int, id int, url string, title string, articlestart embtext)"

Fetch = Callable[[int], dict]


class HttpFetch:
    """Fetches ``{"idx": i, "char_length": n}`` by POST from ``/dataitem``."""

    def __init__(self, url: str = "http://localhost:7011", char_length: int = 120, timeout: float = 30) -> None:
        self.url, self.char_length, self.timeout = url.rstrip("/"), char_length, timeout

    def __call__(self, index: int) -> dict:
        body = json.dumps({"idx": index, "char_length": self.char_length}).encode()
        request = urllib.request.Request(self.url + "/dataitem", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["dataelement"]


def shortened(text: Column | str, length: int) -> Column:
    """The item service's cut: ``min(len, length) - 3`` characters and three dots."""
    text = F.col(text) if isinstance(text, str) else text
    kept = F.greatest(F.least(F.length(text), F.lit(length)) - 3, F.lit(0))
    return F.concat(F.substring(text, F.lit(1), kept), F.lit("..."))


def article_schema(name: str) -> TableSchema:
    return TableSchema.parse(f"{name} {ARTICLE_SCHEMA}")


def read_service(
    spark: SparkSession, fetch: Fetch, limit: int, random: bool = False, total: int = ARTICLES, seed: int = 0, tasks: int = 16
) -> DataFrame:
    """``limit`` items as (idx_data, id, url, title, articlestart), each task fetching its own indexes.

    ``random`` draws distinct indexes below ``total`` by a seeded permutation, without listing them all:
    an affine map modulo ``total`` sends 0, 1, ... to distinct indexes.
    """
    index = F.col("id")
    if random:
        step = _coprime(total, seed)
        index = F.pmod(F.col("id") * step + seed * 7919 + 1, F.lit(total))
    rows = spark.range(0, min(limit, total), 1, tasks).select(index.alias("idx"))

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            items = [fetch(int(i)) for i in frame["idx"]]
            yield pd.DataFrame({
                "idx_data": frame["idx"], "id": [int(x["id"]) for x in items], "url": [x["url"] for x in items],
                "title": [x["title"] for x in items], "articlestart": [x["articleStart"] for x in items],
            })

    return rows.mapInPandas(fetched, "idx_data long, id long, url string, title string, articlestart string")


def _coprime(total: int, seed: int) -> int:
    step = max(1, int(total * 0.618) + seed)
    while gcd(step, total) != 1:
        step += 1
    return step

"""The crawl loop as rounds of plans: fetch what is due, act, drop known bodies, follow allowed links."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.urls import allowed_pattern, without_fragment
from lodestack.operators import crawl as C
from lodestack.operators.tables import session_dir
from lodestack.sources.docs import fetched

Fetch = Callable[[str], tuple[str | None, str | None]]
Action = Callable[[DataFrame], None]


def run(spark: SparkSession, seeds: list[str], fetch: Fetch | None = None, max_pages: int | None = None, actions: tuple[Action, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of a crawl: (url, content, md5, round) of each different body, (url, error, round) of what failed.

    A url is fetched once. Actions get every page that was fetched, also of a body that is known; its links aren't
    followed, and it doesn't count. The crawl ends when nothing is left, or after the round in which max_pages
    different bodies are reached; a round is always whole. Each round writes its own rows only.
    """
    patterns = [allowed_pattern(s) for s in seeds]
    at = f"{session_dir(spark)}/crawl-{uuid.uuid4().hex}"
    due = spark.createDataFrame([(s,) for s in seeds], "url string").select(without_fragment(F.col("url")).alias("url")).distinct()
    none = {name: spark.createDataFrame([], s) for name, s in _TABLES.items()}

    def put(df: DataFrame, name: str, n: int) -> DataFrame:
        """Writes a round of a table beside the rounds before it."""
        path = f"{at}/{name}/part={n:06d}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def all_of(name: str, rounds: int) -> DataFrame:
        paths = [f"{at}/{name}/part={n:06d}" for n in range(rounds)]
        return spark.read.schema(_TABLES[name]).parquet(*paths) if paths else none[name]

    n = k = 0
    while due.head(1):
        due = put(due, "done", k)
        got = put(fetched(due, fetch), "fetched", k)
        whole = got.where("error IS NULL AND content IS NOT NULL").select("url", "content")
        for act in actions:
            act(whole)
        new = C.unique_bodies(whole).select("url", "content", "md5").join(all_of("pages", k).select("md5"), "md5", "left_anti")
        new = put(new.select("url", "content", "md5", F.lit(k).alias("round")), "pages", k)
        n += new.count()
        put(got.where("error IS NOT NULL").select("url", "error", F.lit(k).alias("round")), "errors", k)
        k += 1
        if max_pages is not None and n >= max_pages:
            break
        links = C.page_links(new.select("url", F.col("content").alias("html"))).select(F.col("link").alias("url")).distinct()
        due = C.allowed(links, patterns).join(all_of("done", k), "url", "left_anti")
    return all_of("pages", k), all_of("errors", k)


_TABLES = {"pages": "url string, content string, md5 string, round int", "errors": "url string, error string, round int", "done": "url string"}

"""The corpus: a DataFrame of parsed documents with projections, filters and fan-outs.

``Corpus`` is immutable; every method returns a new corpus or a DataFrame, and nothing runs
until the result is used. Rows that could not be parsed have ``error`` set; filters let
them pass, and ``fail_fast`` raises at the first.
"""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import parse_pages
from foliant.operators import chunking, emit
from foliant.operators.model import Layers, projected

T = TypeVar("T")


def document_text(blocks: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """Top-level blocks of each document joined."""
    items = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), joiner).alias("text"))


def last_page(blocks: DataFrame, n: int = -1) -> DataFrame:
    """Blocks of the page that is ``n`` (below 0) from each document's end."""
    last = blocks.groupBy("doc_id").agg(F.max("page").alias("_last"))
    return blocks.join(last, "doc_id").where(F.col("page") == F.col("_last") + 1 + n).drop("_last")


class Corpus:
    """``docs``: doc_id, path, format, blocks (array of structs), metadata, warnings, error."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], most_bytes: int | None = None, pages: str | None = None, layers: Layers | None = None) -> Corpus:
        from foliant.sources.scan import scan

        return cls(scan(spark, path, most_bytes, pages, layers))

    def with_config(self, pages: str | None = None, layers: Layers | None = None) -> Corpus:
        """The same documents with fewer pages (a range like "1,3,5-10") or layers; blocks without a page stay."""
        docs = self.docs
        if pages is not None:
            wanted = parse_pages(pages)
            docs = docs.withColumn("blocks", F.filter("blocks", lambda b: b["page"].isNull() | b["page"].isin(wanted)))
        return Corpus(projected(docs, layers) if layers else docs)

    # projections ------------------------------------------------------------

    def count(self) -> int:
        return self.docs.count()

    def __len__(self) -> int:
        raise TypeError("a corpus has no length without a job; use count()")

    def __iter__(self) -> Iterator[Row]:
        return self.docs.orderBy("path").toLocalIterator()

    def blocks(self) -> DataFrame:
        return self.docs.where("error is null").select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "ord", "b.*")

    def tables(self, top_only: bool = False) -> DataFrame:
        """Cells of all tables; ``top_only`` leaves out those inside lists, sections and shapes."""
        rows = self.blocks().where("kind = 'table'")
        if top_only:
            rows = rows.where("depth = 0")
        rows = rows.select("doc_id", "ord", "page", F.col("ord").alias("table_id"), F.posexplode("rows").alias("row", "r"))
        return rows.select("doc_id", "ord", "page", "table_id", "row", F.posexplode("r").alias("col", "text")).withColumn("is_header", F.col("row") == 0)

    def images(self) -> DataFrame:
        return self.blocks().where("kind = 'image'").select("doc_id", "ord", "page", F.col("text").alias("alt_text"))

    def metadata(self) -> DataFrame:
        return self.docs.select("doc_id", "path", "format", F.explode_outer("metadata").alias("key", "value"))

    def warnings(self) -> DataFrame:
        return self.docs.select("doc_id", F.posexplode("warnings").alias("ord", "w")).select("doc_id", "ord", "w.*")

    def page(self, n: int) -> DataFrame:
        """Blocks of page ``n`` from 0; a negative number counts from a document's last page."""
        if n >= 0:
            return self.blocks().where(F.col("page") == n)
        return last_page(self.blocks(), n)

    def text(self, join: str = "\n\n") -> str:
        """All texts in path order, one after another; failures are left out. Reads as it goes, one document at a time."""
        texts = document_text(self.blocks()).join(self.docs.select("doc_id", "path"), "doc_id").orderBy("path")
        return join.join(row["text"] for row in texts.select("text").toLocalIterator())

    def chunks(self, by: str = "heading", size: int = 2000) -> DataFrame:
        return chunking.chunks(self.blocks(), by, size)

    # filters ----------------------------------------------------------------

    def filter(self, test: Column | Callable[[Row], bool], columns: list[str] | None = None) -> Corpus:
        """Documents for which ``test`` holds, and all failures; a Python test that raises counts as false.

        A Python test gets its rows in Arrow batches, with all columns or those named.
        """
        if isinstance(test, Column):
            keep = F.coalesce(test, F.lit(False))
        else:

            @F.udf("boolean", useArrow=True)
            def safe(row: Row) -> bool:
                try:
                    return bool(test(row))
                except Exception:  # noqa: BLE001  a test that fails is false
                    return False

            keep = safe(F.struct(*(columns or self.docs.columns)))
        return Corpus(self.docs.where(F.col("error").isNotNull() | keep))

    def submit(self, action: Callable[[Corpus], T]) -> Future[T]:
        """Runs an action (a count, a write) beside the caller; Spark takes jobs from several threads at once."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(action, self)
        finally:
            pool.shutdown(wait=False)

    async def stream(self) -> AsyncIterator[Row]:
        """Documents in path order for an event loop, which is not blocked while rows are fetched."""
        loop, rows = asyncio.get_running_loop(), iter(self)
        while (row := await loop.run_in_executor(None, next, rows, None)) is not None:
            yield row

    def on_warnings(self, call: Callable[[Row], None]) -> int:
        """Calls a function for each warning, document by document; returns how many there were."""
        n = 0
        for row in self.warnings().toLocalIterator():
            call(row)
            n += 1
        return n

    def parallel(self, n: int) -> Corpus:
        return Corpus(self.docs.repartition(n))

    def fail_fast(self) -> Corpus:
        """Raises, with the path, when a row that failed is read."""
        good = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("boolean")).otherwise(True)
        return Corpus(self.docs.where(good))

    # sinks ------------------------------------------------------------------

    def to_jsonl(self, path: str) -> None:
        """One JSON line for each document; fails on the first failure."""
        self.fail_fast().docs.select(F.to_json(F.struct("doc_id", "path", "format", "blocks", "metadata")).alias("line")).write.text(path)

    def to_markdown(self, anchors: bool = False) -> DataFrame:
        return emit.markdown(self.blocks(), anchors)

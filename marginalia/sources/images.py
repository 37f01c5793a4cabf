"""Image uploads and remote listings as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import IMAGE_EXTENSIONS


def uploaded_pages(files: DataFrame, batch_col: str = "batch") -> DataFrame:
    """batch, name, path, page_number: image files of an upload, numbered from 1 in path order, named after the first.

    Other extensions are left out. ``files`` has path and a batch; the bytes of
    a ``binaryFile`` frame may stay with it.
    """
    extension = F.lower(F.substring_index("path", ".", -1))
    kept = files.where(F.col("path").contains(".") & extension.isin(*IMAGE_EXTENSIONS))
    order = Window.partitionBy(batch_col).orderBy("path")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return kept.withColumns({"page_number": F.row_number().over(order), "name": F.first(stem).over(order)})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder: path, length, modificationTime, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(IMAGE_EXTENSIONS) + "}").load(path)


class _Page(InputPartition):
    def __init__(self, token: str | None):
        super().__init__(token)
        self.token = token


def listing_source(client: Callable[[str | None], dict], tokens: Callable[[], list[str | None]]) -> type[DataSource]:
    """A data source ``remote_listing`` over a paginated listing.

    ``client(token)`` returns {"items": [...]}, ``tokens()`` all page tokens in
    order; pages are read in parallel. Rows keep the page and place of an item,
    so that numbering can have the gaps of skipped ones.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "remote_listing"

        def schema(self) -> str:
            return "page int, place int, id string, mime_type string, url string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Page((k, t)) for k, t in enumerate(tokens())]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            page, token = partition.token
            items = client(token).get("items", [])
            columns = [[page] * len(items), list(range(len(items))), *([i.get(k) for i in items] for k in ("id", "mimeType", "baseUrl"))]
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page", "place", "id", "mime_type", "url"])

    return Listing


def listed_images(listing: DataFrame) -> DataFrame:
    """Images of a listing that have a URL; page_number is the place among images, gaps where a URL is missing.

    Images are counted by page of the listing first; places are numbered inside
    a page only, from the sum of the pages before.
    """
    images = listing.where(F.col("mime_type").startswith("image/"))
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    counts = images.groupBy("page").agg(F.count("*").alias("n")).select("page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each page
    numbered = images.join(counts, "page").withColumn("page_number", (F.col("before") + F.row_number().over(Window.partitionBy("page").orderBy("place"))).cast("int"))
    return numbered.where(F.coalesce("url", F.lit("")) != "").select("page_number", "id", "url")

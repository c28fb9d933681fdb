"""A sink of images: ``df.write.format("imagefiles").mode("append").save(path)`` puts every row (name, content) into a file of its own.

Files appear when all tasks have succeeded; an aborted write leaves none. With mode "overwrite" the folder's files go first. A null name or content, a name
that is none, and two rows of one name are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import StructType

from chromaframe.sources.staging import Staged, Staging


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.staging, self.overwrite = Staging(path), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files = self.staging.attempt()
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                if not content.is_valid:
                    raise ValueError(f"{name} has no content")
                files.add(name.as_py() or "", content.as_py())
        return files.message()

    def commit(self, messages: list[Staged | None]) -> None:
        self.staging.commit(messages, self.overwrite)

    def abort(self, messages: list[Staged | None]) -> None:
        self.staging.abort()


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagefiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("an image has a name and its content")
        return ImageWriter(self.options["path"], overwrite)


def write_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """Images (name, content) as files in a folder."""
    spark: SparkSession = images.sparkSession
    spark.dataSource.register(ImageFiles)
    images.select("name", "content").write.format("imagefiles").mode(mode).save(path)

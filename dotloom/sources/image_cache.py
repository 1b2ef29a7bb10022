"""A cache of one file an image: a Spark data source whose writes take effect whole or not at all.

``path/data/<write>/<attempt>/<image_id>.parquet`` holds the images, ``path/commits/<number>-<write>.json`` names the
attempts that count. Executors write the files, the driver writes one small commit (its size is that of the tasks, not of
the images), and readers see committed attempts only. What a failed or killed write leaves behind is never read.
"""

import json
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, KEY = "image_cache", "image_id"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def commits(path: str) -> list[dict]:
    """The commits that count, in their order: those from the last one that replaced all before it."""
    system, base = _place(path)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True)) if f.extension == "json")
    out: list[dict] = []
    for f in found:
        with system.open_input_stream(f) as s:
            c = json.loads(s.read())
        out = [c] if c["replaces"] else [*out, c]
    return out


@dataclass
class Attempt(WriterCommitMessage):
    """What one task wrote: its folder, and how many images."""

    folder: str
    images: int


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, replaces: bool):
        self.path, self.replaces, self.at = path, replaces, schema.fieldNames().index(KEY)
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        """Images come one after the other; a file is written batch by batch, so that memory doesn't grow with an image."""
        system, base = _place(self.path)
        folder = f"data/{self.write_id}/{uuid.uuid4().hex}"
        image, out, n = None, None, 0
        try:
            for batch in iterator:
                ids = batch.column(self.at).to_pylist()
                start = 0
                while start < len(ids):
                    end = start + 1
                    while end < len(ids) and ids[end] == ids[start]:
                        end += 1
                    if out is None or ids[start] != image:
                        if out is not None:
                            out.close()
                        image, n = ids[start], n + 1
                        system.create_dir(f"{base}/{folder}", recursive=True)
                        out = pq.ParquetWriter(f"{base}/{folder}/{image}.parquet", batch.schema, filesystem=system, compression="zstd")
                    out.write_batch(batch.slice(start, end - start))
                    start = end
        finally:
            if out is not None:
                out.close()
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, base = _place(self.path)
        system.create_dir(f"{base}/commits", recursive=True)
        number = 1 + max((int(f.base_name.split("-")[0]) for f in system.get_file_info(fs.FileSelector(f"{base}/commits"))), default=0)
        text = json.dumps({"write": self.write_id, "replaces": self.replaces, "folders": sorted(m.folder for m in messages if m and m.images), "images": sum(m.images for m in messages if m)})
        # Named at once or not at all: a reader never meets half a commit.
        with system.open_output_stream(f"{base}/commits/{number:08d}-{self.write_id}.part") as s:
            s.write(text.encode())
        system.move(f"{base}/commits/{number:08d}-{self.write_id}.part", f"{base}/commits/{number:08d}-{self.write_id}.json")

    def abort(self, messages: list[Attempt | None]) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/data/{self.write_id}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/data/{self.write_id}")


@dataclass
class Folder(InputPartition):
    """The images of one task."""

    folder: str


class CacheReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.images = path, schema, None

    def partitions(self) -> list[Folder]:
        return [Folder(f) for c in commits(self.path) for f in c["folders"]]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is committed
            return
        system, base = _place(self.path)
        wanted = None if self.images is None else {str(i) for i in self.images}
        names = self.schema.fieldNames()
        for f in sorted(system.get_file_info(fs.FileSelector(f"{base}/{partition.folder}")), key=lambda f: f.path):
            if wanted is None or f.base_name.removesuffix(".parquet") in wanted:
                with pq.ParquetFile(f.path, filesystem=system) as file:
                    for batch in file.iter_batches(columns=names):
                        yield batch.select(names)


class PruningReader(CacheReader):
    """Spark takes a reader that prunes only where pushing filters to Python sources is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of image ids choose files by their names; Spark applies all other filters."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (KEY,):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.images = some if self.images is None else self.images & some
            else:
                yield f


class ImageCache(DataSource):
    """Format ``image_cache``, options ``path`` and ``prune``; read with the schema that was written."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> CacheReader:
        kind = PruningReader if self.options.get("prune", "false") == "true" else CacheReader
        return kind(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> CacheWriter:
        return CacheWriter(self.options["path"], schema, overwrite)


def read_images(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The images of a cache; none where there is none yet. Filters on ``image_id`` open the files of those images alone where ``spark.sql.python.filterPushdown.enabled`` is set."""
    spark.dataSource.register(ImageCache)
    return spark.read.format(NAME).schema(schema).option("prune", spark.conf.get(PUSHDOWN, "false")).load(path)


def write_images(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Adds the images (integer ``image_id`` and other columns) that the cache lacks, one file each; with ``overwrite`` they replace all.

    What the cache has is decided before the work starts, by the ids of its committed images. A write that fails or is killed changes nothing; run again it adds each image once.
    Rows without an image have no file: they are left out, with a warning that says so. Two writes at a time may both
    add an image.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ImageCache)
    if dict(rows.dtypes)[KEY] not in ("int", "bigint"):
        raise ValueError("image_id must be an integer: files are named by it")
    if rows.schema[KEY].nullable and not rows.where(f"{KEY} IS NULL").isEmpty():
        warnings.warn("rows without image_id are not cached", stacklevel=2)
    new = rows.where(f"{KEY} IS NOT NULL")
    if not overwrite:
        new = new.join(read_images(spark, path, f"{KEY} {dict(rows.dtypes)[KEY]}"), KEY, "left_anti").select(*rows.columns)
    new.repartition(KEY).sortWithinPartitions(KEY).write.format(NAME).mode("overwrite" if overwrite else "append").save(path)

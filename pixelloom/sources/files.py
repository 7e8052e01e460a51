"""Readers for files, images and indexes, and writers for the tables the engine keeps."""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image_heads
from ..functions.text import file_name, folder

LIST_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
INDEX_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff")

INDEX_ENTRY = T.StructType([
    T.StructField("Path", T.StringType()), T.StructField("FileSize", T.LongType()), T.StructField("LastWriteTicks", T.LongType()),
    T.StructField("Descriptor", T.ArrayType(T.FloatType())), T.StructField("Hash", T.LongType()),
    T.StructField("Tags", T.MapType(T.StringType(), T.StringType())), T.StructField("Concepts", T.ArrayType(T.StringType())),
])
INDEX_FILE = T.StructType([T.StructField("Version", T.IntegerType()), T.StructField("Entries", T.ArrayType(INDEX_ENTRY))])


def scan_files(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] | None = None, content: bool = False) -> DataFrame:
    """(path, name, folder, extension, size, mtime[, content]). Contents are read only if asked for; unreadable files are skipped, and empty ones, which Spark does not list."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    out = df.select("path", file_name(F.col("path")).alias("name"), folder(F.col("path")).alias("folder"), F.lower(F.substring_index("path", ".", -1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return out.filter(F.col("extension").isin(*extensions)) if extensions else out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, width, height, x, y, r, g, b) in long form. Spark decodes and stores blue first; files that do not decode have no rows.

    A picture is cut into its rows before any pixel is taken, so a pixel never carries or searches the whole picture.
    """
    img = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    stride = F.col("width") * F.col("nChannels")
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.struct(y.alias("y"), F.substring(F.col("data"), y * stride + 1, stride).alias("bytes")))
    row = img.select("origin", "width", "height", "nChannels", F.explode(rows).alias("row"))
    value = lambda x, c: F.conv(F.hex(F.substring(F.col("row.bytes"), x * F.col("nChannels") + c + 1, F.lit(1))), 16, 10).cast("int")
    at = lambda c: F.when(F.col("nChannels") == 1, 0).otherwise(c)
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.struct(x.alias("x"), value(x, at(2)).alias("r"), value(x, at(1)).alias("g"), value(x, at(0)).alias("b")))
    one = row.select("origin", "width", "height", F.col("row.y").alias("y"), F.explode(pixels).alias("px"))
    return one.select(F.col("origin").alias("path"), "width", "height", "px.x", "y", "px.r", "px.g", "px.b")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    return img.select("image.origin", "image.width", "image.height", (F.col("image.width") > 0).alias("decodes"))


def _opened(path: str):
    """A file of any store that Arrow knows, for reading at a place."""
    plain = re.sub(r"^file:/+", "/", path)
    store, at = (pafs.LocalFileSystem(), plain) if plain.startswith("/") else pafs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _listed(spark: SparkSession, path: str, extensions: tuple[str, ...] | None) -> DataFrame:
    files = scan_files(spark, path, extensions=extensions).select("path", F.col("size").cast("long").alias("size"))
    return files.repartition(F.xxhash64("path"))  # a listing has few large splits, opening files is what takes time


def header_sizes(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, head: int = 4096) -> DataFrame:
    """(path, width, height, bytes_read): sizes by the files' heads, without decoding; null where a head does not tell.

    Tasks open the files and read `head` bytes, and more only where a JPEG's frame header lies further back. Files that can't be opened have null sizes.
    """

    def run(batches):
        for batch in batches:
            out = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, read = None, 0
                try:
                    with _opened(name) as f:
                        data, want = b"", head
                        while len(data) < min(want, size):
                            data += f.read(min(want, size) - len(data))
                            read = len(data)
                            try:
                                found = image_heads.dimensions(data)
                            except image_heads.Short as short:
                                want = max(2 * want, short.args[0])
                except (OSError, ValueError, struct.error):
                    pass
                out.append((name, *(found or (None, None)), read))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "width", "height", "bytes_read"])

    return _listed(spark, path, extensions).mapInArrow(run, "path string, width long, height long, bytes_read long")


def file_heads(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, head: int = 1 << 17) -> DataFrame:
    """(path, head): the first bytes of each file, enough for what cameras write; files that can't be opened have a null head."""

    def run(batches):
        for batch in batches:
            heads = []
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as f:
                        heads.append(f.read(head))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["path", "head"])

    return _listed(spark, path, extensions).mapInArrow(run, "path string, head binary")


def file_blocks(batch_bytes: int = 1 << 20) -> Callable[[DataFrame, int, int], DataFrame]:
    """A reader of blocks for dedup.equal_classes() over files, whose id is their path: only the block is read, in pieces."""

    def block(rows: DataFrame, start: int, length: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                names, digests = [], []
                for name in batch.column(0).to_pylist():
                    try:
                        with _opened(name) as f:
                            f.seek(start)
                            left, digest = length, hashlib.sha256()
                            while left > 0 and (piece := f.read(min(left, batch_bytes))):
                                digest.update(piece)
                                left -= len(piece)
                    except OSError:
                        continue
                    names.append(name)
                    digests.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], names=["id", "digest"])

        return rows.select("id").mapInArrow(run, "id string, digest string")

    return block


def read_index(spark: SparkSession, path: str, version: int = 2, root: str | None = None) -> DataFrame:
    """Rows of JSON index files of the right version; damaged files give none. With a root, rows outside it are dropped."""
    rows = spark.read.schema(INDEX_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter(F.col("Version") == version).select(F.explode("Entries").alias("e"))
    out = rows.select(F.col("e.Path").alias("path"), F.col("e.FileSize").alias("file_size"), F.col("e.LastWriteTicks").alias("last_write_ticks"), F.col("e.Descriptor").alias("descriptor"), F.col("e.Hash").alias("hash"), F.col("e.Tags").alias("tags"), F.col("e.Concepts").alias("concepts"))
    return out if root is None else out.filter(F.startswith(F.lower("path"), F.lit(root.rstrip("/").lower() + "/")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Only path and unit vector of a stored index table; null vectors and those of norm 1e-9 and below are dropped."""
    from ..functions.vectors import normalised

    return read_table(spark, path).select("path", normalised(F.col("descriptor")).alias("descriptor")).filter(F.col("descriptor").isNotNull())


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: A small file in a table's folder that names the sub-folder of the version that holds.
POINTER = "_current"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version of a written table that holds; the path itself for plain tables, None if there is none."""
    folder, store = _store(spark, path)
    pointer, _ = _store(spark, f"{path.rstrip('/')}/{POINTER}")
    if store.exists(pointer):
        stream = store.open(pointer)
        try:
            return f"{path.rstrip('/')}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()
    return path if store.exists(folder) else None


def write_table(df: DataFrame, path: str, partition: str | None = None, keep: int = 1) -> str:
    """Writes a new version of a table into its folder and then moves the pointer to it in one rename, so the plan may read the old version, readers
    always find a whole table, and a write that fails anywhere leaves the old one. The version before stays for readers that have begun (`keep` of them).
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    old = current(spark, path)
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(f"{path}/{name}")
    fresh, store = _store(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    stream = store.create(fresh, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(fresh, _store(spark, f"{path}/{POINTER}")[0], how)
    versions = sorted(f.getPath().getName() for f in store.listStatus(_store(spark, path)[0]) if f.getPath().getName().startswith("v-"))
    last = (old or "").rsplit("/", 1)[-1]
    for gone in [v for v in versions if v < name and v != last][: max(0, len(versions) - 1 - keep)]:
        store.delete(_store(spark, f"{path}/{gone}")[0], True)
    return f"{path}/{name}"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The version of a written table that holds."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(at)


def folder_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def sorted_listing(files: DataFrame, key: str = "path") -> DataFrame:
    """Rows by path, case ignored; paths that differ in case alone by code point."""
    return files.orderBy(F.upper(key), key)


def indexed_folders(spark: SparkSession, root: str, index_name: str) -> DataFrame:
    """(folder): folders below a root that hold an index file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", index_name).load(root)
    return found.select(folder(F.col("path")).alias("folder")).distinct()


#: Tables that outlive a session, as columns.
STORES = {
    "texts": "path string, size long, mtime long, text string, language string, slant_stage int",
    "findings": "path string, similarity float, visible boolean, mask_name string, threshold_used float, metadata_hints array<string>",
    "masks": "name string, edge int, n int, mode int, area int, threshold float, separability float, pattern array<float>, weight array<float>, total array<double>, squares array<double>",
    "profiles": "folder string, finished boolean, n_good int, n_bad int, sum_good array<float>, sum_bad array<float>, updated timestamp",
    "folders": "path string, images int, updated timestamp",
}


def load_store(spark: SparkSession, kind: str, path: str, legacy: str | None = None) -> DataFrame:
    """A stored table of STORES; empty if nothing was stored yet. Columns that an older table lacks are null.

    With `legacy`, the JSON file of an older kind of store: if nothing was stored yet and that file is there, it is read, raised to the
    columns of today by UPGRADES and stored, once; the old file stays. If that breaks off, the next call does it again.
    """
    if current(spark, path) is None and legacy is not None and current(spark, legacy) is not None:
        old = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(legacy)
        if [c for c in old.columns if c != "_corrupt_record"]:
            save_store(UPGRADES[kind](old), kind, path)
    return read_table(spark, path, STORES[kind]) if current(spark, path) is not None else spark.createDataFrame([], STORES[kind])


def save_store(df: DataFrame, kind: str, path: str) -> None:
    """Writes the columns of a stored table; the old one stays until the new one is whole."""
    columns = df.sparkSession.createDataFrame([], STORES[kind]).schema.fields
    have = {c.lower(): c for c in df.columns}
    write_table(df.select(*((F.col(have[c.name]) if c.name in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in columns)), path)


def _masks_of_today(old: DataFrame) -> DataFrame:
    """Masks of the first kind of file: one object or a list of them, by other names, perhaps without name, mode, area or sums."""
    names = {"name": "Name", "edge": "Kante", "n": "Grundmenge", "mode": "Modus", "area": "Bereich", "threshold": "Schwelle", "separability": "Trennschaerfe", "pattern": "Muster", "weight": "Gewicht", "total": "Summe", "squares": "SummeQuadrat"}
    have = {c.lower(): c for c in old.columns}
    pick = lambda new: next((F.col(have[c.lower()]) for c in (names[new], new) if c.lower() in have), F.lit(None))
    out = old.select(*(pick(n).alias(n) for n in names)).filter(F.col("pattern").isNotNull())
    return out.withColumns({"name": F.coalesce("name", F.lit("1")), "mode": F.coalesce("mode", F.lit(0)), "area": F.coalesce("area", F.lit(0))})


#: What raises an older kind of store to the columns of today.
UPGRADES: dict[str, Callable[[DataFrame], DataFrame]] = {"masks": _masks_of_today}

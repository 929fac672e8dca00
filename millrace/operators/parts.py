"""Tables and registries kept in parts by a hash of their key, so that a batch reads and rewrites only what it may touch
(A14, A15, A17 on large tables; B16 and K2).

A table lies under ``path/part=k``. Which parts a batch touches comes to the driver, at most one number for each part.
A part is replaced whole by a dynamic overwrite; the changes are idempotent, so a job that died between two parts is run
again. One writer at a time, as with any folder of Parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.operators import lake

PARTS = 64
#: Bytes of a batch that may be broadcast to the parts; a larger one is joined by shuffling both.
BROADCAST = 64 << 20
#: Bits of a block of a Bloom filter (those of ``bitmap_construct_agg``), bits set for a hash, blocks of a part.
BITS, PROBES, BLOCKS = 32768, 4, 16


def part(keys: list[str], parts: int = PARTS) -> Column:
    """The part of a row; rows with a null among their keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write_parts(table: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Writes a table anew in parts. The column ``part`` is the operator's own: a table that has one is an error."""
    if "part" in table.columns:
        raise ValueError("a table in parts can't have a column named part")
    table.withColumn("part", part(keys, parts)).repartition(parts, "part").write.partitionBy("part").mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, path: str, schema: StructType, wanted: list[int] | None = None) -> DataFrame:
    """The rows of the wanted parts, or of all; files of other parts are not opened."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(path)
    return rows if wanted is None else rows.filter(F.col("part").isin(wanted))


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r.part for r in rows.select("part").distinct().collect())


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0


def merged(existing: DataFrame, source: DataFrame, keys: list[str], columns: list[str], updated_at: str | None, insert: bool, small: bool) -> DataFrame:
    """The touched parts after a batch. A small source is broadcast and the parts are not shuffled: rows are overwritten
    where they lie, and the keys that were met leave the source before the rest of it is inserted."""
    if not small:
        return lake.upsert(existing, source, keys, columns, updated_at) if insert else lake.update_only(existing, source, keys, columns, updated_at)
    changed = lake.update_only(existing, F.broadcast(source), keys, columns, updated_at)
    if not insert:
        return changed
    met = existing.select(*keys).join(F.broadcast(source.select(*keys)), keys, "left_semi")
    new = source.join(F.broadcast(met), keys, "left_anti")
    given = {*keys, *columns}
    blank = lambda c: F.lit(None).cast(existing.schema[c].dataType).alias(c)
    return changed.unionByName(new.select(*[F.col(c) if c in given else blank(c) for c in existing.columns]))


def upsert_parts(
    spark: SparkSession, path: str, schema: StructType, source: DataFrame, keys: list[str], columns: list[str], *,
    parts: int = PARTS, updated_at: str | None = None, insert: bool = True, broadcast: int = BROADCAST,
) -> list[int]:
    """A14 (A17 without ``insert``) on a table in parts; returns the parts that were rewritten.

    ``source`` is read several times: pass a frame that is kept. It has each key once, else ``ValueError`` (A10 picks
    one); a null in a key matches nothing and is inserted. New rows have null in columns that aren't named. An empty
    source changes nothing. With ``insert=False`` keys that the table lacks change nothing, but their parts are rewritten.
    """
    named = source.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in (*keys, *columns)])
    if not named.na.drop(subset=keys).groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("the batch has a key twice")
    touched = _touched(named.select(part(keys, parts).alias("part")))
    if touched:
        existing = read_parts(spark, path, schema, touched)
        rows = merged(existing, named, keys, columns, updated_at, insert, _bytes(named) <= broadcast)
        rows = rows.withColumn("part", part(keys, parts))
        rows.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched


def _places(content: Column, parts: int, blocks: int) -> list[Column]:
    """The part, the block and the bits of a content hash. All bits lie in one block, so one join finds them."""
    bit = lambda i: F.pmod(F.xxhash64(content, F.lit(f"bit {i}")), F.lit(BITS)).cast("int")
    block = F.pmod(F.xxhash64(content, F.lit("block")), F.lit(blocks)).cast("int")
    return [F.pmod(F.xxhash64(content), F.lit(parts)).cast("int").alias("part"), block.alias("block"), F.array(*[bit(i) for i in range(PROBES)]).alias("bits")]


def _has(filter_: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(filter_, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def register(hashes: DataFrame, path: str, batch: int, parts: int = PARTS, blocks: int = BLOCKS) -> None:
    """Adds a batch's ``content_hash`` to a registry, each once, and to its Bloom filters; nulls are left out.

    ``parts`` and ``blocks`` belong to the registry: all batches give the same. A block tells 3,000 hashes well apart;
    filters that are too full cost reads, no results. A batch that is registered again replaces its own rows; the
    hashes go first, so that a filter never lacks what a finished call has stored.
    """
    rows = hashes.select("content_hash").na.drop().distinct().select("content_hash", *_places(F.col("content_hash"), parts, blocks))
    stored = rows.select("content_hash", "part", F.lit(batch).cast("long").alias("batch"))
    stored.repartition(parts, "part").write.partitionBy("part", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/hashes")
    filters = rows.select("part", "block", F.explode("bits").alias("bit")).groupBy("part", "block").agg(F.expr("bitmap_construct_agg(bit)").alias("filter"))
    filters.repartition(1).write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")


def candidates(spark: SparkSession, path: str, hashes: DataFrame, before: int | None = None, parts: int = PARTS, blocks: int = BLOCKS) -> DataFrame:
    """(content_hash, part): those of the hashes that the registry's filters don't rule out."""
    filters = spark.read.schema("part int, block int, filter binary, batch long").parquet(f"{path}/filters")
    if before is not None:
        filters = filters.filter(F.col("batch") < before)
    whole = filters.groupBy("part", "block").agg(F.expr("bitmap_or_agg(filter)").alias("filter"))
    asked = hashes.select("content_hash").na.drop().distinct().select("content_hash", *_places(F.col("content_hash"), parts, blocks))
    return asked.join(whole, ["part", "block"]).filter(F.forall("bits", lambda b: _has(F.col("filter"), b))).select("content_hash", "part")


def registered(spark: SparkSession, path: str, hashes: DataFrame, before: int | None = None, parts: int = PARTS, blocks: int = BLOCKS) -> DataFrame:
    """(content_hash): those of the hashes that earlier batches (numbered under ``before``, if given) registered.

    Only parts that a filter names are read, so a batch of new texts reads next to nothing of the registry. ``hashes``
    is read twice. A registry that doesn't exist yet knows nothing.
    """
    if not _exists(spark, f"{path}/filters"):
        return spark.createDataFrame([], "content_hash string")
    likely = candidates(spark, path, hashes, before, parts, blocks)
    stored = spark.read.schema("content_hash string, part int, batch long").parquet(f"{path}/hashes").filter(F.col("part").isin(_touched(likely)))
    if before is not None:
        stored = stored.filter(F.col("batch") < before)
    return likely.join(stored.select("content_hash", "part"), ["part", "content_hash"], "left_semi").select("content_hash")

"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.store import materialize

_FILTER_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet, compared as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def plus(df: DataFrame, more: dict[str, str]) -> StructType:
    """The schema of df with more columns at its end."""
    return StructType([*df.schema.fields, *(f for name, kind in more.items() for f in StructType.fromDDL(f"`{name}` {kind}").fields)])


def single_spaced(text: str) -> list[str] | None:
    """The text cut before every single space and line break that stands between two other characters: all pieces but the
    first stood after a space, which is left out, but those that begin with their line break. None if the text is empty or
    has other white space, runs of it, or white space at an end."""
    flat = text.replace("\n", " ")
    if not text or flat[0] == " " or flat[-1] == " " or "  " in flat or not flat.isprintable():
        return None
    return text.replace("\n", " \n").split(" ")


class Places(dict):
    """value -> place, the next free one for a new value, which is also put in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, value: str) -> int:
        self[value] = place = len(self)
        self.new.append(value)
        return place


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort, which numpy does many times faster than the hash table of np.unique."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def _filter_blocks(wanted: DataFrame, kind: pa.DataType) -> tuple[int, DataFrame]:
    """How many bits a filter of the 64-bit hashes in the one column of `wanted` has, about 16 for each and 2**28 at most, and
    its blocks of 65,536 bits (block, bits) that are not all 0, as binaries or as lists of 64-bit integers."""
    n = wanted.count()
    bits = 1 << 19
    while bits < min(16 * n, _FILTER_BITS):
        bits *= 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for places in batch.column(1):
                b = np.zeros(8192, dtype=np.uint8)
                p = places.values.to_numpy()
                np.bitwise_or.at(b, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
                blocks.append(b.view("<i8") if pa.types.is_list(kind) else b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, kind)], ["block", "bits"])

    block, place = _place(F.col(wanted.columns[0]), bits)
    rows = wanted.select(block.alias("block"), place.alias("p"))
    packed = rows.groupBy("block").agg(F.collect_set("p").alias("ps"))
    return bits, packed.mapInArrow(pack, f"block int, bits {'array<bigint>' if pa.types.is_list(kind) else 'binary'}")


def _place(hash_: Column, bits: int) -> tuple[Column, Column]:
    place = F.pmod(hash_, F.lit(bits))  # bits is a power of two, so this is the unsigned remainder
    return F.shiftright(place, 16).cast("int"), place.bitwiseAND(F.lit(65535)).cast("int")


def id_filter(wanted: DataFrame) -> tuple[int, bytes]:
    """A filter of the 64-bit hashes in the one column of `wanted`: about 16 bits each, at most 32 MB in all; beyond that it only
    lets more through."""
    bits, packed = _filter_blocks(wanted, pa.binary())
    out = bytearray(bits // 8)
    for r in packed.collect():  # bits / 65536 blocks of 8 KB
        out[r["block"] * 8192 : (r["block"] + 1) * 8192] = r["bits"]
    return bits, bytes(out)


def split_by(wanted: DataFrame) -> Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]:
    """A function that splits tables by a column of 64-bit hashes, without moving rows: those that may stand in `wanted` (one
    column, distinct), which are all that do and, while the filter of 32 MB at most is not full, about one in 16 to 32 of the
    others, and those that do not. The filter is a written table that is broadcast."""
    bits, packed = _filter_blocks(wanted, pa.list_(pa.int64()))
    blocks = F.broadcast(materialize(packed.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")), "filter"))

    def split(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        block, place = _place(F.col(column), bits)
        there = (F.col("_block") == block) & (F.bit_get(F.get("_bits", F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1)
        return df.join(blocks, there, "left_semi"), df.join(blocks, there, "left_anti")

    return split

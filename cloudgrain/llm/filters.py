"""Bit maps of fixed size that pass the rows of a set of keys (and a few more, never fewer)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix

PART = 16  # a part holds 65,536 bits


def bit_maps(marked: DataFrame, place: Column, bits: int, flags: dict[str, Column]) -> dict[str, np.ndarray]:
    """For each flag: the bit map of the places (0 .. 2**bits - 1) of ``marked`` that have it.

    Places are combined before the shuffle and packed in tasks; the driver gets 2**bits
    bits per map at most, whatever the number of rows.
    """
    names = list(flags)
    rows = marked.select(place.alias("_place"), *[c.alias(n) for n, c in flags.items()])
    rows = rows.select(F.shiftright("_place", PART).cast("int").alias("part"), F.col("_place").bitwiseAND((1 << PART) - 1).cast("int").alias("bit"), *names)
    rows = rows.groupBy("part", "bit").agg(*[F.max(n).alias(n) for n in names])

    def pack(table: pa.Table) -> pa.Table:
        bit = table.column("bit").to_numpy()
        out = {"part": table.column("part").slice(0, 1)}
        for n in names:
            flag = np.zeros(1 << PART, bool)
            flag[bit[table.column(n).to_numpy(zero_copy_only=False)]] = True
            out[n] = [np.packbits(flag, bitorder="little").tobytes()]
        return pa.table(out)

    maps = {n: np.zeros((1 << (bits - PART), 1 << (PART - 3)), np.uint8) for n in names}
    for r in rows.groupBy("part").applyInArrow(pack, "part int, " + ", ".join(f"{n} binary" for n in names)).collect():
        for n in names:
            maps[n][r["part"]] = np.frombuffer(r[n], np.uint8)
    return {n: m.ravel() for n, m in maps.items()}


def has(bit_map: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bit_map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the long ids of a one-column table, by multiplicative hash."""
    (name,) = ids.columns

    def places(batches):
        schema = pa.schema([("place", pa.int64())])
        for batch in batches:
            found = np.unique(_place(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], schema=schema)

    marked = ids.where(F.col(name).isNotNull()).mapInArrow(places, "place long")
    return bit_maps(marked, F.col("place"), bits, {"any": F.lit(True)})["any"]


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def passes(bit_map: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    return has(bit_map, _place(ids, bits))

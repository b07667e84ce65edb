"""What the operators of this subpackage share: reading tables, words, hashes, packed exchange."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.components import connected_components, discarded, shared_folder, swept, written

__all__ = ["connected_components", "discarded", "shared_folder", "swept", "written", "table", "fold_words", "utf8"]

#: A-Z to a-z; tab to carriage return become spaces. Bytes from 0x80 up are untouched, so UTF-8 stays whole.
SPACE_FOLD = bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: A-Z to a-z; every other ASCII byte that is no letter or digit becomes a space.
ALNUM_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fold_words(text: bytes, fold: bytes = SPACE_FOLD) -> list[bytes]:
    return text.translate(fold).split()


def local_path(folder: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for any store that pyarrow knows by its scheme."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def strings(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as empty, without decoding to str."""
    if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def slices(b: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts hold about ``most`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < b.num_rows:
        yield b.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finalizer over uint64 arrays (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what is run within, put back afterwards."""
    held = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim_memory() -> None:
    """Give freed memory back to the system, where the C library can: workers live on from stage to stage."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
        pa.default_memory_pool().release_unused()
    except (OSError, AttributeError):
        pass

"""Text columns through Python in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def map_texts(df: DataFrame, keep: Sequence[str], make: Callable[[], Callable], fields: Sequence[tuple[str, DataType]],
              text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``keep`` and new columns computed from the texts.

    ``make`` runs once per task and gives a function from a list of texts (null
    as None) to one list or Arrow array per field. Only the kept columns and the
    text cross to Python, so other columns may have any name.
    """
    schema = StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in fields])
    names, body = [*keep, *(n for n, _ in fields)], fresh("_text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in chunks(batch, body, limit):
                made = work(part.column(body).to_pylist())
                found = [part.column(c) for c in keep] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays(found, names=names)

    return df.select(*columns(keep), F.col(f"`{text}`").alias(body)).mapInArrow(run, schema)

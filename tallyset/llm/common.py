"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def unit(*names: str) -> Column:
    """A hash of these columns as a number from 0 to 1, less than 1."""
    return F.pmod(F.xxhash64(*names), F.lit(1 << 31)).cast("double") / float(1 << 31)


def sampled(docs: DataFrame, marks: DataFrame, most_chars: int) -> tuple[list[str], list[int]]:
    """Texts and marks to learn from, in the order of doc_id: of docs (doc_id, text) one row for each of the few marks
    (doc_id, mark; doc_id distinct), as far as all of them have most_chars characters, in the order of a hash. A null text
    counts as the empty one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(marks), "doc_id")  # a bounded sample
    rows = staged(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("mark").alias("mark")))
    left, fits = most_chars, []
    for r in rows.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            left -= r.n
            fits.append((r.doc_id,))
    some = docs.sparkSession.createDataFrame(fits, rows.select("doc_id").schema)
    found = sorted((r.doc_id, r.text, r.mark) for r in rows.join(F.broadcast(some), "doc_id", "left_semi").collect())
    return [t for _, t, _ in found], [m for *_, m in found]


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[list]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    text: str = "text",
    where: int | None = None,
) -> DataFrame:
    """Adds columns that Python computes from the text, Arrow batch by Arrow batch.

    make() is called once a task and gives a function from a list of texts to a list of value lists, one for each
    of fields. keep: the input columns that stay (all by default); a kept column with the name of a new one gives
    way. where: the index of a Boolean among fields; only rows where it is true stay, and that column goes.
    """
    stay = [f for i, f in enumerate(fields) if i != where]
    new = {f.name.lower() for f in stay}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *stay])
    types = [to_arrow(f.dataType) for f in fields]
    columns = [c for c in df.columns if c in keep or c == text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for part in small(batch, text):
                made = of(part.column(text).to_pylist())
                arrays = [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
                cols = [part.column(c) for c in keep] + [a for i, a in enumerate(arrays) if i != where]
                out = pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])
                yield out if where is None else out.filter(arrays[where])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def small(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of memory, to bound what Python holds at once."""
    rows = max(1, min(batch.num_rows, most * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bitmap(hashes: DataFrame, n: int, most_bits: int) -> np.ndarray:
    """Bits of the hashes (h), by their high bits; 32 bits for each of n, at most most_bits. It comes to the driver in
    blocks that each took one task."""
    log2 = max(16, min(int(np.log2(most_bits)), int(np.ceil(np.log2(max(32 * n, 2))))))
    block = min(16, log2)
    at = F.shiftrightunsigned("h", 64 - log2)
    spots = hashes.select(F.shiftright(at, block).alias("block"), at.bitwiseAND((1 << block) - 1).cast("int").alias("bit")).distinct()

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << block, dtype=np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << log2) // 8, dtype=np.uint8)
    size = (1 << block) // 8
    for r in spots.groupBy("block").applyInArrow(pack, "block long, bits binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - int(np.log2(len(bits) * 8)))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

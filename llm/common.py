"""Helpers that the operators share: columns, batches and words."""

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mandigrid.session import materialise

# A word is a run of other characters than space, tab, line feed, vertical tab, form feed and
# carriage return; bytes.split() divides UTF-8 at just these.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that a function of ``per_row`` gets at once.
ROWS = 1_000
#: Of a Python worker: what it holds from task to task, by its key, one at a time; and the keys
#: asked for since a task began.
_KEPT: dict[Hashable, object] = {}
_ASKED: set[Hashable] = set()
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def kept(key: Hashable, make: Callable):
    """What ``make()`` returned when ``key`` was first asked for. A worker serves many tasks and keeps
    it until another key is asked for, or a task of ``per_row`` begins that asks for none."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def begun(make: Callable) -> Callable:
    """``make()`` at the begin of a task; what the worker kept for other tasks goes."""
    _ASKED.clear()
    function = make()
    if _KEPT and not _ASKED:
        _KEPT.clear()
        give_back()
    return function


def give_back() -> None:
    """Free memory that Arrow and the C library hold for later goes back to the system, as a worker
    lives on beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of ``text`` in UTF-8, A-Z lower-cased if asked for; none for null."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def texts(column: pa.Array) -> Iterator[str]:
    """The values one after the other, null as the empty text: a batch of long texts is never
    held as Python strings all at once."""
    for value in column:
        yield value.as_py() or ""


def per_row(df: DataFrame, inputs: list[str], outputs: str, make: Callable, keep: list[str]) -> DataFrame:
    """``keep`` and, after it, the columns ``outputs`` that a Python function makes of ``inputs``.

    ``make()`` is called once a task and returns a function of one record batch (ROWS rows or fewer,
    with the columns ``inputs``) that returns the arrays of ``outputs``. What a worker kept for
    tasks of other functions goes before, and unused memory is given back at the task's end. Columns
    in ``keep`` pass through untouched, and new ones replace old ones of the same name.
    """
    added = T.StructType.fromDDL(outputs)
    passing = [c for c in keep if c not in added.fieldNames()]
    fed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(passing)],
                    *[F.col(f"`{c}`").alias(f"in_{c}") for c in inputs])
    passed = T.StructType([T.StructField(f.name, f.dataType, True) for f in fed.schema.fields[:len(passing)]])
    arrow = to_arrow_schema(T.StructType(passed.fields + added.fields))

    def run(batches):
        function = begun(make)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                given = pa.RecordBatch.from_arrays(batch.columns[len(passing):], names=inputs)
                columns = batch.columns[:len(passing)] + list(function(given))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        give_back()

    out = fed.mapInArrow(run, T.StructType(passed.fields + added.fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(passing)], *added.fieldNames())


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def listed(spark: SparkSession, ids: list, field: T.StructField) -> DataFrame:
    """A bounded list of ids as a table of the one column ``field``, made without Python workers."""
    schema = T.StructType([T.StructField(field.name, field.dataType)])
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(ids, arrow.field(0).type)], schema=arrow), schema)


def afforded(rows: list[tuple], size: int) -> list:
    """Ids of the ``rows`` (id, label, bytes) that ``size`` bytes have room for, in the order given.

    Each label has an equal share; a row too long for what is left of it is passed over. What
    shares leave goes to rows passed over, again in order.
    """
    labels = {label for _, label, _ in rows}
    left = {label: size // len(labels) for label in labels}
    taken = set()
    for i, label, n in rows:
        if n <= left[label]:
            left[label] -= n
            taken.add(i)
    spare = sum(left.values())
    for i, _, n in rows:
        if i not in taken and n <= spare:
            spare -= n
            taken.add(i)
    return [i for i, _, _ in rows if i in taken]


def whole_texts(sample: DataFrame, size: int, purpose: str) -> tuple[list[str], list]:
    """Texts and labels of a bounded ``sample`` (doc_id, text, label), at most ``size`` bytes of
    text in all, in the order of a hash of the id. One row is used of an id.

    Sizes are found on Spark, and only texts that fit reach the driver. It is an error if that
    leaves a label without any text.
    """
    sized = sample.dropDuplicates(["doc_id"]).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    sized = materialise(sized.select("doc_id", "text", "label", "size"), purpose)
    order = (F.xxhash64("doc_id", F.lit(1)), F.col("doc_id"))
    rows = [tuple(r) for r in sized.select("doc_id", "label", "size").orderBy(*order).collect()]  # bounded by the sample
    ids = afforded(rows, size) if rows else []
    chosen, label_of = set(ids), {i: label for i, label, _ in rows}
    lost = set(label_of.values()) - {label_of[i] for i in ids}
    if lost:
        raise ValueError(f"no text of label {sorted(lost)} fits into {size} bytes")
    if not ids:
        return [], []
    wanted = listed(sample.sparkSession, list(chosen), sized.schema["doc_id"])
    found = sized.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").collect()  # ``size`` bytes at most
    text_of = {r["doc_id"]: r["text"] or "" for r in found}
    return [text_of[i] for i in ids], [label_of[i] for i in ids]


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes: the first bytes of all, the second ones, and so on, compressed."""
    planes = np.ascontiguousarray(values, f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, width: int = 4) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=width * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, size).T.copy().view(f"<u{width}").ravel()

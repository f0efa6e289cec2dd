"""Token counts without token ids: each distinct pre-token is cut into pieces once."""

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.bpe import Bpe, loaded, shipped
from llm.common import packed, unpacked
from mandigrid.session import materialise

# Bytes of text in a chunk, whose distinct pre-tokens are looked up together.
CHUNK_BYTES = 32 << 20


class Chunk:
    """Documents with their pre-token frequencies; pre-tokens are numbered as they come."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids, self.sizes, self.special, self.spans = [], [], [], []
        self.steps, self.counts, self.bytes = array("I"), array("I"), 0

    def add(self, doc_id, text: str, bpe: Bpe) -> None:
        size, special, found = len(text.encode()), 0, Counter()
        for part, marked in bpe.segments(text):
            if marked:
                special += 1
            else:
                found.update(bpe.pretokens(part))
        places = self.places
        order = sorted((places.setdefault(p, len(places)), n) for p, n in found.items())
        last = 0
        for place, n in order:
            self.steps.append(place - last)
            self.counts.append(n)
            last = place
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.special.append(special)
        self.spans.append(len(order))
        self.bytes += size

    def row(self, name: int) -> list:
        return [[name], [self.ids], [self.sizes], [self.special], [self.spans],
                [packed(np.array(self.steps))], [packed(np.array(self.counts))], [list(self.places)]]


def count_tokens(docs: DataFrame, tokenizer: str, limit=1024, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each document.

    Documents are gathered in chunks of 32 MB, which keep their frequencies per pre-token and
    send out each distinct pre-token once. Shuffled by pre-token and sorted, equal ones stand
    together; one merge counts the pieces for all chunks that ask (a pre-token has a row for
    each chunk, however often it occurs). The counts go back by chunk and are multiplied with
    the frequencies. The texts are read once and never shuffled.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each; ids may
    be null, of any type. Strings of special tokens count as one token, as the library does.
    """
    spark = docs.sparkSession
    content = shipped(spark, tokenizer)
    fed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = fed.schema["doc_id"].dataType
    made = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("special", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("steps", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(made)

    def gather(batches):
        bpe, _ = loaded(content.value)
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        done = lambda: pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(chunk.row(number), arrow)], schema=arrow)
        for batch in batches:
            for row, words in zip(batch.column(0), batch.column(1)):
                chunk.add(row.as_py(), words.as_py() or "", bpe)
                if chunk.bytes >= CHUNK_BYTES:
                    yield done()
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield done()

    chunks = materialise(fed.mapInArrow(gather, made), "token-chunks")
    words = chunks.select("chunk", F.posexplode("words").alias("place", "word"))

    def cut(batches):
        bpe, _ = loaded(content.value)
        word, n = None, 0
        for batch in batches:
            counts = np.empty(len(batch), np.int32)
            for i, value in enumerate(batch.column(2)):
                if (value := value.as_py()) != word:
                    word, n = value, len(bpe.merge(value.encode()))
                counts[i] = n
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts)], names=["chunk", "place", "n"])

    counted = (words.repartition("word").sortWithinPartitions("word").select("chunk", "place", "word")
               .mapInArrow(cut, "chunk long, place int, n int"))
    final = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()),
                          T.StructField("n_tokens", T.LongType())])
    final_arrow = to_arrow_schema(final)

    def total(counts, chunk):
        pieces = np.zeros(len(counts), np.int64)
        pieces[counts["place"].to_numpy()] = counts["n"].to_numpy()
        ids, sizes, tokens = [], [], []
        for row in chunk.to_pylist():
            spans = np.array(row["spans"], np.int64)
            size = int(spans.sum())
            steps, freq = unpacked(row["steps"], size).astype(np.int64), unpacked(row["counts"], size)
            ends = np.cumsum(spans)
            running = np.cumsum(steps)  # places restart with each document
            base = np.where(ends > spans, np.concatenate([[0], running])[ends - spans], 0)
            places = running - np.repeat(base, spans)
            sums = np.concatenate([[0], np.cumsum(pieces[places] * freq)]) if size else np.zeros(1, np.int64)
            ids += row["ids"]
            sizes += row["sizes"]
            tokens.append(sums[ends] - sums[ends - spans] + np.array(row["special"], np.int64))
        n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(ids, final_arrow[0].type), pa.array(sizes, pa.int64()), pa.array(n)],
                                    schema=final_arrow)

    held = chunks.select("chunk", "ids", "sizes", "special", "spans", "steps", "counts")
    out = counted.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(total, final)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

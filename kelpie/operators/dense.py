"""Dense vectors: embedding and exact batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.udf import embedder


def embed(chunks: DataFrame, encode: Callable | None = None, text: str = "text") -> DataFrame:
    """vectors(chunk_id, embedding) of chunks, without a prefix."""
    return chunks.select("chunk_id", embedder(encode)(F.col(text)).alias("embedding"))


def embed_queries(queries: DataFrame, encode: Callable | None = None, model: str = "", s: Settings = DEFAULT) -> DataFrame:
    """queries with an embedding; models of the bge family get a prefix in front of queries (never of chunks)."""
    text = F.concat(F.lit(s.query_prefix), "query") if "bge" in model.lower() else F.col("query")
    return queries.withColumn("embedding", embedder(encode)(text))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block of queries and of vectors. Up to one block of queries is sent to every task.
QUERY_BLOCK, VECTOR_BLOCK = 2000, 4096


def _blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(<name>_ids, <name>): rows of (key, embedding) packed to blocks of 64-bit numbers. A batch of Arrow rows is cut, never joined with the next."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) % part.num_rows or (np.diff(part.column(1).offsets) != len(flat) // part.num_rows).any():
                    raise ValueError("vectors differ in length")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_ids", name])

    return df.where("embedding is not null").select(key, "embedding").mapInArrow(run, f"{name}_ids array<{df.schema[key].dataType.simpleString()}>, {name} binary")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of largest inner product per query; ties by chunk id.

    Exact. Both sides are packed to blocks, and each pair of blocks is one product of matrices that leaves k rows a query, so neither the plan nor
    the driver grows with the queries. One block of queries is broadcast; more of them meet the vectors pair by pair.
    """
    import numpy as np
    import pyarrow as pa

    kq, kc = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    asked = _blocks(queries, "query_id", QUERY_BLOCK, "q")
    few = queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    both = _blocks(vectors, "chunk_id", VECTOR_BLOCK, "x").crossJoin(F.broadcast(asked) if few else asked)

    def run(batches):
        for b in batches:
            x_ids, xs, q_ids, qs = (b.column(b.schema.get_field_index(c)) for c in ("x_ids", "x", "q_ids", "q"))
            for i in range(b.num_rows):
                ids, names = x_ids[i].values, q_ids[i].values
                x, q = (np.frombuffer(v[i].as_buffer(), np.float64).reshape(n, -1) for v, n in ((xs, len(ids)), (qs, len(names))))
                s = q @ x.T
                if s.shape[1] > k:
                    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    at = np.nonzero(s >= cut - 1e-9)  # all that tie with the k-th stay, as ids decide later
                else:
                    at = np.nonzero(np.ones_like(s, bool))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at[0])), ids.take(pa.array(at[1])), pa.array(s[at])], names=["query_id", "chunk_id", "score"])

    out = both.select("x_ids", "x", "q_ids", "q").mapInArrow(run, f"query_id {kq}, chunk_id {kc}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

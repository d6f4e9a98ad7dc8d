"""Scaling and encoding of rows as they arrive.

Both are row-local, so a stream needs no state and no watermark: the batch functions
apply unchanged. The stored parameters and weights are read when the query starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from broadloom.plans.encoding import encode_matrix


def encode_stream(
    stream: DataFrame, params: DataFrame, scaler: str | None, layers: DataFrame, weights: DataFrame, model: str
) -> DataFrame:
    """Encode a streaming matrix."""
    if not stream.isStreaming:
        raise ValueError("encode_stream takes a streaming DataFrame")
    return encode_matrix(stream, params, scaler, layers, weights, model)


def write_stream(encoded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the encoded rows to Parquet, each input file exactly once."""
    return (
        encoded.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

"""Streams: parsing is a map and works on them as it is; the ring of last sizes is state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.helpers import RING, endpoint_key

PAGES = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 16) -> DataFrame:
    """Pages from a folder of Parquet files as they arrive; use it with ``sources.html``
    and ``operators`` like any other table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ring_stream(downloads: DataFrame, size: int = RING) -> DataFrame:
    """(endpoint, download_id, size_hint, total_bytes): for each response of a stream the
    size its endpoint's last ``size`` responses predict, else the announced length, the
    expected size, or 0; the response is then recorded. State: the ring of each endpoint.
    Within a micro-batch responses are taken in order of received_at and download_id;
    a null size is not recorded."""
    cols = downloads.select(endpoint_key().alias("endpoint"), "download_id", "received_at", F.col("content_length").cast("bigint"), F.col("expected_size").cast("bigint"), F.col("total_bytes").cast("bigint"))

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["received_at", "download_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            known = [v for v in (r.content_length, r.expected_size) if pd.notna(v)]
            hint = int(sum(ring) / len(ring)) if ring else int(known[0]) if known else 0
            out.append((key[0], r.download_id, hint, None if pd.isna(r.total_bytes) else int(r.total_bytes)))
            if pd.notna(r.total_bytes):
                ring = [*ring, int(r.total_bytes)][-size:]
        state.update((ring,))
        yield pd.DataFrame(out, columns=["endpoint", "download_id", "size_hint", "total_bytes"]).astype({"total_bytes": "Int64"})

    return cols.groupBy("endpoint").applyInPandasWithState(step, "endpoint string, download_id bigint, size_hint bigint, total_bytes bigint", "ring array<bigint>", "append", "NoTimeout")

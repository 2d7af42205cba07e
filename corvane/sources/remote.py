"""Asking a service by name, once per drug, spread over few partitions. The caller brings the function that asks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.sources.files import TRANSIENT

RESULT = "ddinter_id string, http_status int, properties string, error string"


def lookup_path(name: Column | str) -> Column:
    """The name as it stands in a path."""
    return F.replace(F.url_encode(F.col(name) if isinstance(name, str) else name), F.lit("+"), F.lit("%20"))


def fetch(drugs: DataFrame, ask: Callable[[str], tuple[int, list[dict]]], partitions: int = 4, spacing: float = 0.22, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(ddinter_id, http_status, properties as JSON, error) of drugs (ddinter_id, ddinter_name).

    ask gives a status and the hits. 404 is an empty result; passing failures are asked again after 1, 2, 4 ... seconds, at most
    `retries` times, then kept as they are; other errors are recorded. Each partition starts a request every
    `spacing` seconds at most. A null name isn't asked: its status is 404.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for drug, name in zip(pdf["ddinter_id"], pdf["ddinter_name"]):
                status, hits, error = 404, [], None
                for attempt in range(retries + 1 if name is not None else 0):
                    try:
                        status, hits, error = *ask(name), None
                    except Exception as e:  # noqa: BLE001
                        status, hits, error = 0, [], str(e)[:500]
                    if status not in TRANSIENT or attempt == retries:
                        break
                    sleep(2.0**attempt)
                rows.append((drug, int(status), json.dumps(hits if status == 200 else [], sort_keys=True), error))
                sleep(spacing)
            yield pd.DataFrame(rows, columns=["ddinter_id", "http_status", "properties", "error"])

    return drugs.select("ddinter_id", "ddinter_name").repartition(partitions).mapInPandas(run, RESULT)

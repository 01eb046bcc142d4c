"""Writers of reports, metrics and data sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line for each report, in as many files as there are partitions."""
    reports.write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, digits: int = 4, mode: str = "errorifexists") -> None:
    """A table of metrics as JSON, floating-point numbers rounded."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*rounded).coalesce(1).write.mode(mode).json(path)


def write_samples(samples: DataFrame, path: str, comment: str = "", mode: str = "errorifexists") -> None:
    """An evaluation set as {"_comment", "samples"}: each file of the folder is one such object, so that a large set needs
    no single writer; ``read_eval_set`` reads the folder back."""
    head = json.dumps(comment)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            if len(b):
                lines = b["value"].tolist()
                lines[0] = (f'{{"_comment": {head}, "samples": [\n' if first else ",") + lines[0]
                first = False
                yield pd.DataFrame({"value": [lines[0], *("," + x for x in lines[1:])]})
        if not first:
            yield pd.DataFrame({"value": ["]}"]})

    rows = samples.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(run, "value string")
    rows.write.mode(mode).option("compression", "none").text(path)

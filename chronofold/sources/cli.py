"""Command line: series in a text file to features in a CSV folder.

    python -m chronofold.sources.cli IN [--out OUT] [--with-header --column-id ID --column-sort TIME --column-kind KIND --column-value VALUE] [--settings minimal]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from chronofold.functions import settings
from chronofold.plans.extract import extract_features
from chronofold.sources import readers

SETTINGS = {"minimal": settings.MinimalFCParameters, "efficient": settings.EfficientFCParameters, "comprehensive": settings.ComprehensiveFCParameters}


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description="Extract features from series in a text file.")
    parser.add_argument("input")
    parser.add_argument("--out")
    parser.add_argument("--with-header", action="store_true")
    for name in ("id", "sort", "kind", "value"):
        parser.add_argument(f"--column-{name}")
    parser.add_argument("--settings", choices=sorted(SETTINGS), default="comprehensive")
    x = parser.parse_args(args)
    given = {k: v for k, v in (("column_id", x.column_id), ("column_sort", x.column_sort), ("column_kind", x.column_kind), ("column_value", x.column_value)) if v}
    if given and not x.with_header:
        raise AttributeError("columns can only be named if the file has a header")
    spark = SparkSession.builder.getOrCreate()
    if x.with_header:
        series = readers.read_with_header(spark, x.input, tuple(v for k, v in given.items() if k in ("column_id", "column_kind")) or ("id",))
        given.setdefault("column_id", "id")
    else:
        series, given = readers.read_headerless(spark, x.input), {"column_id": "id", "column_sort": "time", "column_value": "value"}
    out = x.out or x.input + ".features.csv"
    readers.write_features(extract_features(series, SETTINGS[x.settings](), **given), out)
    return out


if __name__ == "__main__":
    main()

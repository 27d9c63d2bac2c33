"""spark-submit entry: converts files to a format.

    spark-submit docframe/cli.py --in GLOB --out DIR --to markdown [--from html] [--stream CHECKPOINT]

Writes Parquet with path, output and error; a failure of one file does not stop the others.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docframe.functions.formats import FORMATS, format_of_name
from docframe.operators.convert import convert
from docframe.sources.packages import read_files
from docframe.streaming.ingest import convert_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--to", required=True, choices=sorted(FORMATS))
    p.add_argument("--from", dest="declared", help="skip detection: the files have this format")
    p.add_argument("--stream", metavar="CHECKPOINT", help="convert the files that have come since the last run with this checkpoint")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    own = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("docframe").getOrCreate()
    if own.stream:
        convert_stream(spark, own.source, own.to, own.out, own.stream).awaitTermination()
        return
    files = read_files(spark, own.source)
    if own.declared:
        files = files.withColumn("format", format_of_name(F.lit(own.declared)))
    convert(files, own.to, id_col="path").write.mode("overwrite").parquet(own.out)


if __name__ == "__main__":
    main()

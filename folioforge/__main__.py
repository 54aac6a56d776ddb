"""python -m folioforge FOLDER OUT [DPI]: the tables of the documents below a folder as Parquet, and with DPI their pages as pixels."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.shipping import ship
from .sources import documents


def main(folder: str, out: str, dpi: str | None = None) -> None:
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    ship(spark)
    files = documents.binary_files(spark, folder)
    documents.parsed(files).write.mode("overwrite").parquet(f"{out}/documents")
    made = spark.read.parquet(f"{out}/documents")
    for name, table in {"labels": documents.labels(made), "contents": documents.table_of_contents(made), "links": documents.public_links(made), "soak": documents.soak(files), "draw_ops": documents.draw_ops(files), "chars": documents.chars(files)}.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    if dpi is not None:
        documents.with_png(documents.rendered_pages(files, float(dpi))).drop("pixels").write.mode("overwrite").parquet(f"{out}/pages")


if __name__ == "__main__":
    main(*sys.argv[1:])

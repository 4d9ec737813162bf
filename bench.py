"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The files are made first, and their making is timed by itself; the queries then read them.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from leafmill.plans import queries

HEADLINE = [
    "pages_and_chars", "page_count", "page_range_text", "doc_text_concat", "last_pages_text", "split_pages", "merge_page_order", "text_operators", "objects_by_type", "reachable_objects",
    "flate_roundtrip", "charset_convert", "wrap_lines", "render_cells", "pdf_escape", "active_font", "xref_offsets", "xref_subsections", "xref_newest_wins", "used_resources", "bitmap_pack",
]


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["page_count"](spark, folder.rsplit("/", 1)[0] + "/sf0.001").count()  # starts the workers
    made, took = tempfile.mkdtemp(prefix="leafmill-bench-"), {}
    try:
        start = time.perf_counter()
        for options in ({}, {"packed": True}, {"compress": False}):
            queries.keep_files(spark, folder, made, **options)
        create = round(time.perf_counter() - start, 3)
        for name in HEADLINE:
            start = time.perf_counter()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        totals = queries.QUERIES["pages_and_chars"](spark, folder).selectExpr("sum(n_pages) p", "sum(n_chars) c").first()
    finally:
        shutil.rmtree(made, ignore_errors=True)
    s = took["pages_and_chars"]
    rates = {"pages_per_s": round(totals.p / s), "chars_per_s": round(totals.c / s), "chars_per_s_core": round(totals.c / s / int(cpus))}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "create_files_sec": create, **rates}))


if __name__ == "__main__":
    main()

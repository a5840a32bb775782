"""Time the ordered operators as one service gets denser: python scaling.py [copies ...]

The samples are the given events, each repeated ``copies`` times a few microseconds
apart, a third of all rows moved to one service. The time range stays the same, so frames
grow with the copies.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from failwatch.operators import classify, preprocess, trends, windows
from failwatch.session import local_session
from failwatch.storage import materialize
from registry import adapter


def dense_samples(spark, sf_dir: str, copies: int):
    rows = adapter.with_mask_template(adapter.samples(spark, sf_dir)).where(F.col("seq") < adapter.COPY_SEQ)
    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return many.withColumns(
        {
            "ts_us": F.col("ts_us") + F.col("_copy") * 7,
            "seq": F.col("seq") * copies + F.col("_copy"),
            "service_name": F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("service_name")),
            "hybrid_label": F.col("ground_truth_label"),
            "detection_layer": F.lit("normal"),
        }
    ).drop("_copy")


def main(copies: list[int]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df) -> float:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 2)

    for n in [1, *copies]:
        rows = materialize(dense_samples(spark, sf_dir, n), "dense")
        frames = materialize(windows.sliding_windows(rows), "frames")
        hot = rows.where("service_name = 'hot'").count()
        print(
            json.dumps(
                {
                    "rows": rows.count(),
                    "hot_service_rows": hot,
                    "mean_frame_rows": round(frames.agg(F.avg("window_rows")).first()[0]),
                    "forward_fill_sec": timed(preprocess.fill_metrics(rows)),
                    "gc_jump_sec": timed(classify.gc_jump(rows)),
                    "window_features_sec": timed(windows.sliding_windows(rows)),
                    "failure_trends_sec": timed(trends.add_failure_trends(frames)),
                }
            ),
            flush=True,
        )
    spark.stop()


if __name__ == "__main__":
    main([int(a) for a in sys.argv[1:]] or [4, 16])

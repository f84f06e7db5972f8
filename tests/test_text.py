"""Texts of prices that odd values make."""

import math

from pyspark.sql import functions as F

from quotelark import catalog
from quotelark.functions.text import book_width


def test_a_price_of_zero_has_a_width(spark, tmp_path):
    texts = ["R1 0.0/0.0; R2 2.0/2.5", "R1 0.0/0.01; R2 2.0/2.5", "R1 3.0/0.0; R2 2.0/2.5", "nothing", None]
    got = [r.w for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(book_width(F.col("t")).alias("w")).collect()]
    assert math.isnan(got[0]) and got[1] == math.inf and abs(got[2] - 0.1) < 1e-12 and got[3:] == [None, None]
    rows = [(1, 0.0, "view"), (2, 0.004, "purchase"), (3, None, "click"), (4, 0.0, "error"), (5, 4.0, None)]
    spark.createDataFrame(rows, "event_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    width = {r.event_id: r.width for r in catalog.QUERIES["p14_p15_p23_text_and_reference"](spark, str(tmp_path)).collect()}
    assert math.isnan(width[1]) and math.isnan(width[2]) and width[3] == 0.1 and width[4] is None and width[5] == 0.1

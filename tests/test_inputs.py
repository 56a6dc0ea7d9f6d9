"""Encodings of text trees, bodies of records, mergeable distinct counts."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import histogram
from spanloom.sources import files


def test_every_file_names_the_decoder_that_took_it(spark, tmp_path):
    for name, data in {
        "a.py": b"x = 1", "bom.txt": b"\xef\xbb\xbfhi", "gb.md": "事件 ok".encode("gb18030"), "latin.txt": "été à la".encode("latin-1"), "bytes.txt": bytes(range(256)),
    }.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.content, r.readable, r.encoding) for r in files.read_text_tree(spark, str(tmp_path), encodings=files.LADDER).collect()}
    assert got == {
        "a.py": ("x = 1", True, "utf-8"), "bom.txt": ("hi", True, "utf-8-sig"), "gb.md": ("事件 ok", True, "gb18030"), "latin.txt": ("été à la", True, "latin-1"),
        "bytes.txt": (bytes(range(256)).decode("latin-1"), True, "latin-1"),
    }
    strict = {r.path: (r.readable, r.encoding) for r in files.read_text_tree(spark, str(tmp_path), encodings=["gb18030"]).collect()}
    assert strict["latin.txt"] == (False, None) and strict["gb.md"] == (True, "gb18030")


def test_sketches_merge_within_their_bound(spark):
    n = 60000
    events = spark.range(3 * n).selectExpr(
        "timestamp_seconds(id * 7) AS ts", f"if(id % 5 = 0, null, concat('u', id % {n})) AS who", "concat('t', id % 9) AS tool", "concat('s', id % 2) AS service"
    )
    stored = histogram.distinct_sketches(events, "1 hour", ["who", "tool"], ["service"])
    for by in (["service"], ["bucket", "service"], []):
        exact = events.withColumn("bucket", F.window("ts", "1 hour")["start"]).groupBy(*by).agg(F.count_distinct("who").alias("n_who"), F.count_distinct("tool").alias("n_tool"))
        both = histogram.distinct_counts(stored, by).join(exact, by) if by else histogram.distinct_counts(stored, by).crossJoin(exact)
        for r in both.collect():
            assert r.tool == r.n_tool and r.who == pytest.approx(r.n_who, rel=histogram.distinct_error(14), abs=0.5)
    nobody = histogram.distinct_counts(histogram.distinct_sketches(events.withColumn("who", F.lit(None).cast("string")), "1 day", ["who"]), [])
    assert nobody.first().who == 0

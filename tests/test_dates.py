"""Written dates: each form the mixed fallback reads, in columns and one by one."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vigilog.functions import dates
from vigilog.sources import ingest


def at(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


FORMS = {
    "6/7/2017 8:59": at(2017, 6, 7, 8, 59),
    "06/07/2017 08:59:01": at(2017, 6, 7, 8, 59, 1),
    "25/12/2017 8:59": at(2017, 12, 25, 8, 59),
    "12/25/2017": at(2017, 12, 25),
    "3-4-24 1:02 PM": at(2024, 3, 4, 13, 2),
    "3/4/70": at(1970, 3, 4),
    "2017-07-06": at(2017, 7, 6),
    "2017.7.6 12:00": at(2017, 7, 6, 12),
    "2017-07-06T08:59:00.123456789Z": at(2017, 7, 6, 8, 59, 0, 123456),
    "2017-07-06 08:59:00,5": at(2017, 7, 6, 8, 59, 0, 500000),
    "2017-07-06 08:59:00 +0200": at(2017, 7, 6, 6, 59),
    "2017-07-06T08:59:00-03:30": at(2017, 7, 6, 12, 29),
    "2017-07-06 08:59 UTC": at(2017, 7, 6, 8, 59),
    "20170706T085901": at(2017, 7, 6, 8, 59, 1),
    "20170706 0859": at(2017, 7, 6, 8, 59),
    "6 Jul 2017 08:59": at(2017, 7, 6, 8, 59),
    "06-July-2017": at(2017, 7, 6),
    "06/Jul/2017:08:59:01 +0000": at(2017, 7, 6, 8, 59, 1),
    "6th July, 2017": at(2017, 7, 6),
    "Jul 6, 2017 8:59:01 am": at(2017, 7, 6, 8, 59, 1),
    "July 6 2017 12:30 a.m.": at(2017, 7, 6, 0, 30),
    "Thu, 06 Jul 2017 08:59:01 GMT": at(2017, 7, 6, 8, 59, 1),
    "Thursday 6 July 2017": at(2017, 7, 6),
    "2017 Jul 06 12pm": at(2017, 7, 6, 12),
    "Thu Jul 06 2017 08:59:01 GMT+0100 (CET)": at(2017, 7, 6, 7, 59, 1),
}
NOT_DATES = ["", "10.0.0.1", "31/31/2017", "2017-02-30", "2017-13-01", "word", "12:30", "Jul 2017", "2017-07-06 25:00", "13:00 pm 2017", "2017-07-06 13:00 pm", "1.2.3.4.5", "2017-07-06x"]


def test_each_form_in_a_column(spark):
    texts = [*FORMS, *NOT_DATES]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r.t: r.us for r in df.select("t", F.unix_micros(dates.parse(F.col("t"))).alias("us")).collect()}
    micros = lambda d: None if d is None else round((d - at(1970, 1, 1)).total_seconds() * 1e6)
    assert found == {t: micros(FORMS.get(t)) for t in texts} | {None: None}


@pytest.mark.parametrize("text", [*FORMS, *NOT_DATES])
def test_each_form_alone(text):
    assert dates.parse_one(text) == FORMS.get(text)


def test_a_column_of_mixed_forms(spark, tmp_path):
    lines = ["2017-07-06 08:59:00", "6/7/2017 9:00", "Jul 8, 2017 1:00 PM", "2017/07/09"]
    (tmp_path / "m.csv").write_text("when;kind\n" + "".join(f"{x};k{i:02d}\n" for i, x in enumerate(lines * 5)))
    df, schema = ingest.load(spark, str(tmp_path / "m.csv"))
    assert schema.primary_timestamp == "when" and next(c for c in schema.columns if c.name == "when").format == ingest.MIXED
    assert {r[0] for r in df.selectExpr("date_format(when, 'yyyy-MM-dd HH:mm')").collect()} == {"2017-07-06 08:59", "2017-06-07 09:00", "2017-07-08 13:00", "2017-07-09 00:00"}


def test_a_single_form_without_seconds(spark, tmp_path):
    (tmp_path / "n.csv").write_text("when;kind\n" + "".join(f"6/{d}/2017 8:5{d % 10};k\n" for d in range(1, 29)))
    df, schema = ingest.load(spark, str(tmp_path / "n.csv"))
    assert schema.primary_timestamp == "when" and df.filter("month(when) = 6").count() == 28

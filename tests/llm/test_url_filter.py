import datetime as dt

from lumenqa.llm import url_filter
from lumenqa.llm.entry import ORACLE_SQL, op3_temporal_url_filter
from tests.compare import assert_same, duck

D = dt.date


def test_query_equals_duckdb(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(op3_temporal_url_filter(spark, folder), duck(folder), ORACLE_SQL["op3_temporal_url_filter"])


def judge(spark, captures, entries):
    c = spark.createDataFrame([(*r, "n") for r in captures], "page_id long, url string, fetch_date date, verdict string")
    e = spark.createDataFrame(entries, "entry_id int, pattern string, action string, entry_date date")
    return sorted(((str(r.page_id), r.verdict, r.pattern) for r in url_filter.filter_urls(c, e).collect()), key=str)


def test_entries_hold_from_their_date_to_the_next(spark):
    entries = [(1, "bad.com", "block", D(2024, 1, 10)), (2, "bad.com", "remove", D(2024, 2, 1)), (3, "bad.com/ok", "allow", D(2024, 1, 15)), (4, "ads.bad.com", "block", D(2024, 1, 1)),
               (5, "ads.bad.com", "allow", D(2024, 1, 1)), (6, None, "block", D(2024, 1, 1)), (7, "x.org", "block", None)]
    captures = [(1, "http://bad.com/a", D(2024, 1, 9)), (2, "http://bad.com/a", D(2024, 1, 10)), (3, "http://www.BAD.com./a", D(2024, 1, 31)), (4, "http://bad.com/a", D(2024, 2, 1)),
                (5, "https://u@bad.com:80/ok/deep?q", D(2024, 1, 20)), (6, "http://ads.bad.com", D(2024, 1, 12)), (7, None, D(2024, 1, 12)), (8, "nonsense", D(2024, 1, 12)),
                (9, "http://bad.com", None), (2, "http://bad.com/a", D(2024, 1, 10)), (10, "http://x.org", D(2024, 5, 1))]
    assert judge(spark, captures, entries) == sorted([
        ("1", "none", None), ("2", "block", "bad.com"), ("2", "block", "bad.com"), ("3", "block", "bad.com"), ("4", "none", None), ("5", "allow", "bad.com/ok"),
        ("6", "allow", "ads.bad.com"), ("7", "none", None), ("8", "none", None), ("9", "none", None), ("10", "none", None),
    ], key=str)


def test_empty_tables(spark):
    assert judge(spark, [(1, "http://a.b/c", D(2024, 1, 1))], []) == [("1", "none", None)]
    assert judge(spark, [], [(1, "a.b", "block", D(2024, 1, 1))]) == []


def test_every_path_segment_is_asked_for(spark):
    deep = "a.com/" + "/".join("bcdefgh")
    entries = [(1, "a.com/b", "block", D(2024, 1, 1)), (2, "a.com/b/c/d", "allow", D(2024, 1, 1)), (3, deep, "block", D(2024, 1, 1))]
    captures = [(1, "http://a.com/b/c", D(2024, 1, 2)), (2, "http://a.com/b/c/d/x?q", D(2024, 1, 2)), (3, f"http://{deep}/i", D(2024, 1, 2)), (4, "http://a.com", D(2024, 1, 2))]
    assert judge(spark, captures, entries) == [("1", "block", "a.com/b"), ("2", "allow", "a.com/b/c/d"), ("3", "block", deep), ("4", "none", None)]


def test_null_page_ids_are_rows_like_any_other(spark):
    captures = [(None, "http://a.b/c", D(2024, 1, 2)), (None, "http://a.b/c", D(2024, 1, 2)), (None, None, None)]
    assert judge(spark, captures, [(1, "a.b", "block", D(2024, 1, 1))]) == [("None", "block", "a.b"), ("None", "block", "a.b"), ("None", "none", None)]

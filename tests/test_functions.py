from pyspark.sql import functions as F

from strata.functions import dates, paths, text
from strata.sources.python_code import subwords


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_subwords(spark):
    cases = {"fetch_with_proxyURL": ["fetch", "with", "proxy", "url"], "HTTPServer": ["http", "server"], "proxyURL2": ["proxy", "url2"], "self.the_a 42 x1": ["x1"], "": [], "größenÄnderung": ["größen", "änderung"]}
    for t, want in cases.items():
        assert one(spark, t, text.subwords) == want
    for t in ("fetch_with_proxyURL", "HTTPServer", "proxyURL2", "ABcDe"):
        assert one(spark, t, text.subwords) == subwords(t)
    assert one(spark, None, text.subwords) is None


def test_ticket(spark):
    cases = {"fix ABC-12": "ABC-12", "x#7 ABC-12": "#7", "aABC-12": None, "ABC-12x": None, "ABC-": None, "# 7": None, "XABC-1": "XABC-1"}
    for t, want in cases.items():
        assert one(spark, t, text.first_ticket) == want


def test_paths(spark):
    assert one(spark, ".\\a//b.py  ", paths.plain_path) == "a/b.py"
    assert one(spark, "   ", paths.plain_path) is None
    for p, want in {"a/tests/x.py": True, "conftest.py": True, "a/test_x.py": True, "a/x_test.py": True, "a/contest.py": False, "attests/x.py": False}.items():
        assert one(spark, p, paths.is_test_path) is want
    for p, want in {"a/poetry.lock": True, "package-lock.json": True, "x_pb2.py": True, "a.min.js": True, "a/vendor/b.py": True, "vendored/b.py": False}.items():
        assert one(spark, p, paths.is_noise_path) is want
    assert one(spark, "a/b/__init__.py", paths.module_suffixes) == ["a.b", "b"]
    assert one(spark, "x.py", paths.dir_of) == "."
    assert one(spark, "a/b/c/x.py", lambda c: paths.dir_key(c, 2)) == "a/b"


def test_dates(spark):
    day = 86400
    rows = [(181 * day, "dead"), (180 * day, "flat")]
    for age, want in rows:
        assert spark.range(1).select(dates.classify(F.lit(10**9), F.lit(10**9 - 400 * day), F.lit(10**9 - age)).alias("c")).first()["c"] == want
    for age, want in [(90 * day, "growing"), (91 * day, "flat")]:
        assert spark.range(1).select(dates.classify(F.lit(10**9), F.lit(10**9 - age), F.lit(10**9)).alias("c")).first()["c"] == want
    assert spark.range(1).select(dates.fmt_date(F.lit(1700000000)).alias("d")).first()["d"] == "2023-11-14"


def test_lines(spark):
    for t, want in {"": 0, "a": 1, "a\n": 1, "a\nb": 2}.items():
        assert one(spark, t, text.line_count) == want
    assert one(spark, "a🐛", text.utf16_length) == 3
    assert one(spark, "a=1&f=x%2Fy+z&f=2", lambda c: text.query_param(c, "f")) == "x/y z"
    assert one(spark, "  a \n\t b ", text.collapse_ws) == "a b"

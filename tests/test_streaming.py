from strata.config import Config
from strata.streaming.watch import watch

CODE = "def f{n}(rows):\n    out = []\n    for r in rows:\n        out.append(r + {n})\n    return out\n"


def test_only_new_files_are_scanned(spark, tmp_path):
    src, table, mark = tmp_path / "src", str(tmp_path / "symbols"), str(tmp_path / "mark")
    src.mkdir()
    for n in range(2):
        (src / f"m{n}.py").write_text(CODE.format(n=n))
        watch(spark, str(src), table, mark, Config(min_nodes=5)).awaitTermination()
    rows = spark.read.parquet(table).select("qname", "batch").collect()
    assert sorted(r["qname"] for r in rows) == ["f0", "f1"] and len({r["batch"] for r in rows}) == 2

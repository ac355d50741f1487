"""Line dedup against its SQL, on texts with blank lines, trailing newlines, carriage returns and repeated rows."""

import duckdb

from veritrace.llm import line_dedup
from veritrace.llm.line_dedup import Shard, build_shard, index_lines
from veritrace.llm.queries import ORACLES

COLUMNS = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def against_sql(spark, rows, tmp_path, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 long, gone string, r1 string")
    df.write.parquet(str(tmp_path / "d"))
    got = line_dedup.report(df, **options).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op10_line_dedup']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    return got


def test_blank_lines_switch_nothing_off(spark, tmp_path):
    rows = [(i, f"Common\n\nuniq {i}\n") for i in range(12)] + [(50, None), (51, ""), (52, "common \r\nX\r\n"), (53, "\n\n"), (None, "COMMON\n\ntail"), (None, "COMMON\n\ntail"), (54, "\n".join(f"l{i}\ncommon" for i in range(3000)))]
    got = against_sql(spark, [(*r, 7, "x", "y") for r in rows], tmp_path)
    assert sum(r["n_dropped"] for r in got if r["doc_id"] is not None and r["doc_id"] < 12) == 12
    assert {r["doc_id"]: r["n_dropped"] for r in got}[54] == 3000


def test_many_shards(spark, tmp_path):
    against_sql(spark, [(i, f"a{i % 7}\nb{i % 3}\nc{i}\n \n", 7, "x", "y") for i in range(60)], tmp_path, shard_keys=5)


def test_every_distinct_key_is_indexed(spark):
    docs = spark.createDataFrame([(i, f"once {i}\ntwice {i // 2}") for i in range(40)], "doc_id long, text string")
    lines = line_dedup.hashed_lines(docs)
    folder, shards = index_lines(lines, 25)
    rows = lines.groupBy("h1", "h2").count().toPandas()
    assert len(rows) == 60 and shards == 3
    for s in range(shards):
        own = rows[rows["h1"] % shards == s]
        assert (Shard(folder, s).counted(own["h1"].to_numpy(), own["h2"].to_numpy()) == own["count"].to_numpy()).all()


def test_keys_of_one_first_hash(tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pd.DataFrame({"h1": [5, 5, 6], "h2": [1, 2, 3], "n": [10, 20, 30]})
    (tmp_path / "shard=0").mkdir()
    pq.write_table(pa.Table.from_pandas(build_shard((0,), rows)), tmp_path / "shard=0" / "x.parquet")
    assert Shard(f"file://{tmp_path}", 0).counted(rows["h1"].to_numpy(), rows["h2"].to_numpy()).tolist() == [10, 20, 30]

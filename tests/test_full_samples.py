import duckdb

import __spark_entry__ as entry


def test_alpha_over_white_of_full_samples_equals_its_sql(spark, tmp_path):
    """Vectors past the upper end give samples of 255, whose scaled form is 256 and fits no byte."""
    rows = [(k, 1, [(0.9, -0.9, 0.1, 0.5)[(i * (k + 1) + i // 32) % 4] for i in range(64)]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(entry.oracle_sql()["alpha_over_white"]).fetchall()}
    got = {tuple(r) for r in entry.queries()["alpha_over_white"](spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got == want

import duckdb

import corpus_pipeline as cp
from lexigauge.llm.oracles import mixing_sql
from tests_llm_brute import contaminated, groups

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    numbers = [name for name, _ in cp.STAGES]
    assert len(numbers) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in cp.STAGES[:2]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    kept = docs.toPandas()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    first = groups(zip(kept.doc_id, kept.text))
    kept = kept[[first[i] == i for i in kept.doc_id]]
    kept = kept[[not contaminated(t, bench.text) for t in kept.text]]
    con = duckdb.connect()
    con.register("given", kept)
    want = con.execute(f"SELECT * FROM ({mixing_sql('given')}) WHERE taken > 0").fetchall()
    got = [tuple(r) for r in cp.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got

"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lexigauge.operators import lsa  # noqa: E402
from lexigauge.operators import matrix as mx  # noqa: E402
from lexigauge.plans import catalog  # noqa: E402

HEADLINE = (
    "corpus_scan tokenize term_doc_count term_doc_zeroone term_doc_tfidf term_doc_tfidf_stop "
    "document_frequency vocab_index lead_vs_candidates rank_candidates multi_model_rank "
    "evaluate_models spearman kendall_p order_preservation lsa_randomized"
).split()
SVD_K = 100


def svd(spark, sf):
    """Rank-100 decomposition of the count matrix, from texts to singular values."""
    source = lsa.term_rows(mx.fit_matrix(catalog._corpus(spark, sf)), "count", 2)
    found = lsa.randomized_svd(source, SVD_K)
    return spark.createDataFrame([(float(s),) for s in found.sigma], "sigma double")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: catalog.QUERIES[name] for name in HEADLINE}
    runs[f"svd_count_k{SVD_K}"] = svd
    # start the JVM's code paths and the Python workers before timing
    catalog.rank_candidates(spark, sf.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for name, run in runs.items():
        start = time.time()
        run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()

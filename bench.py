"""Time the headline queries; prints one JSON line.

Rates are given beside the times, since a Spark job carries a fixed scheduling
cost that a resident single-process lookup does not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themeloom import checks  # noqa: E402
from themeloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Query, and the table whose rows it works through.
HEADLINE = {
    "t2_similar_to_id": "embeddings",
    "t1_topk": "embeddings",
    "t1_topk_rounds": "embeddings",
    "t6_approx_topk": "embeddings",
    "t2_similar_to": "embeddings",
    "t3_topk_keywords": "embeddings",
    "t7_score_pairs": "lineitem",
    "m4a_assign": "embeddings",
    "m4_kmeans": "embeddings",
    "m5_label_themes": "embeddings",
    "m5_analyze_themes": "embeddings",
    "w1_representatives": "embeddings",
    "a6_doc_freq": "documents",
    "a7_keyword_idf": "documents",
    "m1_embed_documents": "documents",
    "p7_html_text": "pages",
    "p13_validate_summaries": "documents",
    "p14_flag_statements": "conversations",
    "p4_parse_quotes": "part",
    "p5_extract_concepts": "part",
    "p9_flatten_actions": "orders",
    "j3_merge_drafts": "part",
    "j8_drop_contained_concepts": "part",
    "j9_upsert_newer": "events",
    "j10_insert_absent": "events",
    "a11_change_report": "events",
    "a1_invert_membership": "lineitem",
}


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = checks.queries()
    chosen = sys.argv[1:] or list(HEADLINE)
    # The first job pays for starting workers and loading classes.
    queries["m4a_assign"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    rows = {
        t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())
    }
    times, rates = {}, {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        times[name] = round(took, 3)
        if name in HEADLINE:
            rates[name] = round(rows[HEADLINE[name]] / took)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

Each query starts from the source tables: nothing computed for another one is reused.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taxalign.catalog import registry
from taxalign.session import local_session
from taxalign.staging import drop_staged

HEADLINES = {
    "clean": "clean_checklist", "parse_names": "parse_names", "tree": "levels", "subset": "subset_by_id",
    "exemplars": "exemplars_star", "exemplars_homonym": "exemplars_homonym", "blocks_compare": "compare_concepts",
    "estimates": "estimates", "merged_tree": "merged_tree", "alignment": "alignment", "components": "connected_components",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["rank_numbers"](spark, sf_dir).count()  # start the JVM's threads
    seconds = {}
    for label, name in HEADLINES.items():
        registry.forget()
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.time() - start, 3)
        print(label, seconds[label], file=sys.stderr, flush=True)
    drop_staged(spark)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Times every registered query and prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. The mapped input tables
and the fitted state are built first and reported as ``setup``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyweave.plans import catalog  # noqa: E402
from tallyweave.plans.workbench import workbench  # noqa: E402
from tallyweave.session import build_session  # noqa: E402
from tallyweave.state import discard  # noqa: E402


def drain(df) -> None:
    """Run the whole plan without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = set(sys.argv[1:])
    spark = build_session(
        f"local[{cpus}]",
        int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        **{"spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    started = time.perf_counter()
    workbench(spark, folder).prepare()
    setup = time.perf_counter() - started

    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, query in catalog.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.perf_counter()
        try:
            drain(query(spark, folder))
        except Exception as error:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = str(error).splitlines()[0][:200]
            continue
        seconds[name] = round(time.perf_counter() - started, 3)
    discard(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup": round(setup, 3),
                "failed": failed,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

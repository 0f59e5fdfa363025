"""Run each query and its SQL on one scale factor and compare all rows.

    python tools/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relaygauge.checks.compare import differences  # noqa: E402
from relaygauge.checks.queries import QUERIES  # noqa: E402
from relaygauge.session import local_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    agreed = 0
    for name in names:
        started = time.time()
        try:
            rows, difference = differences(spark, name, folder)
        except Exception as error:  # report and go on with the next query
            rows, difference = 0, f"failed: {str(error)[:1500]}"
        agreed += difference is None
        print(f"{name}: {difference or 'ok'}, {rows} rows ({time.time() - started:.1f} s)", flush=True)
    print(f"{agreed} of {len(names)} agree")


if __name__ == "__main__":
    main()

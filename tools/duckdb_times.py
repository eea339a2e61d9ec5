"""Seconds that DuckDB takes for the SQL of the bench's queries, one JSON line.

usage: python tools/duckdb_times.py [folder] [threads]
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import HEADLINE  # noqa: E402
from oracles import ORACLES  # noqa: E402
from tools.check_oracles import connect  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = connect(folder)
    con.execute(f"SET threads = {int(sys.argv[2]) if len(sys.argv) > 2 else 8}")
    times = {}
    for name in HEADLINE:
        if name in ORACLES:
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLES[name]}")
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"value": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    main()

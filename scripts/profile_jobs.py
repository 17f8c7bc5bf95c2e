"""Spark jobs and wall seconds per registered query (job groups + status tracker).

usage: python scripts/profile_jobs.py [sf_dir] [name-substring ...]
Prints (jobs, seconds, name) sorted by job count; AQE query stages count as jobs.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mediashelf.plans.registry import load_all  # noqa: E402
from mediashelf.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = build_session(shuffle_partitions=16)
    sc = spark.sparkContext
    out = []
    for name, q in load_all().items():
        if pats and not any(p in name for p in pats):
            continue
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        out.append((len(sc.statusTracker().getJobIdsForGroup(name)), round(time.perf_counter() - t0, 2), name))
    for row in sorted(out, reverse=True):
        print(row)
    print("total jobs", sum(r[0] for r in out))


if __name__ == "__main__":
    main()

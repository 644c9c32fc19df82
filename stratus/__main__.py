"""Job entry point: ``python -m stratus <command>`` (or via spark-submit).

    ingest  --raw CSV --out DIR [--rejected DIR] [--strict]
    batch   JOB|all --obs DIR (--out DIR [--format parquet] |
            --jdbc-url URL [--jdbc-table T] [--jdbc-prop k=v ...]) [--scale N]
            [--order-by COLUMN[:desc] ...]
    stream  JOB --source kafka|files [--path DIR] [--option k=v ...]
            [--max-per-trigger N] --checkpoint DIR --sink-format F
            [--sink-path DIR] [--sink-option k=v ...] [--obs DIR] [--city C ...]
            [--available-now | --processing-time "3 seconds"] [--idempotent]
            [--preview N]

Option values written ``@env:NAME`` are read from the environment (keep
passwords out of command lines and code).
"""

from __future__ import annotations

import argparse
import os
import sys

from stratus.operators.ranking import ordered
from stratus.plans import weather as W
from stratus.session import build_session
from stratus.sinks.writers import write_jdbc
from stratus.sources.events import read_event_stream
from stratus.sources.observations import read_observations


def _pairs(items) -> dict:
    out = {}
    for item in items or []:
        k, _, v = item.partition("=")
        out[k] = os.environ[v[5:]] if v.startswith("@env:") else v
    return out


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratus")
    p.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    sub = p.add_subparsers(dest="cmd", required=True)

    i = sub.add_parser("ingest")
    i.add_argument("--raw", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--rejected")
    i.add_argument("--strict", action="store_true", help="set lines aside that do not fit")

    b = sub.add_parser("batch")
    b.add_argument("job", choices=[*W.BATCH_JOBS, "all"])
    b.add_argument("--obs", required=True)
    b.add_argument("--scale", type=int)
    b.add_argument("--out")
    b.add_argument("--format", default="parquet")
    b.add_argument("--jdbc-url")
    b.add_argument("--jdbc-table")
    b.add_argument("--jdbc-prop", action="append")
    b.add_argument("--order-by", action="append", help="sort results that have the column")

    s = sub.add_parser("stream")
    s.add_argument("job", choices=list(W.STREAM_JOBS))
    s.add_argument("--source", choices=["kafka", "files"], required=True)
    s.add_argument("--path")
    s.add_argument("--option", action="append")
    s.add_argument("--max-per-trigger", type=int)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--sink-format", required=True)
    s.add_argument("--sink-path")
    s.add_argument("--sink-option", action="append")
    s.add_argument("--obs")
    s.add_argument("--city", action="append")
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--processing-time")
    s.add_argument("--idempotent", action="store_true")
    s.add_argument("--preview", type=int, default=0, help="rows of each micro-batch to print")
    s.add_argument("--state-store", choices=["rocksdb"])
    s.add_argument("--state-partitions", type=int)
    return p


def main(argv=None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session(a.master, app=f"stratus-{a.cmd}")
    if a.cmd == "ingest":
        counts = W.ingest(spark, a.raw, a.out, a.rejected, a.strict)
        print(counts)
        return 0
    if a.cmd == "batch":
        obs = read_observations(spark, a.obs)
        jobs = list(W.BATCH_JOBS) if a.job == "all" else [a.job]
        if not (a.jdbc_url or a.out):
            raise SystemExit("batch needs --out or --jdbc-url")

        def write(job, df):
            df = ordered(df, a.order_by or ())
            if a.jdbc_url:
                table = a.jdbc_table if a.jdbc_table and len(jobs) == 1 else job
                write_jdbc(df, table, a.jdbc_url, _pairs(a.jdbc_prop))
            else:
                df.write.mode("overwrite").format(a.format).save(os.path.join(a.out, job))
        W.batch_all(obs, write, a.scale, jobs)
        return 0
    events = read_event_stream(spark, a.source, path=a.path, options=_pairs(a.option),
                               max_per_trigger=a.max_per_trigger)
    trigger = ({"availableNow": True} if a.available_now else
               {"processingTime": a.processing_time} if a.processing_time else None)
    obs = read_observations(spark, a.obs) if a.obs else None
    q = W.start_stream_job(spark, a.job, events, checkpoint=a.checkpoint,
                           sink_format=a.sink_format, sink_options=_pairs(a.sink_option),
                           sink_path=a.sink_path, obs=obs, entities=a.city, trigger=trigger,
                           idempotent=a.idempotent, preview=a.preview, state_store=a.state_store,
                           state_partitions=a.state_partitions)
    q.awaitTermination()
    return 0 if q.exception() is None else 1


if __name__ == "__main__":
    sys.exit(main())

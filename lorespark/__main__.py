"""Jobs on the command line: python -m lorespark --help."""

from __future__ import annotations

import argparse
import json
import sys

from lorespark.session import session, table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorespark")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, about in (("list", "names of all queries"), ("run", "run a query and write or show it"), ("generate", "write invented tables"), ("ingest", "stream events into a store"), ("eval", "compare retrieval systems"), ("codecs", "recall of vector codecs"), ("serve", "answer messages line by line")):
        job = jobs.add_parser(name, help=about)
        if name not in ("list", "generate"):
            job.add_argument("data", help="a folder of Parquet tables")
        if name == "run":
            job.add_argument("query")
        if name in ("run", "generate", "ingest"):
            job.add_argument("--out")
        if name == "generate":
            job.add_argument("--seed", type=int, default=42)
            job.add_argument("--years", type=int, default=2)
        if name in ("eval", "codecs"):
            job.add_argument("-k", type=int, default=10)
    args = parser.parse_args(argv)

    from lorespark.registry import QUERIES

    if args.job == "list":
        print("\n".join(QUERIES))
        return 0
    spark = session()
    if args.job == "run":
        if args.query not in QUERIES:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        out = QUERIES[args.query](spark, args.data)
        out.write.mode("overwrite").parquet(args.out) if args.out else out.show(20, truncate=100)
    elif args.job == "generate":
        from lorespark.sources.generator import generate

        for name, df in generate(spark, args.seed, args.years).items():
            df.write.mode("overwrite").parquet(f"{args.out or 'generated'}/{name}.parquet")
    elif args.job == "ingest":
        from lorespark.streaming.ingest import ingest, read_events

        out = args.out or "store"
        ingest(read_events(spark, args.data, "event_id long, created_utc_secs long, source string, text string"), out, f"{out}/_checkpoint").awaitTermination()
    elif args.job == "eval":
        from lorespark.plans import evaluate, service

        entries = table(spark, args.data, "entries")
        evaluate.retrieval({"words": service.Lexical(entries)}, table(spark, args.data, "recall_queries"), entries, args.k).show()
    elif args.job == "codecs":
        from lorespark.plans import evaluate

        evaluate.codecs(table(spark, args.data, "embeddings"), args.k).show()
    elif args.job == "serve":
        from lorespark.plans import service

        entries = table(spark, args.data, "entries")
        asked = service.Service(entries, service.Lexical(entries))
        for line in sys.stdin:
            try:
                answer = asked.handle(json.loads(line))
            except json.JSONDecodeError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": service.PARSE, "message": "no JSON"}}
            if answer:
                print(json.dumps(answer), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())

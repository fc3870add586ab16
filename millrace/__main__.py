"""python -m millrace shards IN OUT --tokens N [--val-tokens N] | sft OUT NAME=PATH... | grpo IN OUT | eval IN OUT | inspect IN | query NAME SF_DIR [--out DIR]

Inputs of sft, grpo and eval are Parquet: id, problem, solution, answer; id, problem, answer, source, level (solution); task, completion, gold, level.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from millrace.plans import pipelines, registry
from millrace.session import build_session
from millrace.shipping import ship
from millrace.sources.jsonl import first_file, read_lines


def main() -> None:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    shards = commands.add_parser("shards")
    shards.add_argument("folder")
    shards.add_argument("out")
    shards.add_argument("--tokens", type=float, required=True)
    shards.add_argument("--val-tokens", type=float, default=0)
    shards.add_argument("--subset", action="append")
    sft = commands.add_parser("sft")
    sft.add_argument("out")
    sft.add_argument("source", nargs="+", help="NAME=PATH, in the order of the mix")
    sft.add_argument("--limit", type=int)
    grpo = commands.add_parser("grpo")
    grpo.add_argument("input")
    grpo.add_argument("out")
    grpo.add_argument("--limit", type=int)
    grpo.add_argument("--min-agreement", type=float)
    scores = commands.add_parser("eval")
    scores.add_argument("input")
    scores.add_argument("out")
    scores.add_argument("--fact", action="append", default=[], help="NAME=VALUE, such as model=x or k=4, in the order of the report")
    commands.add_parser("inspect").add_argument("folder")
    query = commands.add_parser("query")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("sf_dir")
    query.add_argument("--out")
    args = parser.parse_args()
    spark = build_session(args.master)
    ship(spark)
    if args.command == "shards":
        found = pipelines.corpus_to_shards(spark, args.folder, args.out, target_tokens=args.tokens, val_tokens=args.val_tokens, subsets=args.subset)
        print(json.dumps(found, indent=2))
    elif args.command == "sft":
        sources = dict(s.split("=", 1) for s in args.source)
        rows = pipelines.sft_to_jsonl({name: spark.read.parquet(path) for name, path in sources.items()}, args.out, args.limit).collect()
        total = sum(r["n"] for r in rows)
        for r in rows:
            print(f"{r['source']}: {r['n']} records, {100 * r['n'] / total:.1f} %")
    elif args.command == "grpo":
        for name, found in sorted(pipelines.grpo_to_jsonl(spark.read.parquet(args.input), args.out, args.limit, args.min_agreement).items()):
            print(f"{name}: {found['n']} problems" + (f", {100 * found['agreement']:.1f} % of solutions agree" if "agreement" in found else ""))
    elif args.command == "eval":
        facts = dict(f.split("=", 1) for f in args.fact)
        rows = pipelines.evaluate(spark.read.parquet(args.input), facts=facts).orderBy("task").collect()
        Path(args.out).write_text(json.dumps({r["task"]: json.loads(r["report"]) for r in rows}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        for r in rows:
            print(f"{r['task']}: {r['correct']} of {r['n']}, {100 * r['accuracy']:.1f} %")
    elif args.command == "inspect":
        print(json.dumps(pipelines.inspect({args.folder: lambda: first_file(read_lines(spark, args.folder))}), indent=2, ensure_ascii=False))
    else:
        df = registry.queries()[args.name](spark, args.sf_dir)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(50, truncate=60)


if __name__ == "__main__":
    main()

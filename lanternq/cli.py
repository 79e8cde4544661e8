"""Command line: python -m lanternq.cli ingest|ask|serve|eval|capabilities. ask ends with 2 when it is refused."""

from __future__ import annotations

import argparse
import json
import textwrap

from lanternq import __version__
from lanternq.functions.udfs import capabilities
from lanternq.operators import evaluation
from lanternq.plans.engine import PRESETS, Config, Engine, compare
from lanternq.session import local_session
from lanternq.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternq")
    p.add_argument("--version", action="version", version=f"lanternq {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ask", "serve", "eval", "capabilities"):
        s = sub.add_parser(name)
        if name == "capabilities":
            continue
        s.add_argument("--corpus", nargs="+", default=[])
        s.add_argument("--index")
        s.add_argument("--chunker", default="structure")
        s.add_argument("--mode", default="hybrid", choices=("hybrid", "dense", "sparse"))
        s.add_argument("--reranker", default="feature")
        s.add_argument("--embedder", default="hashing")
        s.add_argument("--dim", type=int, default=256)
        s.add_argument("--max-tokens", type=int, help="budget of a chunk")
        s.add_argument("-k", type=int, default=5)
        s.add_argument("--json", nargs="?", const="-", metavar="FILE", help="JSON instead of text, to a file if one is named")
        if name == "ask":
            s.add_argument("question")
            s.add_argument("--session")
            s.add_argument("--show-retrieval", action="store_true")
            s.add_argument("--min-score", type=float, help="leave out retrieved chunks of a lower match quality")
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=8080)
            s.add_argument("--no-ingest", action="store_true")
        if name in ("eval", "serve"):
            s.add_argument("--goldset")
        if name == "eval":
            s.add_argument("--compare", action="store_true")
            s.add_argument("--failures", action="store_true", help="list the questions that went wrong")
    return p


def render(answer: dict, width: int = 78) -> str:
    """K4: an answer as text: body, sources by marker, and one line of status."""
    lines = textwrap.wrap(answer["answer"], width)
    for c in sorted({c["marker"]: c for c in answer["citations"] or []}.values(), key=lambda c: c["marker"]):
        lines.append(f"  [{c['marker']}] {c['label']} ({c['source']})")
    status = f"refused: {answer['refusal_reason']}" if answer["refused"] else f"confidence {answer['confidence']:.2f}, groundedness {answer['groundedness']:.2f}"
    for r in answer.get("retrieved") or []:
        lines.append(f"  {r['rank']}. {r['label']} ({r['source']}), score {r['score']:.3f}, match {r['match_quality'] or 0:.2f}")
    return "\n".join([*lines, f"({status}, {answer['latency_ms']:.0f} ms)"])


def put(value, where: str) -> None:
    """JSON to standard output (-) or a file."""
    text = json.dumps(value, default=str)
    if where == "-":
        print(text)
    else:
        with open(where, "w", encoding="utf-8") as out:
            out.write(text + "\n")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "capabilities":
        print(json.dumps(capabilities(), indent=2))
        return 0
    spark = local_session()
    options = {"max_tokens": args.max_tokens} if args.max_tokens else {}
    config = Config("cli", args.chunker, options, args.embedder, args.dim, args.mode, reranker=args.reranker, top_k=args.k)
    if args.command == "eval" and args.compare:
        reports = [r.asDict() for r in compare(spark, files.read_files(spark, args.corpus), files.read_goldset(spark, args.goldset), PRESETS).collect()]
        put(reports, args.json) if args.json else print(evaluation.rendered(reports))
        return 0
    engine = Engine.load(spark, args.index, config) if args.index and args.command != "ingest" else Engine(spark, config)
    stats = engine.ingest(args.corpus) if args.corpus else {}
    if args.command == "ingest":
        if args.index:
            engine.save(args.index)
        print(json.dumps(stats))
    elif args.command == "ask":
        answer = engine.ask(args.question, args.session)
        if args.show_retrieval:
            found = engine.retrieve(spark.createDataFrame([("q", answer["rewritten_question"])], "query_id string, text string")).orderBy("rank")
            rows = [r.asDict() for r in found.select("rank", "chunk_id", "label", "source", "score", "match_quality").collect()]
            answer["retrieved"] = [r for r in rows if args.min_score is None or (r["match_quality"] or 0) >= args.min_score]
        put(answer, args.json) if args.json else print(render(answer))
        return 2 if answer["refused"] else 0
    elif args.command == "eval":
        rows = engine.evaluate(files.read_goldset(spark, args.goldset))
        report = evaluation.report(rows).first().asDict()
        failed = [r["qid"] for r in evaluation.failures(rows).select("qid").orderBy("qid").collect()] if args.failures else None
        put(report | ({} if failed is None else {"failures": failed}), args.json) if args.json else print(evaluation.rendered([report]), *([] if failed is None else [f"failed: {', '.join(failed) or 'none'}"]), sep="\n")
    else:
        from lanternq.server import serve

        serve(engine, args.host, args.port, goldset=args.goldset, allow_ingest=not args.no_ingest).serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

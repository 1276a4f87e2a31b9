"""Command line: project, concepts, explain, verify, routing."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .facade import Atlas, payload
from .functions import routing
from .functions.embedders import get_embedder
from .operators import generators, scoring
from .sources import sidecars


def parse_weights(pairs: list[str] | None) -> dict[str, float] | None:
    """METRIC=VALUE overrides."""
    out = {}
    for pair in pairs or ():
        name, mark, value = pair.partition("=")
        if not mark or name.strip() not in scoring.WEIGHTS:
            raise SystemExit(f"--weight takes METRIC=VALUE with a metric of {', '.join(sorted(scoring.WEIGHTS))}, not {pair!r}")
        try:
            out[name.strip()] = float(value)
        except ValueError:
            raise SystemExit(f"--weight takes a number, not {value!r}") from None
    return out or None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="conspectus", description="Concept spaces of documents, and texts projected into them.")
    commands = top.add_subparsers(dest="command")
    build = argparse.ArgumentParser(add_help=False)
    build.add_argument("--model", "-m", action="append", help="embedding model, repeatable (hash)")
    build.add_argument("--concept-source", "-s", action="append", choices=sorted(generators.GENERATORS), help="candidate generator, repeatable (all)")
    build.add_argument("--max-concepts", type=int, default=100)
    build.add_argument("--diversity", type=float, default=0.95)
    build.add_argument("--min-score", type=float, default=0.0)
    build.add_argument("--theta", type=float, default=0.5)
    build.add_argument("--weight", action="append", metavar="METRIC=VALUE")
    for name, text in (("project", "project a document's objects and write a sidecar"), ("concepts", "print the concepts"), ("explain", "print the best concepts for a text")):
        c = commands.add_parser(name, help=text, parents=[build])
        c.add_argument("input")
        c.add_argument("--top", "-k", type=int, default={"project": 10, "concepts": 0, "explain": 5}[name])
        if name == "project":
            c.add_argument("--output", "-o")
            c.add_argument("--types", nargs="*")
            c.add_argument("--store-embeddings", action="store_true")
            c.add_argument("--dry-run", action="store_true")
        else:
            c.add_argument("--json", action="store_true", dest="as_json")
        if name == "concepts":
            c.add_argument("--metrics", action="store_true")
        if name == "explain":
            c.add_argument("--text", "-t", required=True)
    commands.add_parser("verify", help="recompute a sidecar's hash").add_argument("sidecar")
    commands.add_parser("routing", help="print which model a type goes to")
    return top


def _atlases(spark, args) -> dict[str, Atlas]:
    how = {"sources": tuple(args.concept_source) if args.concept_source else None, "max_concepts": args.max_concepts, "diversity": args.diversity, "min_score": args.min_score, "theta": args.theta, "weights": parse_weights(args.weight)}
    return {m: Atlas.load(spark, args.input, True, embedder=get_embedder(m), **how) for m in dict.fromkeys(args.model or ["hash"])}


def _project(spark, args) -> int:
    made = payload(_atlases(spark, args), args.input, args.top, args.types, args.store_embeddings)
    target = sidecars.sidecar_path(args.input, args.output)
    facts = {"projections": len(made["projections"]), "skipped": len(made["skipped"]), "content_hash": made["content_hash"]}
    if not args.dry_run:
        sidecars.write_sidecar(made, target)
    print(json.dumps({"would_write" if args.dry_run else "wrote": str(target), **facts}))
    return 0


def _concepts(spark, args) -> int:
    atlas = next(iter(_atlases(spark, args).values()))
    rows = atlas.space.concepts.orderBy("position")
    rows = (rows.limit(args.top) if args.top else rows).collect()  # of one document
    if args.as_json:
        print(json.dumps([{k: v for k, v in r.asDict(recursive=True).items() if k not in ("vector", "doc_id")} for r in rows]))
        return 0
    for i, r in enumerate(rows, 1):
        print(f"{i:4d}. {r['score']:.3f}  {r['name']}   [{r['source']}]")
        if args.metrics:
            print("        " + "  ".join(f"{k}={v:.2f}" for k, v in sorted(r["metrics"].items())))
    return 0


def _explain(spark, args) -> int:
    from pyspark.sql import functions as F

    atlas = next(iter(_atlases(spark, args).values()))
    one = atlas.corpus.blocks.select("doc_id").distinct().withColumns({"text_id": F.lit(0), "text": F.lit(args.text)})
    hits = atlas.explain_text(one, args.top).orderBy("rank").collect()
    if args.as_json:
        print(json.dumps({"text": args.text, "model": atlas.embedder.name, "concepts": [{k: h[k] for k in ("concept_id", "name", "similarity", "rank")} for h in hits]}))
    else:
        for h in hits:
            print(f"  {h['rank']:2d}. {h['similarity']:+.4f}  {h['name']}")
    return 0


def _verify(spark, args) -> int:
    matches, stored, computed = sidecars.verify_sidecar(args.sidecar)
    print(f"{'OK' if matches else 'FAIL'} {args.sidecar}\n  stored:   {stored}\n  computed: {computed}")
    return 0 if matches else 1


def _routing(spark, args) -> int:
    for model, kinds in routing.MODELS.items():
        for kind in sorted(kinds):
            print(f"{kind:<16} -> {model}{'  (dormant)' if kind in routing.DORMANT else ''}")
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs a command; 0 if it went well, 1 if not, 2 if its file is missing. Without a command, options that hold a text mean explain."""
    argv = list(sys.argv[1:] if argv is None else argv)
    run = {"project": _project, "concepts": _concepts, "explain": _explain, "verify": _verify, "routing": _routing}
    if not run.keys() & set(argv) and {"--text", "-t"} & set(argv):
        argv = ["explain", *argv]
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    at = getattr(args, "input", None) or getattr(args, "sidecar", None)
    if at and not Path(at).exists():
        print(f"conspectus: no such file: {at}", file=sys.stderr)
        return 2
    if spark is None and args.command in ("project", "concepts", "explain"):
        from .session import session

        spark = session()
    try:
        return run[args.command](spark, args)
    except (ValueError, RuntimeError, OSError) as error:
        print(f"conspectus: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())

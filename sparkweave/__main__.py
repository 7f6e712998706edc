"""python -m sparkweave COMMAND ...: results as JSON lines. Exit 0: well; 2: a check failed; 1: an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkweave", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    built = {"run": "manifest, gates and review", "build": "manifest to read model"}
    for name, text in {**built, "query": "a view preset", "sql": "a read-model preset", "rank": "entities by rank", "rank-sources": "sources by risk", "trace": "neighbours of what matches", "resolve": "verdicts on targets", "pack": "a context pack", "doctor": "health checks", "index": "facet rows", "search": "text search"}.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("folder", help="read model")
        if name in built:
            p.add_argument("--manifest", required=True)
            p.add_argument("--root", required=True)
            p.add_argument("--head", default="")
        p.add_argument("--preset", default="claim-lineage")
        p.add_argument("--match", default="")
        p.add_argument("--task", default="")
        p.add_argument("--target", action="append", default=[])
        p.add_argument("--limit", type=int, default=50)
        p.add_argument("--depth", type=int, default=2)
        p.add_argument("--token-budget", type=int, default=4000)
        p.add_argument("--with-identity", action="store_true")
    scan = sub.add_parser("scan", help="a code tree to payloads and a manifest that `build` takes")
    scan.add_argument("root")
    scan.add_argument("output")
    scan.add_argument("--max-files", type=int, default=5000)
    scan.add_argument("--hashes", action="store_true")
    for name, text in {"discover": "what a repository has to start from", "route": "the next action for a request", "init-profile": "a run profile for a request", "onboard": "a profile, and its request's route"}.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("root")
        p.add_argument("--handoff", default="")
        p.add_argument("--output-dir", default="")
        p.add_argument("--task", default="")
        p.add_argument("--target", action="append", default=[])
        p.add_argument("--manifest", action="append", default=[])
        p.add_argument("--profile", default=".sparkweave/profile.json")
    for name, text in {"validate-profile": "checks of a run profile", "verify-handoff": "a handoff against its artifacts", "release": "the prompt of a verified handoff", "validate": "an artifact against its contract"}.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("--root", default=".")
    sub.add_parser("contracts", help="the contracts of all artifacts")
    p = sub.add_parser("capabilities", help="what this library can do, or who has a function")
    p.add_argument("--function", action="append", default=[])
    for p in {id(p): p for p in sub.choices.values()}.values():
        p.add_argument("--targets-file", default="", help="a JSON list, or a line a target")
        p.add_argument("--markdown", action="store_true", help="a table for people, not JSON lines")
        p.add_argument("--save", default="", help="write the result to this file too")
    return out


def shown(rows: list[dict], title: str, a: argparse.Namespace) -> None:
    """Rows as JSON lines or Markdown: printed, and saved if a file is named."""
    from sparkweave.sources.scan import markdown

    text = markdown(title, {"rows": len(rows)}, {"Rows": rows}) if a.markdown else "".join(json.dumps(r, sort_keys=True, default=str) + "\n" for r in rows)
    print(text, end="")
    if a.save:
        with open(a.save, "w", encoding="utf-8") as f:
            f.write(text)


def planned(a: argparse.Namespace) -> tuple[list[dict], bool] | None:
    """(rows, whether all is well) of the commands that need no Spark; None for the others."""
    from sparkweave.operators import audits, capabilities, contracts
    from sparkweave.plans import discovery, entrypoint, profile
    from sparkweave.sources import scan

    def released() -> dict:
        handoff = scan.strict_json(a.input)
        return entrypoint.ready(handoff, discovery.measure(a.root, discovery.artifacts(handoff)))

    def prompt() -> dict:
        verdict = released()
        if not verdict["ok"]:
            return verdict | {"prompt_text": ""}
        with open(os.path.join(a.root, verdict["prompt_source"]), encoding="utf-8") as f:
            return verdict | {"prompt_text": f.read()}

    def checked() -> dict:
        artifact, schemas = scan.strict_json(a.input), contracts.registry()
        kind = next((k for k in schemas if contracts.version(k) == artifact.get("schema_version")), "")
        errors = [i for i, passed in audits.contract_checks(schemas[kind], artifact) if not passed] if kind else ["artifact_kind_inferred"]
        return {"ok": not errors, "artifact_kind": kind, "errors": errors}

    asked = {
        "discover": lambda: discovery.discover(a.root, a.handoff), "route": lambda: discovery.route(a.root, a.task, a.target, a.handoff, a.output_dir), "validate-profile": lambda: profile.load(a.input), "verify-handoff": released, "release": prompt, "validate": checked,
        "init-profile": lambda: profile.init(a.root, a.profile, a.task, a.target, a.manifest, a.handoff, output_dir=a.output_dir), "onboard": lambda: profile.onboard(a.root, a.profile, a.task, targets=a.target, manifests=a.manifest, handoff=a.handoff, output_dir=a.output_dir),
    }
    if a.command == "contracts":
        return [{"artifact_kind": k} | s for k, s in contracts.registry().items()], True
    if a.command == "capabilities":
        return (capabilities.ownership(a.function) if a.function else [{"capability_id": i, "capability_name": t, "commands": c, "contracts": k} for i, (t, c, k, _) in capabilities.CAPABILITIES.items()]), True
    if a.command not in asked:
        return None
    row = asked[a.command]()
    return [row], row["ok"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from sparkweave.operators import assess, graph, pack, presets, resolve
    from sparkweave.plans import workflow
    from sparkweave.sources import read_model, scan

    a = parser().parse_args(argv)
    if a.targets_file and hasattr(a, "target"):
        a.target = [*a.target, *scan.targets(a.targets_file)]
    done = planned(a)
    if done:
        shown(done[0], a.command, a)
        return 0 if done[1] else 2
    spark = spark or SparkSession.builder.appName("sparkweave").getOrCreate()
    if a.command == "scan":
        shown([scan.scan(spark, a.root, a.output, a.max_files, hashes=a.hashes)["summary"]], "Scan", a)
        return 0
    if a.command in ("build", "run"):
        with open(a.manifest, encoding="utf-8") as f:
            manifest = json.load(f)
        steps = workflow.run(spark, manifest, a.root, a.task, a.target, head=a.head, folder=a.folder) if a.command == "run" else workflow.bootstrap(spark, manifest, a.root, a.head, a.folder)[1]
        for s in steps:
            print(json.dumps(vars(s), sort_keys=True))
        return 0 if all(s.ok for s in steps) else 2
    g, index = read_model.read(spark, a.folder)
    public = (lambda df: df) if a.with_identity else presets.public
    rows: DataFrame = {
        "query": lambda: public(presets.VIEW_PRESETS[a.preset](g, a.limit)), "sql": lambda: public(presets.sql_preset(spark, g, a.preset, a.limit, a.match)), "search": lambda: public(presets.sql_preset(spark, g, "search", a.limit, a.match)),
        "rank": lambda: graph.entity_rank(g, a.limit), "rank-sources": lambda: graph.source_rank(g, a.limit), "trace": lambda: graph.trace(g, presets.has(presets.entity_text(), a.match), a.depth, a.limit),
        "resolve": lambda: resolve.adjudicate(spark, g, a.target, a.limit).orderBy(F.desc("priority_score"), "target"), "pack": lambda: pack.pack(g, a.task, a.token_budget, a.limit), "doctor": lambda: assess.doctor(g), "index": lambda: graph.unified_index(g, a.match, a.limit),
    }[a.command]()
    shown([json.loads(line) for line in rows.toJSON().toLocalIterator()], a.command, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())

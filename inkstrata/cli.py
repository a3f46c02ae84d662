"""Commands for spark-submit: ``python -m inkstrata.cli COMMAND ...``.

Models and readers are named as ``module:builder``; a builder is called without
arguments in each worker.
"""

from __future__ import annotations

import argparse
import importlib
import json
import shutil
import sys
from pathlib import Path

from inkstrata.errors import InkstrataError
from inkstrata.operators import schema as sc


def builder(name: str | None):
    """The function that ``module:name`` stands for."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    if not attribute:
        raise InkstrataError(f"{name} is not of the form module:builder")
    return getattr(importlib.import_module(module), attribute)


def schema(name: str) -> sc.Schema:
    """A template by name, a YAML file, or ``module:name`` of a schema."""
    if name.endswith((".yaml", ".yml")):
        return sc.schema_of(Path(name).read_text(encoding="utf-8"))
    return builder(name) if ":" in name else sc.Registry().load(name)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("inkstrata").getOrCreate()


def put(text: str, output: str | None) -> None:
    if output:
        Path(output).write_text(text, encoding="utf-8")
        print(f"written to {output}")
    else:
        print(text)


def cmd_extract(a) -> int:
    from inkstrata import engine

    result = engine.extract(session(), a.file_path, schema(a.schema), builder(a.model), builder(a.reader))
    put(json.dumps(result, default=str, ensure_ascii=False, indent=2), a.output)
    return 0


def cmd_extract_folder(a) -> int:
    from inkstrata import engine

    docs = engine.documents_of(session(), a.folder_path, a.pattern, builder(a.reader))
    made = engine.process_batch(docs, engine.Engine(schema(a.schema), builder(a.model)))
    r = made["report"].first()
    print(f"total {r['total']}, succeeded {r['succeeded']}, failed {r['failed']}, to review {r['needs_review']}, mean confidence {r['confidence']:.2f}")
    for x in made["reasons"].toLocalIterator():
        print(f"  {x['count']} x {x['reason']}")
    if a.output:
        made["documents"].write.mode("overwrite").option("header", True).csv(a.output)
        print(f"written to {a.output}")
    return 0


def cmd_run(a) -> int:
    from inkstrata import engine

    results, fields = engine.run_workflow(session(), Path(a.config_path), a.file_path, builder(a.model), builder(a.reader))
    rows = [r.asDict(recursive=True) for r in results.limit(1000).toLocalIterator()]
    own = [r.asDict(recursive=True) for r in fields.orderBy("doc_id", "pos").limit(10_000).toLocalIterator()]
    put(json.dumps({"results": rows, "fields": own}, default=str, ensure_ascii=False, indent=2), a.output)
    return 0


def cmd_route(a) -> int:
    import yaml

    from inkstrata import engine
    from inkstrata.operators.routing import Router, routed_csv

    routes = Path(a.routes_path)

    def flow(ref):
        own = engine.Engine.from_config(routes.parent / ref if isinstance(ref, str) else ref, builder(a.model))
        return lambda docs: own.run(docs)[0]

    router = Router.from_config(yaml.safe_load(routes.read_text(encoding="utf-8")), flow)
    docs = engine.documents_of(session(), a.input_path, a.pattern, builder(a.reader))
    routed = router.route(docs, builder(a.classifier or a.model))
    for r in routed.groupBy("workflow").count().orderBy("workflow").toLocalIterator():
        print(f"{r['workflow'] or 'unclassified'}: {r['count']}")
    if a.output:
        routed_csv(routed).write.mode("overwrite").option("header", True).csv(a.output)
        print(f"written to {a.output}")
    return 0


def cmd_screenshot(a) -> int:
    from inkstrata.tools import Tools

    pages = [int(p) for p in a.pages.split(",")] if a.pages else None
    print(Tools(None, screens=builder(a.screens)).screenshot_document(a.file_path, a.output, pages))
    return 0


def cmd_templates_list(a) -> int:
    for t in sc.Registry().list():
        print(f"{t['name']:<20} {t['version']:<8} {t['source']:<8} {t['description']}")
    return 0


def cmd_templates_show(a) -> int:
    import yaml

    print(yaml.safe_dump(sc.Registry().raw(a.name), sort_keys=False))
    return 0


def cmd_templates_init(a) -> int:
    src = sc.BUILTIN / f"{a.name}.yaml"
    if not src.is_file():
        raise InkstrataError(f"there is no built-in template {a.name!r}")
    to = Path(a.dir or "inkstrata_templates") / src.name
    to.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(src, to)
    print(f"copied to {to}")
    return 0


def cmd_serve(a) -> int:
    from inkstrata.serve import serve

    serve(session(), a.config_path, builder(a.model), a.host, a.port)
    return 0


def cmd_dockerize(a) -> int:
    from inkstrata.serve import deployment

    for path in deployment(a.config_path, a.output, a.model, a.port):
        print(path)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstrata")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, fn, *places, **options):
        c = sub.add_parser(name)
        c.set_defaults(run=fn)
        for x in places:
            c.add_argument(x)
        for key, default in options.items():
            c.add_argument(f"--{key.replace('_', '-')}", default=default, required=default is ..., type=int if isinstance(default, int) else str)
        return c

    both = {"model": ..., "reader": None, "output": None}
    command("extract", cmd_extract, "file_path", schema=..., **both)
    command("extract-folder", cmd_extract_folder, "folder_path", schema=..., pattern="*", **both)
    command("run", cmd_run, "config_path", "file_path", **both)
    command("route", cmd_route, "routes_path", "input_path", pattern="*", classifier=None, **both)
    command("screenshot", cmd_screenshot, "file_path", output=..., pages=None, screens=...)
    command("serve", cmd_serve, "config_path", model=..., host="127.0.0.1", port=8000)
    command("dockerize", cmd_dockerize, "config_path", model=..., output="deploy", port=8000)
    t = sub.add_parser("templates").add_subparsers(dest="templates", required=True)
    t.add_parser("list").set_defaults(run=cmd_templates_list)
    show = t.add_parser("show")
    show.add_argument("name")
    show.set_defaults(run=cmd_templates_show)
    init = t.add_parser("init")
    init.add_argument("name")
    init.add_argument("--dir")
    init.set_defaults(run=cmd_templates_init)
    return p


def main(argv: list[str] | None = None) -> int:
    """Runs a command; an error of the engine or a missing file is a message and the code 1."""
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (InkstrataError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

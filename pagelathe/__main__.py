"""python -m pagelathe parse FILE [--json] [--pages 1,3-5] | classify FILE | protocols | cache stat|clear FOLDER | doctor"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from importlib.util import find_spec
from pathlib import Path

from pagelathe import api


def pages_of(spec: str) -> set[int]:
    """Pages of "1,3-5" as ranges that are not written out; ValueError for anything else."""
    out: set[int] = set()
    for part in spec.split(","):
        low, _, high = part.replace(" ", "").partition("-")
        if not (low.isascii() and low.isdigit() and (not high or (high.isascii() and high.isdigit()))) or int(low) < 1 or int(high or low) < int(low) or int(high or low) - int(low) > 100_000:
            raise ValueError(f"no page range: {part!r}")
        out.update(range(int(low), int(high or low) + 1))
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagelathe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "classify"):
        s = sub.add_parser(name)
        s.add_argument("file")
        if name == "parse":
            s.add_argument("--json", action="store_true")
            s.add_argument("--headers-footers", action="store_true")
            s.add_argument("--pages", default="")
    sub.add_parser("protocols")
    sub.add_parser("doctor")
    s = sub.add_parser("cache")
    s.add_argument("action", choices=["stat", "clear"])
    s.add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "doctor":
        found = {name: find_spec(name) is not None for name in ("pyspark", "pyarrow", "pandas", "numpy")}
        print(json.dumps(found))
        return api.EXIT_CODES["ok" if all(found.values()) else "dependency"]
    if a.command == "cache":
        folder = Path(a.folder)
        files = [f for f in folder.rglob("*") if f.is_file()] if folder.is_dir() else []
        print(json.dumps({"entries": len(files), "total_bytes": sum(f.stat().st_size for f in files)}))
        if a.action == "clear" and folder.is_dir():
            shutil.rmtree(folder)
        return api.EXIT_CODES["ok"]
    if a.command == "protocols":
        print("\n".join(sorted(api.PROTOCOLS)))
        return api.EXIT_CODES["ok"]
    try:
        data = Path(a.file).read_bytes()
        if a.command == "classify":
            print(json.dumps({"path": a.file, "format": api.detect(data, a.file), "bytes": len(data)}))
        else:
            document = api.parse_bytes(data, a.file, api.ParseOptions(headers_footers=a.headers_footers))
            if a.pages:
                wanted = pages_of(a.pages)
                document.units[:] = [u for k, u in enumerate(document.units, 1) if k in wanted]
            print(api.document_json(document) if a.json else api.document_markdown(document), end="")
            if document.warnings:
                print(json.dumps({"warnings": document.warnings}), file=sys.stderr)
                return api.EXIT_CODES["partial"]
    except ImportError as e:
        print(json.dumps({"error": "dependency", "detail": str(e)}), file=sys.stderr)
        return api.EXIT_CODES["dependency"]
    except ValueError as e:
        print(json.dumps({"error": "pages", "detail": str(e)}), file=sys.stderr)
        return api.EXIT_CODES["input"]
    except (api.DocumentError, OSError) as e:
        code = e.code if isinstance(e, api.DocumentError) else "missing"
        print(json.dumps({"error": code, "detail": str(e)}), file=sys.stderr)
        return api.EXIT_CODES["input"]
    return api.EXIT_CODES["ok"]


if __name__ == "__main__":
    sys.exit(main())

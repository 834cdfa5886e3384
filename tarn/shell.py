"""A small shell: ``python -m tarn.shell [database file]``. Statements end with a semicolon; ``quit`` leaves."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from .errors import EngineError
from .render import row_text
from .session import Engine


def run(engine: Engine, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """Read statements until ``quit`` or the end of input; rows are fetched one at a time."""
    held = ""
    while True:
        try:
            line = read("  ...> " if held else "tarn> ")
        except EOFError:
            return
        if not held and line.strip().lower() in ("quit", "exit", ""):
            if line.strip():
                return
            continue
        held += line + "\n"
        if not line.rstrip().endswith(";"):
            continue
        began, query, held = time.monotonic(), held, ""
        try:
            for row in engine.execute(query).toLocalIterator():
                write(row_text(row))
            write(f"Time elapsed: {time.monotonic() - began:.2f} s")
        except EngineError as error:
            write(str(error))


def main() -> None:
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("shell").getOrCreate())
    if len(sys.argv) > 1:
        engine.open_file(sys.argv[1])
    run(engine)


if __name__ == "__main__":
    main()

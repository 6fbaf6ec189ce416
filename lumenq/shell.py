"""A line shell: SQL ended by ``;`` and backslash commands.

    python -m lumenq.shell ROOT
"""

from __future__ import annotations

import csv
import io
import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .functions.scalar import function_list
from .session import Session

HELP = r"""SQL ends with a semicolon. Commands:
  \h, \?                                    this help
  \c FILE                                   create the tables of a catalog file
  \d                                        list tables
  \f                                        list functions
  \a                                        aligned or CSV output
  \l TABLE FILE [SEP] [HEADER]              append a delimited file (, and true unless given)
  \i TABLE COLUMN CLUSTERS KIND             build a clustered or secondary index
  \r FACT | TABLE | COLUMN | TEXT | true    check a fact, with or without context"""

WIDTH, SHOWN = 120, 1000


def cell(value: object) -> str:
    if isinstance(value, list):
        return f"[{value[0]},...]" if value else "[]"
    return "" if value is None else str(value)


def aligned(df: DataFrame, limit: int = SHOWN) -> str:
    """Centred, cut cells in a window of WIDTH characters."""
    width = max(3, WIDTH // max(1, len(df.columns)) - 2)
    found = df.limit(limit + 1).collect()
    rows = [df.columns, *([cell(v) for v in r] for r in found[:limit])]
    lines = ["|".join(v[:width].center(width) for v in r) + "|" for r in rows]
    return "\n".join([*lines, f"({len(rows) - 1} results)" if len(found) <= limit else f"(the first {limit} of more results)"])


def as_csv(df: DataFrame, limit: int = SHOWN) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    found = df.limit(limit + 1).collect()
    writer.writerows([cell(v) for v in r] for r in found[:limit])
    more = f"\n# the first {limit} of more results" if len(found) > limit else ""
    return out.getvalue().rstrip("\n") + more


class Shell:
    def __init__(self, session: Session, llm: Callable[[str], str] | None = None) -> None:
        self.session, self.llm = session, llm
        self.aligned = True
        self.pending = ""

    def handle(self, line: str) -> str:
        """What one input line prints."""
        line = line.strip()
        if not self.pending and line.startswith("\\"):
            try:
                return self._command(line)
            except (EngineError, PySparkException, OSError, ValueError) as e:
                return f"error: {e}"
        self.pending = f"{self.pending} {line}".strip()
        if not self.pending.endswith(";"):
            return ""
        statement, self.pending = self.pending, ""
        began = time.monotonic()
        try:
            out = self.session.sql(statement)
            text = self._plan(out) if out.columns == ["plan"] else aligned(out) if self.aligned else as_csv(out)
        except (EngineError, PySparkException) as e:
            return f"error: {e}"
        return f"{text}\n{(time.monotonic() - began) * 1000:.1f} ms"

    def _plan(self, out: DataFrame) -> str:
        return out.first()["plan"]

    def _command(self, line: str) -> str:
        name, _, rest = line[1:].partition(" ")
        args = rest.split()
        if name in ("h", "?", ""):
            return HELP
        if name == "d":
            return self.session.catalog.text()
        if name == "f":
            return "\n".join(function_list())
        if name == "a":
            self.aligned = not self.aligned
            return "Output aligned" if self.aligned else "Output unaligned"
        if name == "c" and args:
            with open(args[0]) as f:
                self.session.load_catalog(f.read())
            return f"Loaded {args[0]}\n{self.session.catalog.text()}"
        if name == "l" and len(args) >= 2:
            sep = args[2] if len(args) > 2 else ","
            n = self.session.load_delimited(args[0], args[1], sep, len(args) < 4 or args[3] != "false")
            return f"LOAD {n}"
        if name == "i" and len(args) >= 4:
            self.session.create_index(args[0], args[1], int(args[2]), args[3])
            return "INDEX"
        if name == "r" and rest.count("|") == 4:
            fact, table, ret, text, context = (x.strip() for x in rest.split("|"))
            if self.llm is None:
                return aligned(self.session.retrieve(fact, table, ret, text))
            return self.session.fact_check(fact, table, ret, text, self.llm, context == "true")
        return HELP

    def run(self) -> None:
        """Read lines until the end of input; an interrupt drops the line and cancels what runs."""
        while True:
            try:
                text = self.handle(input("> " if not self.pending else "  "))
                if text:
                    print(text)
            except KeyboardInterrupt:
                self.pending = ""
                self.session.spark.sparkContext.cancelAllJobs()
            except EOFError:
                return


if __name__ == "__main__":
    Shell(Session(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "lumenq-data")).run()

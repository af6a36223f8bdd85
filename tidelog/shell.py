"""A line-by-line shell over a node's store: python -m tidelog.shell FOLDER

PUT key value, GET key, DELETE key (or DEL), CONTAINS key, INFO, FLUSH, HELP, EXIT (or QUIT). Fields with spaces are
quoted. Every line is a Spark job or two: it is for looking and for small repairs; data comes in by Node.put()."""

from __future__ import annotations

import shlex
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from .schema import PUT, LogError
from .sources.node import Node

USAGE = {"PUT": ("key", "value"), "GET": ("key",), "DELETE": ("key",), "DEL": ("key",), "CONTAINS": ("key",), "INFO": (), "FLUSH": (), "HELP": (), "EXIT": (), "QUIT": ()}


def answer(node: Node, line: str) -> str | None:
    """The answer to a line; None ends the shell, after a flush."""
    spark = node.spark
    words = shlex.split(line)
    name, args = words[0].upper(), words[1:]
    if name not in USAGE:
        return "ERROR unknown command; type HELP"
    if len(args) != len(USAGE[name]) or args and not args[0]:
        return "ERROR usage: " + " ".join([name, *(f"<{a}>" for a in USAGE[name])])
    key = spark.createDataFrame([(args[0],)], "key string") if args else None
    if name == "PUT":
        row = spark.createDataFrame([(args[0], PUT, args[1], 0)], "key string, type int, value string, day int")
        return f"OK sequence={node.put(row, 'day', ['key'])}"
    if name in ("DELETE", "DEL"):
        return f"OK sequence={node.delete(key)}"
    if name == "GET":
        r = node.get(key).first()
        return f'VALUE "{r["value"]}"' if r["state"] == "FOUND" else "NOT_FOUND"
    if name == "CONTAINS":
        return "TRUE" if node.contains(key).first()["found"] else "FALSE"
    if name == "INFO":
        return "INFO " + " ".join(f"{k}={v}" for k, v in node.info().first().asDict().items())
    if name == "HELP":
        return "; ".join(" ".join([n, *(f"<{a}>" for a in a)]) for n, a in USAGE.items())
    m = node.flush()
    return f"OK flushed_up_to={m.high_water}" if name == "FLUSH" else None


def run(node: Node, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        try:
            said = answer(node, line)
        except (LogError, ValueError) as e:
            said = f"ERROR {e}"
        if said is None:
            break
        yield said
    yield "Closed."


if __name__ == "__main__":
    for said in run(Node(SparkSession.builder.getOrCreate(), sys.argv[1]), sys.stdin):
        print(said, flush=True)

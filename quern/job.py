"""Jobs: an argument dataclass, datasets, and writes that run only when the job has been built."""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from quern import cli
from quern.operators.dataset import Dataset
from quern.session import build_session
from quern.sources.io import checkpoint as write_checkpoint
from quern.sources.job_io import PathSink, PathSource, TableSource, TestSink, TestSource


@dataclass
class Context:
    """What a job's `run` gets: reads are lazy, writes are queued."""

    spark: SparkSession
    queue: list[Callable[[], None]] = field(default_factory=list)
    checkpoints: dict[str, Dataset] = field(default_factory=dict)

    def read(self, source: Any, model: Any, partitioner: Any = None, **values: Any) -> Any:
        return source.dataset(self.spark, model, partitioner, **values)

    def write(self, ds: Dataset, sink: Any, partitioned: bool = False) -> None:
        self.queue.append(lambda: sink.write(ds, partitioned))

    def checkpoint(self, ds: Dataset, base: str | None) -> Dataset:
        """Write and read again; without a folder (in tests) the rows stay as they are."""
        return ds if base is None else write_checkpoint(ds, base)

    def run(self) -> None:
        """Do the queued writes in order."""
        while self.queue:
            self.queue.pop(0)()


class Job:
    """Subclass with `Args` (a dataclass) and `run(context, args)`; `main` is the command line."""

    Args: type

    def run(self, context: Context, args: Any) -> None:
        raise NotImplementedError

    def execute(self, spark: SparkSession, args: Any) -> None:
        context = Context(spark)
        self.run(context, args)
        context.run()

    @classmethod
    def main(cls, argv: list[str] | None = None, master: str | None = None) -> int:
        try:
            args = cli.parse(cls.Args, sys.argv[1:] if argv is None else argv)
        except cli.HelpWanted as wanted:
            print(wanted)
            return 0
        except cli.ArgsError as wrong:
            print(f"{wrong}\n\n{cli.usage(cls.Args)}", file=sys.stderr)
            return 2
        cls().execute(build_session(master), args)
        return 0


def walk(args: Any, wanted: tuple[type, ...]) -> list[tuple[str, Any]]:
    """All sources or sinks in an argument object, with their places."""
    out = []
    for f in dataclasses.fields(args):
        value = getattr(args, f.name)
        if isinstance(value, wanted):
            out.append((f.name, value))
        elif dataclasses.is_dataclass(value):
            out += [(f"{f.name}.{n}", v) for n, v in walk(value, wanted)]
    return out


def sources(args: Any) -> list[tuple[str, Any]]:
    return walk(args, (PathSource, TableSource, TestSource))


def sinks(args: Any) -> list[tuple[str, Any]]:
    return walk(args, (PathSink, TestSink))


def run_job_for_test(job: Job, args: Any, spark: SparkSession) -> dict[str, list]:
    """Run a job on test sources and sinks; a sink that was never written is an error. Gives the rows by sink."""
    job.execute(spark, args)
    silent = [n for n, s in sinks(args) if isinstance(s, TestSink) and s.rows is None]
    if silent:
        raise AssertionError(f"nothing was written to {silent}")
    return {n: s.rows for n, s in sinks(args) if isinstance(s, TestSink)}

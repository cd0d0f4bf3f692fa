"""Command line.

``python -m changeseries cluster CONFIG.json``  entities with more than 50 changes, results written
``python -m changeseries explore CONFIG.json``  keyed by entity and property, nothing written
``python -m changeseries matrix IN OUT``        count matrix of the fixed entities
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from changeseries.operators.matrix import CITIES, TOP_PROPERTIES, complete_case_matrix
from changeseries.plans.job import run
from changeseries.plans.spec import JobSpec
from changeseries.session import session
from changeseries.sinks.lines import write_matrix
from changeseries.sources.changelog import read_change_csv

# Fixed value: a group needs more changes than this to be clustered.
MIN_CHANGES = 50


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="changeseries")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("cluster", "explore"):
        command = commands.add_parser(name)
        command.add_argument("config")
        command.add_argument("--labels", help="CSV of entity and template, for ground truth")
        command.add_argument("--templates", nargs="*", help="labels that count; none given: all of them")
        command.add_argument("--min-changes", type=int, default=MIN_CHANGES, help="groups need more than this")
        command.add_argument("-local", "--local", action="store_true")
    command = commands.add_parser("matrix")
    command.add_argument("input")
    command.add_argument("output")
    command.add_argument("--entities", nargs="+", default=list(CITIES), help="rows of the matrix")
    command.add_argument("--top", type=int, default=TOP_PROPERTIES, help="columns of the matrix")
    command.add_argument("-local", "--local", action="store_true")
    options = parser.parse_args(arguments)

    spark = session(master="local[*]" if options.local else None)
    if options.command == "matrix":
        changes = read_change_csv(spark, options.input, entities=options.entities)
        matrix = complete_case_matrix(changes, options.entities, options.top)
        write_matrix(matrix, options.output, single_file=True)
        return
    extra = {} if options.templates is None else {"label_templates": tuple(options.templates) or None}
    spec = JobSpec.from_json(options.config, label_source=options.labels, **extra)
    if options.command == "cluster":
        result = run(spark, spec, keys=["entity"], group_filter=F.col("n") > options.min_changes)
        print(", ".join(f"{name}: {count}" for name, count in result.metrics.items()))
    else:
        result = run(spark, spec, keys=["entity", "property"], write=False)
        result.members.groupBy("assignedCluster").count().orderBy("assignedCluster").show()


if __name__ == "__main__":
    main()

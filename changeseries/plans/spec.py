"""The job description, as Python values or from JSON."""

from __future__ import annotations

import json
import random
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any

from changeseries.functions.features import find_features
from changeseries.functions.transforms import find_transform
from changeseries.functions.windows import FIXED_UNITS, MONTHS_PER_UNIT
from changeseries.sources.jdbc import Database, Partitioning
from changeseries.sources.labels import TEMPLATES

ALGORITHMS = ("KMeans", "DBAKMeans")
OPTIONS = {
    "before_start": ("clamp", "drop"),
    "after_end": ("error", "drop"),
    "non_finite": ("error", "drop"),
    "missing_time": ("error", "drop"),
}

# Further keys of the JSON form; lists become tuples, null takes a list's limit away.
OPTION_KEYS = {
    "before_start": "beforeStart",
    "after_end": "afterEnd",
    "non_finite": "nonFinite",
    "missing_time": "missingTime",
    "label_templates": "labelTemplates",
    "entities": "entities",
    "properties": "properties",
    "resume": "resume",
}


def _moment(text: str) -> datetime:
    """A moment with any number of fractional digits, whatever Python's own parser takes."""
    head, _, fraction = text.partition(".")
    return datetime.fromisoformat(head) + timedelta(microseconds=int(fraction.ljust(6, "0")[:6] or 0))


@dataclass(frozen=True)
class JobSpec:
    """What to read, how to build the series and how to cluster them.

    Defaults are those of an empty description: weekly counts, no transform, the
    series itself as features, k-means with ten clusters and a random seed.
    ``label_templates`` are the labels that count as ground truth (None: all of them);
    ``entities`` and ``properties`` restrict the log where it is read. With ``resume`` a DBA clustering
    keeps its rounds under the ``config_identifier`` and goes on from them when the job is started again.
    """

    config_identifier: str = "clusters"
    file_source: str | None = None
    database: Database | None = None
    query: str | None = None
    query_prefiltered: bool = False
    partitioning: Partitioning | None = None
    result_directory: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    granularity: int = 7
    unit: str = "Days"
    transformation: tuple[str, ...] = ()
    feature_extraction: str = "raw"
    clustering_alg: str = "KMeans"
    k: int = 10
    max_iter: int = 100
    seed: int = field(default_factory=lambda: random.getrandbits(63))
    add_ground_truth: bool = False
    label_source: str | None = None
    label_templates: tuple[str, ...] | None = TEMPLATES
    entities: tuple[str, ...] | None = None
    properties: tuple[str, ...] | None = None
    missing_time: str = "error"
    before_start: str = "clamp"
    after_end: str = "error"
    non_finite: str = "error"
    resume: bool = False

    def __post_init__(self) -> None:
        if self.unit.strip().upper() not in {*FIXED_UNITS, *MONTHS_PER_UNIT}:
            raise ValueError(f"unknown time unit: {self.unit!r}")
        if self.clustering_alg not in ALGORITHMS:
            raise ValueError(f"unknown clustering algorithm: {self.clustering_alg!r}")
        for name in self.transformation:
            find_transform(name)
        find_features(self.feature_extraction)
        if self.granularity < 1 or self.k < 1:
            raise ValueError("granularity and k must be positive")
        if self.clustering_alg == "KMeans" and self.k < 2:
            raise ValueError("k-means needs at least two clusters")
        if self.max_iter < 0:
            raise ValueError("max_iter must not be negative")
        for name, allowed in OPTIONS.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.query is not None and self.database is None:
            raise ValueError("a query needs a database")
        if self.resume and self.clustering_alg != "DBAKMeans":
            raise ValueError("only DBAKMeans has rounds to resume")
        if self.reads_database and self.query_prefiltered and not (self.entities is None and self.properties is None):
            raise ValueError("a pre-filtered query has no entities and properties to restrict")

    @property
    def reads_database(self) -> bool:
        return self.file_source is None and self.query is not None

    @classmethod
    def from_dict(cls, config: Mapping[str, Any], **extra: Any) -> JobSpec:
        """Description in the JSON form; ``extra`` sets fields that form has no name for.

        ``start`` and ``end`` count only together. A file source wins over a
        database source. A query is taken as already filtered: key columns first,
        the time last.
        """
        algorithm = config["clusteringAlg"]
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown clustering algorithm: {algorithm!r}")
        parameters = config[f"{algorithm} Parameters"]
        values: dict[str, Any] = {
            "config_identifier": config["configIdentifier"],
            "add_ground_truth": config["addGroundTruth"],
            "granularity": config["granularity"],
            "unit": config["unit"],
            "transformation": tuple(config["transformation"]),
            "feature_extraction": config["featureExtraction"],
            "clustering_alg": algorithm,
            "k": parameters["k"],
        }
        for name, key in (("max_iter", "maxIter"), ("seed", "seed")):
            if key in parameters:
                values[name] = parameters[key]
        for name, key in OPTION_KEYS.items():
            if key in config:
                value = config[key]
                values[name] = tuple(value) if isinstance(value, list) else value
        if "start" in config and "end" in config:
            values["start"] = _moment(config["start"])
            values["end"] = _moment(config["end"])
        if "fileSource" in config:
            if "dbSource" in config:
                warnings.warn("both a file and a database source are given; the file is used", stacklevel=2)
            values["file_source"] = config["fileSource"]
            values["result_directory"] = config["resultDirectory"]
        elif "dbSource" in config:
            source = config["dbSource"]
            values["database"] = Database(
                source["url"], source["driver"], source.get("user"), source.get("password")
            )
            values["query"] = source["query"]
            values["query_prefiltered"] = True
            if "partitioning" in source:
                values["partitioning"] = Partitioning(**source["partitioning"])
        return cls(**{**values, **extra})

    @classmethod
    def from_json(cls, path: str | Path, **extra: Any) -> JobSpec:
        return cls.from_dict(json.loads(Path(path).read_text()), **extra)

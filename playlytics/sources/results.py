"""Stored results with an age: computed once, read while they are young enough, then computed again.

Each result is a Parquet folder; a manifest, one small JSON file a result, says where it lies and when it was written. A manifest is
replaced in one step when the new folder is complete, so readers always find a whole result, and the folder before it
stays until the next one, for those who still read it. A result whose files were lost is computed again. ``sweep`` deletes
what is too old, and folders that a failed run left.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from playlytics.sources.storage import delete, exists, list_folder, read_text, write_text


@dataclass
class Results:
    """Results below ``path``, each up to ``max_age`` seconds old; ``clock`` gives the time in seconds."""

    spark: SparkSession
    path: str
    max_age: float
    clock: Callable[[], float] = field(default=time.time)

    def _manifest(self, name: str) -> str:
        return f"{self.path}/manifest/{hashlib.sha256(name.encode()).hexdigest()}.json"

    def entry(self, name: str) -> dict | None:
        """Where the stored result lies and when it was written."""
        place = self._manifest(name)
        return json.loads(read_text(self.spark, place)) if exists(self.spark, place) else None

    def get(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result, or a new one from ``compute`` where there is none, it is too old or its files are gone."""
        entry = self.entry(name)
        if entry and self.clock() - entry["written"] <= self.max_age and exists(self.spark, f"{entry['path']}/_SUCCESS"):
            return self.spark.read.parquet(entry["path"])
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        written = self.clock()  # the age of what it read, not of its last file
        compute().write.parquet(place)
        manifest = {"name": name, "path": place, "written": written, "before": entry["path"] if entry else None}
        write_text(self.spark, self._manifest(name), json.dumps(manifest))
        if entry and entry["before"]:
            delete(self.spark, entry["before"])
        return self.spark.read.parquet(place)

    def forget(self, name: str) -> None:
        entry = self.entry(name)
        if entry:
            self._drop(self._manifest(name), entry)

    def _drop(self, manifest: str, entry: dict) -> None:
        delete(self.spark, manifest)
        for place in filter(None, (entry["path"], entry["before"])):
            delete(self.spark, place)

    def sweep(self) -> list[str]:
        """Delete results that are too old and folders of none; returns the names of those results. Not while one is being computed."""
        gone, kept = [], set()
        for file in list_folder(self.spark, f"{self.path}/manifest"):
            if not file.endswith(".json"):
                continue
            manifest = f"{self.path}/manifest/{file}"
            entry = json.loads(read_text(self.spark, manifest))
            if self.clock() - entry["written"] > self.max_age:
                self._drop(manifest, entry)
                gone.append(entry["name"])
            else:
                kept |= {entry["path"], entry["before"]}
        for folder in list_folder(self.spark, f"{self.path}/data"):
            if f"{self.path}/data/{folder}" not in kept:
                delete(self.spark, f"{self.path}/data/{folder}")
        return sorted(gone)

"""Data sets kept by their content, and what experiments found, by tag.

An entry's frames are written to a folder of their own first; a small manifest beside
them, written last and in one piece, says where they are.  An entry without a
manifest isn't found, so a write that broke leaves nothing but files that clearing
removes.  All paths go through Spark's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import fingerprint

MANIFEST = "manifest.json"


class Folder:
    """Entries below a path: `<path>/<name>/manifest.json` and `<path>/<name>/<unique>/<frame>`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, prefix: str = "") -> list[str]:
        """Of the entries that are whole."""
        found = self.files.globStatus(self.at(f"{self.path}/*/{MANIFEST}"))
        names = [f.getPath().getParent().getName() for f in found or []]
        return sorted(n for n in names if n.startswith(prefix))

    def manifest(self, name: str) -> dict | None:
        place = self.at(f"{self.path}/{name}/{MANIFEST}")
        if not self.files.exists(place):
            return None
        return json.loads(self.spark.read.text(str(place), wholetext=True).first()[0])

    def read(self, name: str) -> tuple[dict[str, DataFrame], dict] | None:
        """The frames of an entry and what was noted with them."""
        known = self.manifest(name)
        if known is None:
            return None
        return {frame: self.spark.read.parquet(f"{self.path}/{name}/{known['data']}/{frame}") for frame in known["frames"]}, known["notes"]

    def write(self, name: str, frames: Mapping[str, DataFrame], notes: Mapping | None = None) -> None:
        """A new entry, or one in place of another; readers see the old one or the new one."""
        before, data = self.manifest(name), uuid.uuid4().hex
        for frame, df in frames.items():
            df.write.parquet(f"{self.path}/{name}/{data}/{frame}")
        draft, place = self.at(f"{self.path}/{name}/{data}/{MANIFEST}"), self.at(f"{self.path}/{name}/{MANIFEST}")
        text = json.dumps({"data": data, "frames": list(frames), "notes": dict(notes or {})}).encode()
        for target in (draft, place):  # the copy beside the data shows to whom these belong
            out = self.files.create(target, True)
            out.write(bytearray(text))
            out.close()
        if before:
            self.files.delete(self.at(f"{self.path}/{name}/{before['data']}"), True)

    def clear(self, prefix: str = "") -> int:
        """Removes entries, broken ones too; says how many whole ones there were."""
        whole = self.names(prefix)
        for entry in self.files.globStatus(self.at(f"{self.path}/*")) or []:
            if entry.getPath().getName().startswith(prefix):
                self.files.delete(entry.getPath(), True)
        return len(whole)


def content_key(df: DataFrame, parameters: Mapping) -> str:
    """A short name for a frame's columns and rows, in any order, and the parameters applied to it."""
    text = json.dumps({"columns": df.dtypes, "rows": fingerprint(df, ""), **parameters}, sort_keys=True, default=str)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def kept_frames(spark: SparkSession, path: str, tag: str, seed: int, content: DataFrame, parameters: Mapping, build: Callable[[], tuple[Mapping[str, DataFrame], Mapping]], force: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """The frames and notes that `build` makes of `content`: those kept under its tag, seed, content and parameters, else built and kept."""
    folder, name = Folder(spark, path), f"split-{tag}-seed{seed}-{content_key(content, parameters)}"
    found = None if force else folder.read(name)
    if found is None:
        folder.write(name, *build())
        found = folder.read(name)
    return found


def clear_kept(spark: SparkSession, path: str, tag: str | None = None) -> int:
    """Removes what is kept of a tag, or of all; says how many entries."""
    return Folder(spark, path).clear("split-" if tag is None else f"split-{tag}-seed")


def save_results(spark: SparkSession, path: str, tag: str, **frames: DataFrame) -> None:
    """One experiment's frames (metrics, contributions, ...); those that it had before go."""
    Folder(spark, path).write(f"results-{tag}", {n: df.drop("tag") for n, df in frames.items()}, {"tag": tag})


def load_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The frames of all experiments, one under another by name, with their tag; columns that one lacks are null."""
    folder, out = Folder(spark, path), {}
    for name in folder.names("results-"):
        frames, notes = folder.read(name)
        for frame, df in frames.items():
            out.setdefault(frame, []).append(df.withColumn("tag", F.lit(notes["tag"])))
    return {frame: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for frame, parts in out.items()}

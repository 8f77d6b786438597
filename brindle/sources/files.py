"""

Spark's file sources leave out names that start with `_` or `.`, which are wanted here. So the driver lists the tree, which is metadata only, and executors
read the bytes; on a cluster the root must be a folder that all of them see.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values
EXTENSIONS = [".py", ".md", ".rst", ".txt", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".sh", ".j2"]
MAX_SIZE = 307_200
SKIPPED_DIRECTORIES = [".venv", "venv", "site-packages", "node_modules", ".git", "__pycache__", "dist", "build", ".pytest_cache", ".cache", ".idea", ".mypy_cache", ".ruff_cache", ".tox", ".nox", "htmlcov"]
VENDORED = ["vendor", "third_party", "thirdparty", "_generated"]
SECRET_PARTS = ["credential", "secret", ".env"]
SECRET_SUFFIXES = [".pem", ".key", ".p12"]

#: Bytes of files that a task hands on at once.
READ_BYTES = 8 << 20
LISTING = "repo string, root string, rel string, name string, size long, reason string, is_dir boolean"


@dataclass(frozen=True)
class Repo:
    name: str
    root: str


def load_corpus(path: str) -> list[Repo]:
    """The repositories that a YAML file lists under `repos`, each with a name and a path; paths that aren't absolute start where the file is. An empty file has none."""
    file = Path(path).resolve()
    with file.open(encoding="utf-8") as text:
        listed = yaml.safe_load(text)
    entries = listed.get("repos") if isinstance(listed, dict) else listed
    if not isinstance(entries, list | None) or not all(isinstance(e, dict) and e.keys() >= {"name", "path"} for e in entries or ()):
        raise ValueError(f"{path} has no list `repos` of entries with `name` and `path`")
    return [Repo(str(e["name"]), os.path.normpath(file.parent / str(e["path"]))) for e in entries or ()]


def file_reason(name: Column, size: Column) -> Column:
    """Why a file is left out, or null."""
    low = F.lower(name)
    # The extension starts at the last dot, if that neither opens nor ends the name.
    suffix = F.regexp_extract(low, r"(?s)\A.+(\.[^.]+)\z", 1)
    secret = F.lit(False)
    for part in SECRET_PARTS:
        secret = secret | low.contains(part)
    for end in SECRET_SUFFIXES:
        secret = secret | low.endswith(end)
    return F.when(secret, "secret_like_name").when(~suffix.isin(EXTENSIONS), "extension_not_included").when(size > MAX_SIZE, "too_large")


def directory_reason(rel: Column) -> Column:
    """Why a directory, given by its path below the root, is pruned, or null. The root's own path is ''."""
    low = F.lower(rel)
    vendored = F.lit(False)
    for part in VENDORED:
        vendored = vendored | low.contains(part)
    return F.when(F.element_at(F.split(low, "/"), -1).isin(SKIPPED_DIRECTORIES), "skip_dir_name").when(vendored, "vendored_or_generated")


def pruned_at(rel_dir: Column) -> Column:
    """The topmost directory on the way to rel_dir that is pruned, or null."""
    parts = F.split(rel_dir, "/")
    upwards = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(rel_dir != "", F.try_element_at(F.filter(upwards, lambda d: (d != "") & directory_reason(d).isNotNull()), F.lit(1)))


def _skips_directory(rel: str) -> str | None:
    low = rel.lower()
    if low.rsplit("/", 1)[-1] in SKIPPED_DIRECTORIES:
        return "skip_dir_name"
    return "vendored_or_generated" if any(v in low for v in VENDORED) else None


def walk(spark: SparkSession, repos: list[Repo]) -> DataFrame:
    """Files and pruned directories of all repositories, with the reasons why they are left out."""
    rows = []
    for repo in repos:
        for top, dirs, names in os.walk(repo.root):
            rel = os.path.relpath(top, repo.root).replace(os.sep, "/")
            rel = "" if rel == "." else rel
            below = lambda n: f"{rel}/{n}" if rel else n
            for d in sorted(dirs):
                if reason := _skips_directory(below(d)):
                    rows.append((repo.name, repo.root, below(d), d, 0, reason, True))
            dirs[:] = sorted(d for d in dirs if not _skips_directory(below(d)))
            for name in sorted(names):
                try:
                    rows.append((repo.name, repo.root, below(name), name, os.stat(os.path.join(top, name)).st_size, None, False))
                except OSError:
                    rows.append((repo.name, repo.root, below(name), name, None, "stat_error", False))
    listing = spark.createDataFrame(rows, LISTING)
    return listing.withColumn("reason", F.coalesce("reason", F.when(~F.col("is_dir"), file_reason(F.col("name"), F.col("size")))))


def skip_summary(listing: DataFrame) -> DataFrame:
    """repo, is_dir, reason and n, the most common first."""
    return listing.filter(F.col("reason").isNotNull()).groupBy("repo", "is_dir", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("repo", "is_dir", F.desc("n"), "reason")


def decode(data: bytes) -> str:
    """UTF-8, with or without a mark, then Windows' Cyrillic, then UTF-8 with replacements."""
    for codec in ("utf-8-sig", "cp1251"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def read_files(listing: DataFrame) -> DataFrame:
    """path (repository and path below it), repo, suffix, size, mtime, sha256 and text of the files that aren't left out; unreadable ones have a null sha256. The hash is
    taken where the bytes are read."""
    schema = pa.schema([("path", pa.string()), ("repo", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                full = os.path.join(entry["root"], entry["rel"])
                row = {"path": f"{entry['repo']}/{entry['rel']}", "repo": entry["repo"], "suffix": Path(entry["rel"]).suffix}
                try:
                    with open(full, "rb") as file:
                        data, known = file.read(), os.fstat(file.fileno())
                    row |= {"size": len(data), "mtime": known.st_mtime, "sha256": hashlib.sha256(data).hexdigest(), "text": decode(data)}
                    held += len(data)
                except OSError:
                    pass
                rows.append(row)
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = listing.filter("reason IS NULL AND NOT is_dir").select("repo", "root", "rel")
    return found.mapInArrow(run, "path string, repo string, suffix string, size long, mtime double, sha256 string, text string")

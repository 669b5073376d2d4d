"""Where a project's inputs are: the manifest or the project itself, the files beside them, and baselines.

Paths are looked up through Spark's file systems, so a project may lie wherever Spark can read. An explicit path goes before
a detected one; a detected one that isn't there is no error, but an explicit one is.
"""

from __future__ import annotations

import io
import subprocess
import tarfile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import attributes
from tributary.plans.bundle import Bundle
from tributary.sources import manifest, project

PROJECT_FILES = ("dbt_project.yml", "dbt_project.yaml")
#: Folders of a project that hold what a manifest is compiled from.
_COMPILED_FROM = r"\.(sql|py|csv|yml|yaml)$"


class Inputs(NamedTuple):
    """Paths of what was found; None for what wasn't."""

    manifest: str | None
    project: str | None
    catalog: str | None
    run_results: str | None
    compiled: str | None


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_file(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where) and store.getFileStatus(where).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def target_folder(manifest_path: str | None, project_dir: str | None) -> str | None:
    """Where artifacts lie: beside the manifest, else the project's ``target``."""
    if manifest_path is not None:
        return manifest_path.rsplit("/", 1)[0] if "/" in manifest_path else "."
    return f"{project_dir.rstrip('/')}/target" if project_dir is not None else None


def discover(
    spark: SparkSession, project_dir: str = ".", manifest_path: str | None = None, source: str | None = None, catalog: str | None = None, run_results: str | None = None, compiled: str | None = None
) -> Inputs:
    """An explicit manifest, else an explicit project (``source``), else ``project_dir``'s own manifest, else the project there."""
    found, folder = manifest_path, None
    if found is None and source is not None:
        folder = source
    elif found is None:
        own = f"{target_folder(None, project_dir)}/manifest.json"
        if is_file(spark, own):
            found = own
        elif any(is_file(spark, f"{project_dir.rstrip('/')}/{f}") for f in PROJECT_FILES):
            folder = project_dir
        else:
            raise FileNotFoundError(f"no data source under {project_dir}: neither target/manifest.json nor {PROJECT_FILES[0]} is there")
    for path in (manifest_path, catalog, run_results):
        if path is not None and not is_file(spark, path):
            raise FileNotFoundError(f"{path} isn't a file")
    target = target_folder(found, folder)
    beside = lambda given, name: given or (f"{target}/{name}" if is_file(spark, f"{target}/{name}") else None)
    tree = compiled or (f"{target}/compiled" if is_folder(spark, f"{target}/compiled") else None)
    return Inputs(found, folder, beside(catalog, "catalog.json"), beside(run_results, "run_results.json"), tree)


def newer_files(spark: SparkSession, manifest_path: str, project_dir: str) -> DataFrame:
    """path of the project's files that were changed after the manifest was written; what lies below ``target`` doesn't count."""
    store, where = _at(spark, manifest_path)
    written_at = store.getFileStatus(where).getModificationTime()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(project_dir).select("path", "modificationTime")
    files = files.where(F.col("path").rlike(_COMPILED_FROM) & ~F.col("path").rlike("/(target|dbt_packages|dbt_internal_packages|[.]git)/"))
    return files.where(F.col("modificationTime") > F.timestamp_millis(F.lit(written_at))).select("path")


def load(spark: SparkSession, inputs: Inputs, project_dir: str | None = None) -> Bundle:
    """The bundle of all inputs. A manifest that was detected, not named, is warned about if project files are newer."""
    if inputs.manifest is not None:
        b = manifest.manifest(spark, inputs.manifest)
    else:
        b = project.load_project(spark, inputs.project)
    notes = list(b.warnings)
    if inputs.manifest is not None and project_dir is not None and is_folder(spark, project_dir):
        n = newer_files(spark, inputs.manifest, project_dir).count()
        if n:
            notes.append(f"{n} project files are newer than {inputs.manifest}")
    if inputs.catalog is not None:
        columns, stats = manifest.catalog(spark, inputs.catalog)
        b = b.with_(catalog_columns=columns, catalog_stats=stats)
    if inputs.run_results is not None:
        b = b.with_(run_results=manifest.run_results(spark, inputs.run_results))
    if inputs.compiled is not None:
        b = manifest.with_compiled(b, inputs.compiled, project_dir or inputs.project)
    return b.with_(warnings=notes)


def _git(folder: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", folder, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {arguments[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def revision_files(spark: SparkSession, project_dir: str, revision: str) -> DataFrame:
    """(path, text) of the project's text files at a revision of the repository that it lies in. Links and paths that leave the
    project are left out."""
    if not revision or revision.startswith("-"):
        raise ValueError(f"invalid revision {revision!r}")
    folder = project_dir.removeprefix("file://")
    commit = _git(folder, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}").decode().strip()
    rows = []
    with tarfile.open(fileobj=io.BytesIO(_git(folder, "archive", "--format=tar", commit)), mode="r:") as tree:
        for entry in tree:
            safe = not entry.name.startswith("/") and ".." not in entry.name.split("/")
            if entry.isfile() and safe and entry.name.endswith(project.TEXT_FILES):
                rows.append((entry.name, tree.extractfile(entry).read().decode("utf-8", "replace")))  # type: ignore[union-attr]
    return spark.createDataFrame(rows, "path string, text string")


def baseline(spark: SparkSession, where: str, project_dir: str = ".", scope: str = "root") -> Bundle:
    """What to compare with: ``git:`` and a revision of ``project_dir``, a manifest, or a folder with a manifest or a project."""
    if where.startswith("git:"):
        b = project.load_files(spark, revision_files(spark, project_dir, where.removeprefix("git:")))
    elif is_file(spark, where):
        b = manifest.manifest(spark, where)
    elif is_folder(spark, where):
        inputs = discover(spark, where)
        b = manifest.manifest(spark, inputs.manifest) if inputs.manifest else project.load_project(spark, inputs.project)
    else:
        raise FileNotFoundError(f"{where} is neither a manifest nor a project folder")
    return attributes.root_scope(b) if scope == "root" else b

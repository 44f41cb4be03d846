"""Folders that are saved as a whole: parts first, a manifest with their digests last.

Every save writes its parts below a version of its own.  It counts from the moment its
manifest, one small file, is there; until then readers see the version before.  Reading
compares the digests of all files of a version with its manifest, so parts of two saves
never meet.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowcascade.session import delete_folder

KEPT_VERSIONS = 2       # the newest and the one before, which a reader may still have open


def write_json(spark: SparkSession, value, path: str) -> None:
    row = spark.createDataFrame([(json.dumps(value),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of every file below a folder, by its path there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("digest")).collect()
    return {r["name"]: r["digest"] for r in rows}


def _manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """Manifests by version, the oldest first."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").text(
            f"{path}/manifests", wholetext=True).collect()
    except PySparkException as e:
        raise RuntimeError(f"incomplete: nothing was saved in {path}") from e
    found = [json.loads(r["value"]) for r in rows]
    return {m["version"]: m for m in sorted(found, key=lambda m: m["version"])}


def save_version(spark: SparkSession, path: str, write: Callable[[str], dict | None]) -> str:
    """Save a new version: ``write`` gets its folder and may return notes for the manifest."""
    path = path.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/versions/{version}"
    notes = write(folder)
    manifest = {"version": version, "files": file_digests(spark, folder), "notes": notes or {}}
    write_json(spark, manifest, f"{path}/manifests/{version}")
    for old in list(_manifests(spark, path))[:-KEPT_VERSIONS]:
        delete_folder(spark, f"{path}/manifests/{old}")
        delete_folder(spark, f"{path}/versions/{old}")
    return version


def open_version(spark: SparkSession, path: str) -> tuple[str, dict]:
    """Folder and notes of the newest saved version, its files compared with the manifest."""
    path = path.rstrip("/")
    manifests = _manifests(spark, path)
    if not manifests:
        raise RuntimeError(f"incomplete: nothing was saved in {path}")
    manifest = list(manifests.values())[-1]
    folder = f"{path}/versions/{manifest['version']}"
    try:
        found = file_digests(spark, folder)
    except PySparkException as e:
        raise RuntimeError(f"incomplete version in {folder}") from e
    if found != manifest["files"]:
        odd = sorted(n for n in found.keys() | manifest["files"].keys()
                     if found.get(n) != manifest["files"].get(n))
        raise RuntimeError(f"{folder} does not fit its manifest: {odd[:5]}")
    return folder, manifest["notes"]

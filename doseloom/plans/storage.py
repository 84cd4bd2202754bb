"""Shared folders, lineage cuts and saved steps."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_ASIDE = ".aside-"
_made: list[list[str]] = []  # folders made inside each open ``scratch``


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it; none is made up."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    return folder.rstrip("/")


def use_local_folder(spark: SparkSession) -> None:
    """For sessions on one machine that name no folder, such as trial runs: take a temporary one.

    On a cluster nothing is taken, and ``shared_folder`` asks for the setting. The folder goes when the driver ends.
    """
    unset = spark.conf.get(CHECKPOINT_SETTING, None) is None and spark.sparkContext.getCheckpointDir() is None
    if unset and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="doseloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    uri = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(uri)
    return uri


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that steps write between them are deleted at the end of the block.

    Frames that read them are no use afterwards: write or collect a query's rows inside.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for uri in made:
            fs, path = _path(spark, uri)
            fs.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _path(spark, uri)
    return fs.exists(path)


def local_path(spark: SparkSession, uri: str) -> str | None:
    """The path below which every machine finds a local or mounted folder; None on other stores."""
    fs, path = _path(spark, uri)
    return fs.makeQualified(path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def empty_folder(spark: SparkSession, uri: str) -> None:
    """A folder with nothing in it; what was there is deleted."""
    fs, path = _path(spark, uri)
    fs.delete(path, True)
    fs.mkdirs(path)


def mark_whole(spark: SparkSession, uri: str) -> None:
    """The empty file by which Spark's writers say that a folder is whole."""
    fs, path = _path(spark, f"{uri.rstrip('/')}/_SUCCESS")
    fs.create(path).close()


def folder_names(spark: SparkSession, uri: str) -> list[str]:
    """Names of the files and folders right below ``uri``."""
    fs, path = _path(spark, uri)
    return [status.getPath().getName() for status in fs.listStatus(path)]


def fingerprint(spark: SparkSession, inputs: Sequence[str] = (), **parameters: Any) -> str:
    """Hash of the parameters and of each input file's path, length and time, in all folders below.

    A step saved under this key is never served for another score id, another
    grid or changed input files.
    """
    seen = []
    for uri in inputs:
        fs, path = _path(spark, uri)
        files, found = fs.listFiles(path, True), []
        while files.hasNext():
            status = files.next()
            found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
        seen.append([uri, sorted(found)])
    text = json.dumps({"inputs": seen, "parameters": parameters}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def publish(spark: SparkSession, aside: str, uri: str) -> bool:
    """Move a finished folder to its name by one rename that never replaces; False if the name is taken.

    Of several writers one wins. A loser's folder is deleted, so that readers find the one whole step.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, source = _path(spark, aside)
    target = fs.makeQualified(_path(spark, uri)[1])
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_replace = gateway.new_array(rename, 1)
    never_replace[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(source), target, never_replace)
        return True
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(source, True)
        return False


def _aside(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/{_ASIDE}{key}-{uuid.uuid4().hex}"


def saved_step(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame],
               partition_by: Sequence[str] = ()) -> DataFrame:
    """Read the step saved under ``root/key``, or build it, write it aside, publish it and read it back."""
    uri = f"{root.rstrip('/')}/{key}"
    if not exists(spark, f"{uri}/_SUCCESS"):
        aside = _aside(root, key)
        build().write.partitionBy(*partition_by).parquet(aside)
        publish(spark, aside, uri)
    return spark.read.parquet(uri)


def saved_model(spark: SparkSession, root: str, key: str, fit: Callable[[], Any], reader: Any,
                facts: Mapping[str, Any] | None = None) -> Any:
    """Load the model saved under ``root/key``, or fit it, save it aside with its facts, and publish it."""
    uri = f"{root.rstrip('/')}/{key}"
    if not exists(spark, f"{uri}/model/metadata/_SUCCESS"):
        aside = _aside(root, key)
        fit().write().save(f"{aside}/model")
        spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in (facts or {}).items()],
                              "name string, value string").write.json(f"{aside}/facts")
        publish(spark, aside, uri)
    return reader.load(f"{uri}/model")


def drop_steps(spark: SparkSession, root: str, keep: Iterable[str] = (), older_than_hours: float = 24.0) -> list[str]:
    """Delete steps that are not in ``keep`` and folders that a lost writer left aside, if old enough; their names."""
    before, kept, dropped = (time.time() - 3600 * older_than_hours) * 1000, set(keep), []
    fs, path = _path(spark, root)
    for status in fs.listStatus(path) if fs.exists(path) else ():
        name = status.getPath().getName()
        if name not in kept and status.getModificationTime() <= before:
            fs.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)

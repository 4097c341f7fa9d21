"""Committed states of a folder of tables.

A state names, for each table, the directories (below ``<root>/<table>``) that make up its content.  States are
numbered; state n is the file ``_manifest/v=<n>``.  Data is always written to directories of new names, then the next
state is put in place by a rename that fails when that number is taken (compare and set): of two writers that began
from the same state one commits, the other gets ``Conflict`` and has touched nothing that anybody reads.  Readers hold
on to one state, so they never meet half of a change.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

State = dict[str, list[str]]


class Conflict(RuntimeError):
    """Somebody else committed since the state that this writer began from."""


def _folder(root: str) -> str:
    return os.path.join(root, "_manifest")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_name(prefix: str) -> str:
    """A directory name that no other writer uses."""
    return f"{prefix}-{uuid.uuid4().hex[:12]}"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below one, sorted."""
    files, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory())


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest committed state, 0 before the first; reads names only."""
    files, at = _file_system(spark, _folder(root))
    if not files.exists(at):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)


def state_of(spark: SparkSession, root: str, version: int) -> State:
    if version == 0:
        return {}
    lines = spark.read.text(os.path.join(_folder(root), f"v={version:012d}")).collect()     # one row a table
    pairs = [r["value"].split("\t") for r in lines]
    return {name: [d for d in dirs.split(",") if d] for name, dirs in pairs}


def commit(spark: SparkSession, root: str, base: int, state: State) -> int:
    """Makes ``state`` the one after ``base``; ``Conflict`` if there is such a state already."""
    files, staged = _file_system(spark, os.path.join(_folder(root), new_name(".staged")))
    text = "".join(f"{name}\t{','.join(dirs)}\n" for name, dirs in sorted(state.items()))
    out = files.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    final = os.path.join(_folder(root), f"v={base + 1:012d}")
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(staged, jvm.org.apache.hadoop.fs.Path(final), spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as e:
        files.delete(staged, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"state {base + 1} of {root} is committed already") from None
        raise
    return base + 1

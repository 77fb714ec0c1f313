"""Keep a snapshot folder in step with a git working tree."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.plans import sync as sy
from codeloom.sources import git, java_tree, snapshot

POINTER = "last_indexed_commit"


def sync(spark: SparkSession, root: str, folder: str, branch: str = "HEAD") -> str:
    """One of ``full``, ``none`` or ``incremental``, after doing it.

    Without a known commit, or when the known one is no ancestor of the current
    one, everything is built anew; equal commits or an empty difference change
    nothing but the pointer."""
    commit = git.current_commit(root, branch)
    if commit is None:
        raise RuntimeError(f"{root} is not a git repository")
    known = None
    if snapshot.current_version(spark, folder):
        index = snapshot.load(spark, folder)
        known = index.metadata.get(POINTER)
    if known is None or not git.is_ancestor(root, known, commit):
        index = sy.build(java_tree.scan(spark, root), root, java_tree.skipped(spark, root).count())
        index.metadata[POINTER] = commit
        snapshot.save(index, folder)
        return "full"
    if known == commit:
        return "none"
    changes = git.changed_files(spark, root, known, commit)
    files = java_tree.scan(spark, root)
    touched = changes.filter(F.col("status").isin("A", "M")).select("path")
    deleted = changes.filter(F.col("status") == "D").select("path")
    updated = sy.apply_changes(index, files.join(touched, "path", "left_semi"), deleted, java_tree.skipped(spark, root).count())
    updated.metadata[POINTER] = commit
    snapshot.save(updated, folder)
    return "incremental" if updated is not index else "none"

"""Which files changed between two commits, asked from git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

QUICK, SLOW = 10, 30  # seconds


def _git(repo: str, *args: str, timeout: int = QUICK) -> str | None:
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def current_commit(repo: str, branch: str = "HEAD") -> str | None:
    return _git(repo, "rev-parse", branch)


def branch_name(repo: str) -> str | None:
    return _git(repo, "rev-parse", "--abbrev-ref", "HEAD")


def is_ancestor(repo: str, older: str, newer: str) -> bool:
    return _git(repo, "merge-base", "--is-ancestor", older, newer) is not None


def change_rows(listing: str) -> list[tuple[str, str]]:
    """(status, path) of a name-status listing; a rename is a delete and an add."""
    rows = []
    for line in listing.splitlines():
        status, *paths = line.split("\t")
        if status.startswith("R") and len(paths) == 2:
            rows += [("D", paths[0]), ("A", paths[1])]
        elif status and paths:
            rows.append((status, paths[-1]))
    return rows


def changed_files(spark: SparkSession, repo: str, older: str, newer: str) -> DataFrame:
    listing = _git(repo, "diff", "--name-status", older, newer, timeout=SLOW) or ""
    return spark.createDataFrame(change_rows(listing), "status string, path string")

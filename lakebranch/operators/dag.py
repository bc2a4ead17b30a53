"""Ancestors and merge base in the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakebranch.snapshot import local_frame


def ancestors(commits: DataFrame, head: str | None) -> DataFrame:
    """(commit_id) of the head and all it comes from. Commits are metadata: their links are read once, and followed on the driver, each
    commit once, so that neither a long history nor a diamond of merges costs more than its commits."""
    parents = {r.commit_id: [p for p in (r.parent_id, r.second_parent_id) if p is not None] for r in commits.select("commit_id", "parent_id", "second_parent_id").collect()}
    known, left = set(), [head] if head in parents else []
    while left:
        one = left.pop()
        if one not in known:
            known.add(one)
            left += parents.get(one, [])
    return local_frame(commits.sparkSession, [(x,) for x in sorted(known)], "commit_id string")


def merge_base(commits: DataFrame, a: str | None, b: str | None) -> DataFrame:
    """(commit_id) of the newest common ancestor; no row where there is none. seq grows along every edge."""
    common = ancestors(commits, a).join(ancestors(commits, b), "commit_id").join(commits.select("commit_id", "seq"), "commit_id")
    return common.agg(F.max_by("commit_id", "seq").alias("commit_id")).filter("commit_id IS NOT NULL")


def base_snapshot(commits: DataFrame, a: str | None, b: str | None, fallback: str | None) -> str | None:
    """The merge base's snapshot, else that of the source branch's first commit, else none (an empty snapshot)."""
    row = merge_base(commits, a, b).join(commits, "commit_id").select("snapshot_id").first()
    if row is None and fallback is not None:
        row = commits.filter(F.col("commit_id") == fallback).select("snapshot_id").first()
    return row and row[0]

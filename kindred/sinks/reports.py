"""Report files. Lists are streamed from Spark one partition at a time, so the driver holds no whole list."""

from __future__ import annotations

import csv
import json
import os
import time
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import report
from kindred.plans.workflows import Matches

CSV_COLUMNS = ["source", "output", "status", "error"]
PAIR = ["cosine", "phash_distance", "same_sha256", "decision", "reason", "confidence"]


def _stream(df: DataFrame) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def _write_item(f: TextIO, item: dict) -> None:
    """One object; values that are iterators are written as lists, item by item."""
    f.write("{")
    for k, (name, value) in enumerate(item.items()):
        f.write((", " if k else "") + json.dumps(name) + ": ")
        if isinstance(value, Iterator):
            f.write("[")
            for i, x in enumerate(value):
                f.write((", " if i else "") + json.dumps(x))
            f.write("]")
        else:
            f.write(json.dumps(value))
    f.write("}")


def write_json(path: str, head: dict, lists: dict[str, Iterable[dict]]) -> str:
    """An object of the values in `head` and then the lists, written item by item; moved into place once whole."""
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write("{\n  ")
        f.write(",\n  ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in head.items()))
        for name, items in lists.items():
            f.write(f",\n  {json.dumps(name)}: [")
            for k, item in enumerate(items):
                f.write(("," if k else "") + "\n    ")
                _write_item(f, item)
            f.write("\n  ]")
        f.write("\n}\n")
    os.replace(f"{path}.part", path)
    return path


def review_rows(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Paths a and b and the evidence of each pair that is left to a person."""
    left, right = (records.select(F.col("idx").alias(i), F.col("path").alias(f"{i}_path")) for i in ("a", "b"))
    rows = pairs.where("decision = 'review'").join(left, "a").join(right, "b").orderBy("a", "b")
    return rows.select(F.col("a_path").alias("a"), F.col("b_path").alias("b"), *PAIR)


def dedup_report(path: str, found: Matches, kept: DataFrame, records: DataFrame, policy: str) -> dict:
    """Write the groups with what was kept and why the others go; returns the head."""
    s = report.summary(found.components, found.pairs, records).first()
    head = {"generated_at": time.strftime("%Y-%m-%d %H:%M:%S"), "total_images": s.total, "duplicate_groups": s.duplicate_groups, "total_duplicates": s.duplicates_to_remove, "review_only_pairs": s.review_pairs, "keep_policy": policy}
    groups = report.report_groups(found.components, kept, found.pairs, records).orderBy("group_id").drop("group_id")
    write_json(path, head, {"groups": _stream(groups), "review_only": _stream(review_rows(found.pairs, records))})
    return head


def reference_report(path: str, pairs: DataFrame, records: DataFrame, reference: str, reference_idx: int) -> dict:
    """Write what resembles the reference; returns the head."""
    total = records.where(F.col("idx") != reference_idx).count()
    counts = {r.decision: r.n for r in pairs.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.get("duplicate", 0)
    head = {"generated_at": time.strftime("%Y-%m-%d %H:%M:%S"), "reference_image": reference, "total_images": total, "duplicate_groups": int(n > 0), "total_duplicates": n, "review_only_pairs": counts.get("review", 0)}
    other = F.when(F.col("a") == reference_idx, F.col("b")).otherwise(F.col("a"))
    rows = pairs.where("decision = 'duplicate'").withColumn("idx", other).join(records.select("idx", "path"), "idx").orderBy("idx").select("path", *report.EVIDENCE)
    # one group, whose members are streamed into a file of their own shape
    groups = [{"keep": reference, "duplicates": _stream(rows)}] if n else []
    everyone = records.select("idx", "path").where(F.col("idx") != reference_idx).unionByName(records.sparkSession.createDataFrame([(reference_idx, reference)], "idx long, path string"))
    write_json(path, head, {"groups": groups, "review_only": _stream(review_rows(pairs, everyone))})
    return head


def selection_reports(folder: str, head: dict, funnel: dict, exports: list[dict], rejected: DataFrame) -> dict[str, str]:
    """Write the report, the table of exports, the lists of paths and the counters; returns the path of each file.

    `exports` has one row per selected record, so at most as many as were asked for; `rejected` (stage, reason, path) is
    streamed, and exports that failed follow it.
    """
    os.makedirs(folder, exist_ok=True)
    # fixed values: the names of the files
    names = {"json": "selection_report.json", "csv": "selected_images.csv", "selected": "selected.txt", "selected_output": "selected_output.txt", "rejected": "rejected_all.txt", "stats": "stats.txt"}
    at = {k: os.path.join(folder, v) for k, v in names.items()}
    fine, failed = [e for e in exports if e["status"] == "exported"], [e for e in exports if e["status"] != "exported"]

    def out() -> Iterator[dict]:
        yield from _stream(rejected.orderBy("stage", "path").select("path", "reason"))
        yield from ({"path": e["source"], "reason": "export_failed", "error": e.get("error")} for e in failed)

    def lines(name: str, rows: Iterable[str]) -> None:
        with open(at[name], "w", encoding="utf-8") as f:
            f.writelines(f"{r}\n" for r in rows)

    write_json(at["json"], {"generated_at": time.strftime("%Y-%m-%d %H:%M:%S"), **head, "funnel": funnel}, {"selected": exports, "rejected": out()})
    lines("selected", (e["source"] for e in fine))
    lines("selected_output", (e["output"] for e in fine))
    lines("rejected", (f"{r['reason']}\t{r['path']}" for r in out()))
    lines("stats", (f"{k}: {v}" for k, v in funnel.items()))
    with open(at["csv"], "w", newline="", encoding="utf-8") as f:
        table = csv.DictWriter(f, CSV_COLUMNS, restval="", extrasaction="ignore")
        table.writeheader()
        table.writerows(exports)
    return at

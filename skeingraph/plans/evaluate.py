"""Golden cases: a JSON file of queries with what their answers must hold."""

from __future__ import annotations

import json
import math
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMANDS = ("resolve", "who_calls", "calls", "impact", "read_plan", "pack")


def percentile(values: list[float], percent: int) -> float:
    """Nearest rank; 0 without values."""
    return sorted(values)[max(0, math.ceil(percent / 100 * len(values)) - 1)] if values else 0.0


def failures(case: dict, answer: dict) -> list[str]:
    """What the answer lacks: status, target, files, facts."""
    out = []
    status, target = case.get("expected_status", "ok"), case.get("target_fqname")
    if answer.get("status") != status:
        out.append(f"status: expected {status}, got {answer.get('status')}")
    have = (answer.get("target") or {}).get("fqname")
    if target and have != target:
        out.append(f"target: expected {target}, got {have}")
    files = {f["file_path"] for f in answer.get("files", [])}
    out += [f"missing file: {f}" for f in case.get("required_files", []) if f not in files]
    facts = {(f["rel_type"], f["src"].get("fqname"), f["dst"].get("fqname")) for f in answer.get("facts", [])}
    wanted = [(f.get("rel_type"), f.get("src_fqname"), f.get("dst_fqname")) for f in case.get("required_facts", [])]
    return out + [f"missing fact: {f}" for f in wanted if f not in facts]


def file_outcomes(cases: DataFrame, have: DataFrame) -> DataFrame:
    """(id, passed) of cases (id, required_files): whether all required files are among have (file_path).
    A case that requires none passes."""
    files = have.select(F.col("file_path").alias("__file"), F.lit(1).alias("__hit")).distinct()
    wanted = cases.select("id", F.explode_outer(F.array_distinct("required_files")).alias("file"))
    return wanted.join(files, F.col("file") == F.col("__file"), "left").groupBy("id").agg(F.bool_and(F.col("file").isNull() | F.col("__hit").isNotNull()).alias("passed"))


def tally(outcomes: DataFrame) -> DataFrame:
    """One row (total, passed, failed)."""
    return outcomes.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def run(service, path: Path) -> dict:
    suite = json.loads(Path(path).read_text(encoding="utf-8"))
    if suite.get("version") != 1 or not isinstance(suite.get("cases"), list):
        raise ValueError("an evaluation file needs version 1 and a list of cases")
    updated, results = service.update(), []
    for case in suite["cases"]:
        command = case.get("command", "pack")
        if command not in COMMANDS:
            raise ValueError(f"unknown evaluation command: {command}")
        began = time.perf_counter()
        answer = getattr(service, command)(case["query"])
        ms = (time.perf_counter() - began) * 1000
        missing = failures(case, answer)
        results.append({"id": case["id"], "passed": not missing, "latency_ms": round(ms, 3), "failures": missing})
    passed, times = sum(r["passed"] for r in results), [r["latency_ms"] for r in results]
    summary = {"total": len(results), "passed": passed, "failed": len(results) - passed, "p50_ms": round(percentile(times, 50), 3), "p95_ms": round(percentile(times, 95), 3)}
    return {"status": "ok" if passed == len(results) else "failed", "suite_version": 1, "index": updated, "summary": summary, "cases": results}

"""Extract, transform, check, log: one run over several sources."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.operators.cleanse import cleanse
from stockflow.operators.enrich import enrich
from stockflow.operators.quality import quality_checks
from stockflow.session import scratch_path
from stockflow.sources.files import multi_source, observed
from stockflow.sources.sinks import append_run_log

Step = Callable[[DataFrame], DataFrame]


class QualityError(RuntimeError):
    """A check named in ``fail_on`` did not pass."""


@dataclass
class Run:
    """What a run produced: a written table per source, the check report, the metrics."""

    name: str
    run_id: str
    status: str = "initialized"
    frames: dict[str, DataFrame] = field(default_factory=dict)
    checks: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=lambda: dict.fromkeys(
        ("sources_processed", "records_extracted", "records_transformed", "records_failed", "transformations_applied",
         "quality_checks_passed", "quality_checks_failed", "duration_seconds"), 0))


def run_etl(
    spark: SparkSession,
    name: str,
    loaders: dict[str, Callable[[], DataFrame]],
    steps: Sequence[Step] = (cleanse, enrich),
    schemas: dict[str, T.StructType | str] | None = None,
    validate: bool = True,
    fail_on: Sequence[str] = (),
    as_of: Column | None = None,
    output: str | None = None,
    log_path: str | None = None,
) -> Run:
    """Load every source, apply ``steps``, write the result, check it, and log the run.

    A source whose steps or write fail passes on untransformed and counts as failed; the others go on.
    Quality checks only report, unless named in ``fail_on``.
    """
    run = Run(name, str(uuid.uuid4()), "running")
    started, clock = datetime.now(timezone.utc).replace(tzinfo=None), time.monotonic()
    output = output or scratch_path(spark, "etl")
    m = run.metrics
    try:
        sources, run.errors = multi_source(spark, loaders, schemas)
        m["sources_processed"] = len(sources)
        reports = []
        for source, raw in sources.items():
            run.frames[source] = _transform(spark, run, source, raw, steps, f"{output}/{source}")
            if validate and run.frames[source].columns:
                reports.append(quality_checks(run.frames[source], source, as_of if as_of is not None else F.current_timestamp()))
        if reports:
            run.checks = reduce(DataFrame.unionByName, reports)
            outcome = run.checks.select("table_name", "check_name", "passed").collect()  # four rows per source
            m["quality_checks_passed"] = sum(r.passed for r in outcome)
            m["quality_checks_failed"] = sum(not r.passed for r in outcome)
            broken = [f"{r.table_name}.{r.check_name}" for r in outcome if not r.passed and r.check_name in fail_on]
            if broken:
                raise QualityError(f"quality checks failed: {broken}")
        run.status = "completed"
    except Exception as error:
        run.status = "failed"
        run.errors["run"] = str(error).splitlines()[0]
        raise
    finally:
        m["duration_seconds"] = time.monotonic() - clock
        if log_path:
            append_run_log(spark, log_path, _log_entry(run, started))
    return run


def _transform(spark: SparkSession, run: Run, source: str, raw: DataFrame, steps: Sequence[Step], path: str) -> DataFrame:
    """The written result of ``steps``; the raw frame if they fail."""
    m = run.metrics
    watched, extracted = observed(raw, f"extract-{source}-{uuid.uuid4().hex}")
    staged = None
    try:
        watched.write.mode("overwrite").parquet(f"{path}/raw")
        staged = spark.read.parquet(f"{path}/raw")
        m["records_extracted"] += extracted.get["records_extracted"]
        if not extracted.get["records_extracted"]:
            return staged  # nothing to transform
        result = staged
        for step in steps:
            result = result.transform(step)
            m["transformations_applied"] += 1
        done, transformed = observed(result, f"transform-{source}-{uuid.uuid4().hex}")
        done.write.mode("overwrite").parquet(f"{path}/final")
        m["records_transformed"] += transformed.get["records_extracted"]
        return spark.read.parquet(f"{path}/final")
    except Exception as error:
        run.errors[source] = str(error).splitlines()[0]
        if staged is not None:
            m["records_failed"] += extracted.get["records_extracted"]
        return staged if staged is not None else raw


def _log_entry(run: Run, started: datetime) -> dict:
    m = run.metrics
    return {
        "pipeline_name": run.name,
        "run_id": run.run_id,
        "status": run.status,
        "records_processed": int(m["records_transformed"]),
        "records_failed": int(m["records_failed"]),
        "records_skipped": 0,
        "error_message": "; ".join(f"{k}: {v}" for k, v in run.errors.items()) or None,
        "started_at": started,
        "completed_at": datetime.now(timezone.utc).replace(tzinfo=None),
        "duration_seconds": float(m["duration_seconds"]),
        "run_metadata": {k: str(m[k]) for k in ("transformations_applied", "quality_checks_passed", "quality_checks_failed")},
    }

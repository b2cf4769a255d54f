"""A scan from target to session: the plan that the command line and callers run."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake import __version__
from sievelake.functions import scalars as S
from sievelake.operators import assess, correlate, findings, review, rollup
from sievelake.sources import acquire, files

COUNTERS = ("static_findings_count", "ai_findings_count", "verified_findings_count", "ai_candidate_findings", "ai_rejected_findings", "invalid_ai_locations", "provider_errors", "static_rule_count", "correlated_findings", "duplicate_ai_findings")


@dataclass
class Session:
    """A scan's result; ``files`` and ``findings`` stay DataFrames."""

    path: str
    files: DataFrame
    findings: DataFrame
    source_type: str = "local"
    repository_url: str | None = None
    ref: str | None = None
    ai_enabled: bool = False
    ai_mode: str | None = None
    ai_provider: str | None = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    start: datetime = field(default_factory=lambda: datetime.now(UTC))
    end: datetime | None = None
    duration_seconds: float = 0.0
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def project(self) -> dict:
        row = rollup.project_summary(self.files).first()
        return {"path": self.path, "languages": row.languages, "file_count": row.file_count, "scanned_files": row.scanned_files, "source_type": self.source_type, "repository_url": self.repository_url, "ref": self.ref}

    def summary(self) -> dict:
        keys = ("id", "ai_enabled", "ai_mode", "ai_provider")
        return {k: getattr(self, k) for k in keys} | {"project": self.project(), "start_time": self.start, "end_time": self.end, "duration_seconds": self.duration_seconds, "status": "completed", "version": __version__} | self.counters

    def fails(self, threshold: str = "LOW") -> bool:
        return self.findings.agg(rollup.fails(F.col("classification.severity"), threshold)).first()[0]


def scan_files(spark: SparkSession, tree: DataFrame, path: str = "", ai: bool = False, mode: str = "hybrid", provider: str | assess.Provider = "mock", strict: bool = True, tokens: tuple[str, ...] = findings.SUPPRESS, by_lang: dict[str, DataFrame] | None = None) -> Session:
    """Scan ``tree`` (path, abs_path, name, content, lang, is_fixture); ``by_lang`` may hold its python and config files
    apart."""
    began = time.monotonic()
    python, config = ((by_lang or {}).get(k, tree).where("content is not null") for k in ("python", "config"))
    session = Session(path, tree, assess.written(findings.findings(python, strict, tokens, config=config)))
    session.duration_seconds, session.end = time.monotonic() - began, datetime.now(UTC)
    if not ai:
        return session
    name = provider if isinstance(provider, str) else type(provider).__name__
    model = assess.provider_named(provider) if isinstance(provider, str) else provider
    session.ai_enabled, session.ai_mode, session.ai_provider = True, mode, name
    static, found = session.findings, None
    if mode in ("discover", "hybrid"):
        readable = tree.where("content is not null")
        lines = readable.select("path", S.split_lines(F.col("content")).alias("lines"))
        got = assess.discover(review.review_units(review.reviewable(readable)), lines, model, path or None)
        found = assess.written(got.findings)
        session.counters |= {"ai_candidate_findings": got.candidates, "ai_rejected_findings": got.rejected, "invalid_ai_locations": got.rejected, "provider_errors": got.provider_errors}
        # Written, so that the verification does not plan the correlation anew, with its expressions inside those of the prompts.
        session.findings = found if mode == "discover" else assess.written(correlate.correlate(static, found, root=path or None))
    if mode in ("verify", "hybrid"):
        session.findings = assess.verify(session.findings, model)
    session.findings = assess.written(session.findings)
    session.counters |= {"static_findings_count": static.count(), "ai_findings_count": found.count() if found is not None else 0}
    row = rollup.counters(session.findings).first()
    session.counters |= {"verified_findings_count": row.verified_findings, "static_rule_count": row.rules_hit, "correlated_findings": row.correlated_findings}
    return session


def scan(spark: SparkSession, target: str, **how) -> Session:
    """Scan a folder or file that all executors see."""
    by_lang = {lang: files.read_tree(spark, target, lang=lang) for lang in S.ANALYZERS}
    return scan_files(spark, files.read_tree(spark, target), os.path.abspath(target), by_lang=by_lang, **how)


def scan_repository(spark: SparkSession, url: str, ref: str | None = None, folder: str | None = None, opener=None, **how) -> Session:
    """Fetch a repository's archive, check and unpack it below ``folder`` (shared by all executors), and scan it."""
    named = spark.range(1).select(acquire.validate_url(F.lit(url)).alias("r")).first().r
    if named.error:
        raise acquire.AcquisitionError("invalid_url", named.error)
    more = {"opener": opener} if opener else {}
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that the driver and all executors share")
    with tempfile.TemporaryDirectory(dir=folder) as work:
        archive, tree = os.path.join(work, "archive.zip"), os.path.join(work, "tree")
        os.makedirs(tree)
        acquire.download_archive(named.owner, named.repo, ref or "HEAD", archive, **more)
        acquire.safe_extract(spark, archive, tree)
        session = scan(spark, tree, **how)
        session.files = assess.written(session.files)
    session.path, session.source_type, session.repository_url, session.ref = f"{named.owner}/{named.repo}", "github", url, ref or "HEAD"
    return session

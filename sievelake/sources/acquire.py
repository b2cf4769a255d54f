"""Remote repositories: address checks, archive limits and extraction.

The checks are relations: an address or an archive's member list is judged by expressions and one
window, and only an archive whose list passed is opened for extraction.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
import zipfile
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOSTS = ("github.com", "www.github.com")
#: Pages of a repository that are not the repository (fixed values).
PAGES = ("issues", "pull", "releases", "actions", "wiki")
MB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Of an archive (fixed values)."""

    archive_bytes: int = 50 * MB
    files: int = 5000
    file_bytes: int = 10 * MB
    total_bytes: int = 120 * MB
    connect_seconds: int = 5
    read_seconds: int = 30


class AcquisitionError(Exception):
    """``kind`` says what failed, as ``scalars.error_status`` knows it."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def validate_url(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """struct(owner, repo, error): what a repository address names, or why it names none."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    pieces = F.filter(F.split(F.coalesce(part("PATH"), F.lit("")), "/"), lambda x: x != "")
    owner, repo = F.get(pieces, F.lit(0)), F.regexp_replace(F.get(pieces, F.lit(1)), r"\.git$", "")
    size = lambda x: F.length(x).between(1, 100)
    error = (
        F.when(~F.coalesce(F.lower(part("PROTOCOL")) == "https", F.lit(False)), "scheme is not https")
        .when(~F.coalesce(F.lower(part("AUTHORITY")).isin(*hosts), F.lit(False)), "host is not allowed")
        .when(F.size(pieces) < 2, "no owner and repository")
        .when(~(size(owner) & size(repo)), "name is too long or empty")
        .when(F.coalesce(F.get(pieces, F.lit(2)).isin(*PAGES), F.lit(False)), "not a repository page")
    )
    return F.struct(F.when(error.isNull(), owner).alias("owner"), F.when(error.isNull(), repo).alias("repo"), error.alias("error"))


def looks_like_repository(url: Column) -> Column:
    """What a form asks before it sends an address: the host's name occurs in it."""
    return F.coalesce(url.contains(HOSTS[0]), F.lit(False))


def check_members(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``members`` (archive, ord, filename, size, attr) with n_before, total_before and ``error``: the first check that
    the member fails, in the order in which they are made."""
    so_far = Window.partitionBy("archive").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = members.withColumn("n_files", F.count(F.lit(1)).over(so_far)).withColumn("total_bytes", F.sum("size").over(so_far))
    name = F.col("filename")
    # What ``a/./b//c`` comes to cannot climb without ``..``, which is refused before; a drive or a root can.
    error = (
        F.when(name.startswith("/") | name.startswith("\\"), "absolute path")
        .when(name.contains(".."), "path traversal")
        .when(F.col("n_files") > limits.files, "too many files")
        .when(F.col("size") > limits.file_bytes, "file too large")
        .when(F.col("total_bytes") > limits.total_bytes, "archive too large")
        .when(F.shiftright("attr", 16).bitwiseAND(0o120000) == 0o120000, "symlink")
    )
    return out.withColumn("error", error)


def first_violations(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, n_members, error, filename) per archive; error and filename of its first bad member or null."""
    bad = F.col("error").isNotNull()
    return check_members(members, limits).groupBy("archive").agg(
        F.count(F.lit(1)).alias("n_members"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("ord"))).alias("error"), F.min_by(F.when(bad, F.col("filename")), F.when(bad, F.col("ord"))).alias("filename")
    )


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The member list of a zip file; nothing is unpacked."""
    with zipfile.ZipFile(path) as z:
        rows = [(path, i, m.filename, m.file_size, m.external_attr) for i, m in enumerate(z.infolist())]
    return spark.createDataFrame(rows, "archive string, ord int, filename string, size long, attr long")


def safe_extract(spark: SparkSession, path: str, folder: str, limits: Limits = Limits()) -> int:
    """Unpack an archive whose members all pass; the number of members."""
    bad = check_members(archive_members(spark, path), limits).where("error is not null").orderBy("ord").select("error", "filename").first()
    if bad:
        kind = "too_large" if bad.error in ("too many files", "file too large", "archive too large") else "unsafe_archive"
        raise AcquisitionError(kind, f"{bad.error}: {bad.filename}")
    root = os.path.realpath(folder)
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, m.filename))]) != root:
                raise AcquisitionError("unsafe_archive", f"leaves the folder: {m.filename}")
            z.extract(m, root)
        return len(z.infolist())


def _open(url: str, opener=urllib.request.urlopen, limits: Limits = Limits()):
    try:
        return opener(urllib.request.Request(url, headers={"User-Agent": "sievelake"}), timeout=limits.read_seconds)
    except urllib.error.HTTPError as e:
        kinds = {404: "not_found", 403: "rate_limited"}
        raise AcquisitionError(kinds.get(e.code, "upstream"), f"HTTP {e.code}") from e
    except OSError as e:
        raise AcquisitionError("upstream", str(e)) from e


def default_branch(owner: str, repo: str, opener=urllib.request.urlopen) -> str:
    with _open(f"https://api.github.com/repos/{owner}/{repo}", opener) as reply:
        return json.load(reply).get("default_branch", "main")


def download_archive(owner: str, repo: str, ref: str, target: str, limits: Limits = Limits(), opener=urllib.request.urlopen) -> int:
    """Fetch a repository's zip in pieces, as far as the limit; bytes written."""
    total = 0
    with _open(f"https://codeload.github.com/{owner}/{repo}/zip/{quote(ref or 'HEAD')}", opener, limits) as reply, open(target, "wb") as out:
        while piece := reply.read(8192):
            total += len(piece)
            if total > limits.archive_bytes:
                raise AcquisitionError("too_large", f"archive exceeds {limits.archive_bytes} bytes")
            out.write(piece)
    return total

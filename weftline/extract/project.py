"""Source files of a project, and where it comes from."""

from __future__ import annotations

import re
import subprocess
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("ts", "tsx")


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the TypeScript files below ``root``, without declaration files
    and those of installed packages; ``path`` is relative to ``root``. Each file is read
    whole, by the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx}").load(root)
    root_uri = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = root_uri.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root_uri).toUri().getPath().rstrip("/")
    # file names are paths, not addresses: nothing in them is decoded
    full = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/]*)?(?=/)", "")
    rows = found.select(F.substring(full, len(base) + 2, 1 << 30).alias("path"), F.decode("content", "UTF-8").alias("text"))
    return project_files(rows)


def project_files(files: DataFrame) -> DataFrame:
    """The files (path, text) that belong to a project."""
    path = F.concat(F.lit("/"), F.col("path"))
    return files.where(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").endswith(".d.ts") & ~F.contains(path, F.lit("/node_modules/")))


def github_base_url(remote: str) -> str | None:
    """``https://<host>/<owner>/<repository>`` of a remote on a GitHub host, else None."""
    remote = remote.strip()
    if "://" in remote:
        parts = urlsplit(remote)
        host, path = parts.netloc.rpartition("@")[2], parts.path
    else:
        found = re.match(r"^[^@]+@([^:]+):(.+)$", remote)
        if not found:
            return None
        host, path = found.groups()
    names = [x for x in re.sub(r"\.git$", "", path).split("/") if x]
    return f"https://{host}/{names[0]}/{names[1]}" if "github" in host.lower() and len(names) > 1 else None


def provenance(folder: str) -> dict | None:
    """{baseUrl, commit, prefix} of a working tree with a GitHub origin, else None."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    if git("rev-parse", "--is-inside-work-tree") != "true":
        return None
    remote, commit = git("remote", "get-url", "origin"), git("rev-parse", "HEAD")
    base = github_base_url(remote) if remote else None
    return {"baseUrl": base, "commit": commit, "prefix": git("rev-parse", "--show-prefix") or ""} if base and commit else None

"""Reading source files: scan, ignore list, eligibility, decoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import content_hash, without_bom
from quern.operators.languages import EXTENSIONS

MAX_BYTES = 1 << 20
# Folders and files that are never indexed.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__", "venv", ".venv", "target", "vendor", ".quern")
IGNORED_FILES = ("*.min.js", "*.bundle.js", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")


def ignored(path: Column, folders=IGNORED, files=IGNORED_FILES) -> Column:
    names = "|".join(re.escape(f) for f in folders)
    globs = "|".join(re.escape(f).replace(r"\*", "[^/]*") for f in files)
    return path.rlike(f"/(?:{names})/") | path.rlike(f"/(?:{globs})$")


def reason_to_skip(length: Column, limit: int = MAX_BYTES) -> Column:
    """Why a file is not indexed, or null."""
    return F.when(length > limit, "too large").when(length == 0, "empty")


def outermost(roots) -> list[str]:
    """The roots without those that lie below another one."""
    out: list[str] = []
    for r in sorted({x.rstrip("/") or "/" for x in ([roots] if isinstance(roots, str) else roots)}):
        if not any(r.startswith(o.rstrip("/") + "/") for o in out):
            out.append(r)
    return out


def scan(spark: SparkSession, root: str | list[str], extensions=EXTENSIONS, limit: int = MAX_BYTES) -> DataFrame:
    """(file_path, length, modified_at, skip, content, content_hash) of the files below ``root``, or several roots.

    The glob prunes the listing and lengths the reading: files that are skipped are listed and never opened. A root below
    another one is listed once, so paths are distinct without a shuffle. Files that cannot be read or vanish meanwhile are
    left out.
    """
    glob = "*.{" + ",".join(e[1:] for e in extensions) + "}"
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob, "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    raw = spark.read.format("binaryFile").options(**options).load(outermost(root))
    raw = raw.withColumn("file_path", F.regexp_replace("path", "^file:/*", "/")).filter(~ignored(F.col("file_path")))
    why = reason_to_skip(F.col("length"), limit)
    null = F.lit(None).cast("string")
    head = ("file_path", "length", F.col("modificationTime").alias("modified_at"))
    good = raw.filter((F.col("length") > 0) & (F.col("length") <= limit)).select(*head, null.alias("skip"), without_bom(F.expr("decode(content, 'UTF-8')")).alias("content"), F.md5("content").alias("content_hash"))
    rest = raw.filter((F.col("length") == 0) | (F.col("length") > limit)).select(*head, why.alias("skip"), null.alias("content"), null.alias("content_hash"))
    return good.unionByName(rest)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Texts of a documents table as files under ``/corpus``."""
    p = F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(p.alias("file_path"), F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"))

"""Files as a source: walking a tree, ignore patterns, eligibility, reading.

Listing runs on the driver, as a tree's names are few beside its contents; the
contents are read and hashed by executors, from paths that they share.
"""

from __future__ import annotations

import logging
import os
import re
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx

log = logging.getLogger(__name__)

#: Suffixes of files that are indexed, and the size from which none is.
EXTENSIONS = (".md", ".mdx", ".txt", ".rst", ".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".toml", ".yaml", ".yml", ".json")
MAX_BYTES = 1_048_576


def glob_regex(pattern: str) -> tuple[str, bool] | None:
    """An ignore pattern as (regex over relative paths, is it a negation); None for none.

    A slash at the start or inside ties a pattern to the root, else it holds at any
    depth; one at the end asks for a folder. ``**`` crosses folders.
    """
    text = pattern.rstrip("\n")
    if not re.search(r"\\ $", text):
        text = text.rstrip(" ")
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    folder = text.endswith("/")
    text = text.rstrip("/") if folder else text
    tied = "/" in text
    parts = [p for i, p in enumerate(text.split("/")) if p or i]
    if not parts:
        return None
    out = "^" if tied else "^(?:.*/)?"
    for i, part in enumerate(parts):
        end = i == len(parts) - 1
        if part == "**":
            out += "[^/].*" if end else "(?:.*/)?"
            continue
        out += _glob_part(part) + ("" if end else "/")
    inside = "/.*$" if folder else ("$" if parts[-1] == "**" else "(?:/.*)?$")
    return out + inside, negated


def _glob_part(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        close = part.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
            while part[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = part[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = close
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path is not a negation."""
    state = F.lit(False)
    for regex, negated in filter(None, map(glob_regex, patterns)):
        state = F.when(path.rlike(regex), F.lit(not negated)).otherwise(state)
    return state


def eligible(files: DataFrame, max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of (path, size) with an indexed suffix; adds ext and oversize."""
    named = files.withColumn("ext", tx.extension(F.col("path")))
    return named.where(F.col("ext").isin(*extensions)).withColumn("oversize", F.col("size") >= max_bytes)


def _plain(root: Path) -> list[Path]:
    return [Path(d) / name for d, _, names in os.walk(root) for name in names]


def _by_git(root: Path) -> list[Path] | None:
    command = ["git", "-C", str(root), "ls-files", "--cached", "--others", "--exclude-standard", "-z"]
    try:
        done = subprocess.run(command, capture_output=True, check=False)
    except OSError as e:
        log.warning("git can't be run, walking %s without it: %s", root, e)
        return None
    if done.returncode:
        log.warning("git ls-files failed, walking %s without it: %s", root, done.stderr.decode(errors="replace"))
        return None
    names = done.stdout.decode("utf-8", errors="replace").split("\0")
    return [root / n for n in names if n]


def walk(spark: SparkSession, root: str | Path, ignore: list[str] | None = None, respect_gitignore: bool = False,
         max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, rel_path, size, ext, oversize) of the files under ``root`` that may be indexed.

    Hidden files count. Git lists the files only if it is asked to and ``root`` is a
    work tree; files that can't be looked at are left out.
    """
    root = Path(root)
    found = None
    if respect_gitignore:
        if (root / ".git").is_dir():
            found = _by_git(root)
        else:
            log.warning("%s is no git work tree, walking it without git", root)
    rows = []
    for path in _plain(root) if found is None else found:
        try:
            if path.is_file():
                rows.append((str(path), path.relative_to(root).as_posix(), path.stat().st_size))
        except OSError:
            continue
    listed = spark.createDataFrame(rows, "path string, rel_path string, size long")
    return eligible(listed.where(~ignored(F.col("rel_path"), ignore or [])), max_bytes, extensions)


def read_files(files: DataFrame) -> DataFrame:
    """Add file_hash (of the bytes), text (decoded) and error; one file that fails is a row.

    Runs where the paths are: the names come from ``walk``, hidden ones included,
    which Spark's own file listing would skip.
    """
    @F.pandas_udf("struct<content:binary,error:string>")
    def load(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for path in paths:
            try:
                rows.append((Path(path).read_bytes(), None))
            except OSError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["content", "error"])

    loaded = files.withColumn("_f", load("path"))
    return loaded.select(*files.columns, F.sha2("_f.content", 256).alias("file_hash"), tx.decode_utf8(F.col("_f.content")).alias("text"), F.col("_f.error").alias("error"))

"""Source trees and uploads: listing, reading, triage."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import choose, skipped, suffix
from ..schemas import SKIP_DIRS
from .lineage import written

# Suffixes an upload may have.
SAFE_SUFFIXES = (
    ".py", ".pyw", ".pyi", ".java", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hxx", ".php", ".phtml", ".js", ".jsx", ".ts", ".tsx", ".mjs",
    ".html", ".htm", ".xhtml", ".css", ".scss", ".sass", ".go", ".rb", ".erb", ".rake", ".gemspec", ".rs", ".cs", ".kt", ".kts", ".swift",
    ".sh", ".bash", ".zsh", ".sql", ".json", ".yaml", ".yml", ".xml", ".toml", ".ini", ".conf", ".md", ".txt", ".properties",
)
MAX_UPLOAD, MAX_RATIO, MAX_MEMBERS = 10 * 1024 * 1024, 100, 1000


def _filesystem(root: str):
    """pyarrow's file system of a URI and the path in it; none for plain paths and ``file:``, which tasks open themselves."""
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*://", root):
        from pyarrow import fs

        return fs.FileSystem.from_uri(root)
    return None, re.sub(r"^file:(//)?", "", root)


def read_tree(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, length, text) of files named in ``paths`` (path, relative to ``root``), read by the tasks.

    Spark's own file sources hide names that start with ``_`` or ``.``; these are read. ``root`` is a folder that all
    executors mount, or a URI that pyarrow opens. A file that can't be read has a null text. Bytes that aren't UTF-8 are replaced.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _filesystem(root)
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with store.open_input_stream(f"{base}/{p}") if store else open(f"{base}/{p}", "rb") as f:
                        data = f.read()
                    rows.append((p, len(data), data.decode("utf-8", "replace")))
                except OSError:
                    rows.append((p, None, None))
            yield pd.DataFrame(rows, columns=["path", "length", "text"])

    return paths.select("path").mapInPandas(read, "path string, length long, text string")


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is_dir) of what stands in a folder, without links; a folder that is gone has nothing."""
    store, base = _filesystem(root)
    place = f"{folder}/" if folder else ""
    try:
        if store:
            from pyarrow import fs

            for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                yield place + i.base_name, i.size or 0, i.type == fs.FileType.Directory
            return
        with os.scandir(f"{base}/{folder}") as found:
            for e in found:
                try:
                    if not e.is_symlink():
                        yield place + e.name, e.stat().st_size, e.is_dir()
                except OSError:  # it went meanwhile
                    continue
    except OSError:
        return


def walk_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under ``root``, relative to it; skipped directories are not entered, links are left out.

    The tree is walked level by level. Each round lists one table of directories, dealt over tasks one by one, however
    unevenly the tree is filled; what it finds is written. ``root`` is a folder that all executors mount, or a URI that
    pyarrow opens. Files and directories that vanish meanwhile are left out.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                found = _entries(root, folder)
                while rows := list(islice(found, 10_000)):
                    yield pd.DataFrame(rows, columns=["path", "length", "is_dir"])

    level, files = spark.createDataFrame([("",)], "path string"), []
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while not level.isEmpty():
        found = written(level.repartition(tasks).mapInPandas(look, "path string, length long, is_dir boolean"))
        files.append(found.where("not is_dir").select("path", "length"))
        name = F.lower(F.element_at(F.split("path", "/"), -1))
        level = found.where(F.col("is_dir") & ~name.isin(list(SKIP_DIRS))).select("path")
    return reduce(DataFrame.union, files)


def listed(paths: DataFrame, max_depth: int = 10) -> DataFrame:
    """Paths outside skipped directories and at most ``max_depth`` directories deep."""
    return paths.where(~skipped(F.col("path")) & (F.size(F.split("path", "/")) <= max_depth + 1))


def filename_reason(name: Column) -> Column:
    """Why an upload's name is refused, else null."""
    n = F.trim(F.coalesce(name, F.lit("")))
    s = suffix(n)
    return (
        F.when(n == "", "empty name")
        .when(n.contains("..") | n.contains("/") | n.contains("\\"), "path traversal")
        .when(F.length(n) > 255, "name too long")
        .when((s != "") & ~s.isin(*SAFE_SUFFIXES), "type not allowed")
    )


def is_executable(content: Column) -> Column:
    """ELF, PE or Mach-O by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    known = head.isin("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE") | head.startswith("4D5A")
    return F.coalesce((F.octet_length(content) >= 4) & known, F.lit(False))


def content_reason(content: Column, max_size: int = MAX_UPLOAD) -> Column:
    """Why an upload's bytes are refused before any archive is opened, else null; the first reason counts."""
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(F.octet_length(content) > max_size, "too large")
        .when(is_executable(content), "executable")
    )


def zip_members(archives: DataFrame) -> DataFrame:
    """Members of archives (path, content): member, size, flag (``ok``, ``traversal``, ``symlink``, ``bad archive``), data.

    Data is only unpacked for members that are ok, and only of archives that :func:`zip_bombs` would pass.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        infos = z.infolist()
                        bomb = len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_RATIO * len(content)
                        for i in infos:
                            name = i.filename.replace("\\", "/")
                            if name.startswith("/") or ".." in name.split("/"):
                                flag = "traversal"
                            elif (i.external_attr >> 16) & 0o170000 == 0o120000:
                                flag = "symlink"
                            else:
                                flag = "ok"
                            data = z.read(i) if flag == "ok" and not bomb and not i.is_dir() else None
                            rows.append((path, i.filename, i.file_size, flag, data))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, ValueError, OSError):
                    rows.append((path, None, None, "bad archive", None))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "flag", "data"])

    return archives.select("path", "content").mapInPandas(expand, "path string, member string, size long, flag string, data binary")


def _number(content: Column, at: Column, size: int) -> Column:
    """A little-endian number of ``size`` bytes at a place (from 1)."""
    digits = [F.hex(F.substring(content, at + k, F.lit(1))) for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def zip_directory(content: Column) -> Column:
    """struct(members, unpacked) of an archive, from its central directory; zeros for what is none.

    Stays in the JVM: the directory's end gives the number of members and its size, and a fold over the members adds their
    sizes. Of archives with over ``MAX_MEMBERS`` members only the number is read.
    """
    length = F.octet_length(content)
    back = F.reverse(F.hex(F.substring(content, F.greatest(length - 65_556, F.lit(1)), F.lit(65_557))))

    def step(so_far: Column, _: Column) -> Column:
        at = so_far["at"]
        known = F.hex(F.substring(content, at, F.lit(4))) == "504B0102"
        more = 46 + _number(content, at + 28, 2) + _number(content, at + 30, 2) + _number(content, at + 32, 2)
        return F.struct(F.when(known, at + more.cast("int")).alias("at"), (so_far["sum"] + F.when(known, _number(content, at + 24, 4))).alias("sum"))

    def unpacked(members: Column, first: Column) -> Column:
        each = F.when((members > 0) & (members <= MAX_MEMBERS), F.sequence(F.lit(1), members.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(each, F.struct(first.alias("at"), F.lit(0).cast("bigint").alias("sum")), step)["sum"]

    def summed(end: Column) -> Column:
        members, first = _number(content, end + 10, 2), (end - _number(content, end + 12, 4)).cast("int")
        return _once(F.struct(members.alias("m"), first.alias("first")), lambda d: F.struct(d["m"].alias("members"), F.when(d["first"] >= 1, unpacked(d["m"], d["first"])).alias("unpacked")))

    found = F.instr(back, "6050B405")  # the end's mark, backwards
    end = _once(found, lambda at: F.when((at > 0) & (at % 2 == 1), length - F.floor((at - 1) / 2).cast("int") - 3))
    none = F.struct(F.lit(0).cast("bigint").alias("members"), F.lit(0).cast("bigint").alias("unpacked"))
    return _once(_once(end, summed), lambda d: F.when(d["unpacked"].isNotNull(), d).otherwise(none))


def is_zip_bomb(content: Column) -> Column:
    """Starts as an archive does, and is too dense or has too many members; a broken one is none."""
    named = (F.octet_length(content) >= 4) & (F.hex(F.substring(content, F.lit(1), F.lit(2))) == "504B")
    bomb = _once(zip_directory(content), lambda d: (d["unpacked"] > MAX_RATIO * F.octet_length(content)) | (d["members"] > MAX_MEMBERS))
    return F.coalesce(F.when(named, bomb), F.lit(False))


def zip_bombs(archives: DataFrame) -> DataFrame:
    """(path, is_bomb) of uploads that start as archives do."""
    named = archives.where((F.octet_length("content") >= 4) & (F.hex(F.substring("content", 1, 2)) == "504B"))
    return named.select("path", is_zip_bomb(F.col("content")).alias("is_bomb"))


# Types that are refused, by the suffixes that usually name them.
BLOCKED_TYPES = {
    ".dvi": "application/x-dvi", ".exe": "application/x-msdownload", ".dll": "application/x-msdownload", ".com": "application/x-msdownload", ".bat": "application/x-msdownload",
    ".msi": "application/x-msdownload", ".o": "application/x-object", ".elf": "application/x-elf",
}


def upload_reason(name: Column, content: Column, max_size: int = MAX_UPLOAD) -> Column:
    """Why an upload is refused, else null: empty, too large, blocked type, executable, zip bomb; the first that holds."""
    kind = choose(suffix(F.regexp_replace(name, r"(?i)\.(gz|bz2|xz|br|z)$", "")), BLOCKED_TYPES)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(F.octet_length(content) > max_size, "too large")
        .when(kind.isNotNull(), F.concat(F.lit("blocked type "), kind))
        .when(is_executable(content), "executable")
        .when(is_zip_bomb(content), "zip bomb")
    )

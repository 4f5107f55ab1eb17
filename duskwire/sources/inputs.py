"""What a scan reads: files, folders, lists of URLs, tables of fetched pages."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwire.functions.heuristics import any_in, is_binary

# File endings by kind, marks of code, and content types of responses.
CONTENT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".css", ".json", ".xml", ".yaml", ".yml", ".md", ".csv", ".ini", ".conf", ".config"]
LIST_EXTENSIONS = [".list", ".urls"]
BINARY_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "ico", "exe", "dll", "so", "dylib", "bin", "o", "obj", "a", "lib", "zip", "tar", "gz", "7z", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4",
    "avi", "mov", "flv", "ttf", "woff", "woff2", "eot", "class", "jar",
]
CODE_MARKS = [
    "{", "}", "function", "var ", "let ", "const ", "import ", "export ", "class ", "if ", "for ", "while ", "switch ", "<html", "<div", "<script", "/*", "*/", "//", "#include", "#define", "package ",
]
ALLOWED_TYPES = ["application/javascript", "text/javascript", "application/x-javascript", "text/plain", "text/html", "application/json"]


def looks_like_url_or_path(line: str) -> bool:
    """An http(s) URL, anything with a slash, or a dotted name without white space whose last part has two bytes or more."""
    if line.startswith(("http://", "https://")) or "/" in line or "\\" in line:
        return True
    parts = line.split(".")
    return len(parts) >= 2 and not any(x.isspace() for x in line) and len(parts[-1].encode()) >= 2


def looks_like_code(text: str) -> bool:
    return any(m in text for m in CODE_MARKS)


def is_url_list(name: str, text: str) -> bool:
    """Whether a file lists URLs or paths and isn't content to scan.

    Blank lines and those that start with ``#`` don't count. A ``.txt`` file of fewer
    than ten lines that looks like code, as any with ``//`` does, is content.
    """
    lines = [x for x in (y.strip() for y in text.split("\n")) if x and not x.startswith("#")]
    ending = os.path.splitext(name)[1].lower()
    n = len(lines)
    if not n or ending in CONTENT_EXTENSIONS:
        return False
    if ending in LIST_EXTENSIONS:
        return True
    if ending == ".txt":
        if n < 10 and any(map(looks_like_code, lines)):
            return False
        return sum(map(looks_like_url_or_path, lines[:10])) >= min(5, n // 2)
    return n > 5 and sum(map(looks_like_url_or_path, lines[:5])) >= min(3, n // 2)


@dataclass
class Inputs:
    """Inputs by kind. ``missing`` are arguments that are neither URLs nor there."""

    urls: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def categorize(items: Iterable[str]) -> Inputs:
    """Split inputs: http(s) URLs, existing paths, other URLs (taken as https hosts), and the rest as local names."""
    out = Inputs()
    for item in map(str.strip, items):
        if not item:
            continue
        parts = urlsplit(item)
        if item.startswith(("http://", "https://")):
            out.urls.append(item)
        elif os.path.isdir(item):
            out.folders.append(item)
        elif os.path.exists(item):
            out.files.append(item)
        elif parts.scheme and parts.netloc:
            out.urls.append(f"https://{item}")
        else:
            out.files.append(item)
    return out


def collect_inputs(targets: Iterable[str] = (), input_file: str | None = None) -> Inputs:
    """Resolve arguments, then ``input_file``. A missing argument is noted and passed over; a missing input file raises.

    A file that is a list contributes its lines, any other file itself. Paths are absolute, distinct and sorted.
    """
    out, queue = Inputs(), list(targets)
    if input_file is not None:
        if not os.path.exists(input_file):
            raise FileNotFoundError(input_file)
        queue.append(input_file)
    if not queue:
        raise ValueError("give at least one target or an input file")
    for target in queue:
        if target.startswith(("http://", "https://")):
            out.urls.append(target)
        elif os.path.isdir(target):
            out.folders.append(os.path.abspath(target))
        elif os.path.isfile(target):
            with open(target, encoding="utf-8", errors="replace") as f:
                text = f.read()
            if is_url_list(target, text):
                more = categorize(x for x in text.split("\n") if not x.strip().startswith("#"))
                out.urls += more.urls
                out.files += map(os.path.abspath, more.files)
                out.folders += map(os.path.abspath, more.folders)
            else:
                out.files.append(os.path.abspath(target))
        else:
            out.missing.append(target)
    out.files, out.folders = sorted(set(out.files)), sorted(set(out.folders))
    out.urls = list(dict.fromkeys(out.urls))
    return out


def has_binary_extension(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(rf"\.(?:{'|'.join(BINARY_EXTENSIONS)})\z"))


def _apart(spark: SparkSession, paths: str | list[str], recursive: bool) -> list[str]:
    """``paths`` with patterns resolved, each once and none inside another, so that a listing gives no file twice."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        target = hadoop.Path(path)
        held = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
        found += [s.getPath().toString() for s in held] if held else [path]
    names = sorted({x.rstrip("/") for x in found})
    inside = (lambda x, y: x.startswith(f"{y}/")) if recursive else (lambda x, y: x.rpartition("/")[0] == y)
    return [x for x in names if not any(inside(x, y) for y in names)]


def read_files(spark: SparkSession, paths: str | list[str], max_mb: float = 0, recursive: bool = True) -> DataFrame:
    """``source_url, content, size_bytes`` of the text files under ``paths``.

    The size limit is a predicate on ``length`` and is pushed to the file listing, so a
    larger file is never read. Paths given twice, or inside another, count once; that is
    settled before anything is read, so no content is shuffled. Binary files, by ending
    or by their first 512 bytes, are left out, and empty ones may be: they hold nothing.
    0 or less means no limit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(_apart(spark, paths, recursive))
    if max_mb > 0:
        files = files.where(F.col("length") <= int(max_mb * 1024 * 1024))
    text = files.where(~has_binary_extension(F.col("path")) & ~is_binary(F.col("content")))
    bare = F.regexp_replace("path", r"^file:/*", "/")
    return text.select(F.concat(F.lit("file://"), bare).alias("source_url"), F.col("content").cast("string").alias("content"), F.col("length").alias("size_bytes"))


def url_or_path(line: Column) -> Column:
    """``looks_like_url_or_path`` of a column."""
    parts = F.split(line, r"\.", -1)
    dotted = (F.size(parts) >= 2) & ~F.rlike(line, F.lit(r"[\t\n\x0B\f\r \x85\xA0]")) & (F.octet_length(F.element_at(parts, -1)) >= 2)
    return any_in(line, ["/", "\\"]) | dotted


def code_line(line: Column) -> Column:
    """``looks_like_code`` of a column."""
    return any_in(line, CODE_MARKS)


def url_list(name: Column, text: Column) -> Column:
    """``is_url_list`` of columns: a file's name and its text."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\A[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+\z", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    ending = F.lower(F.regexp_extract(name, r"(\.[^./]*)\z", 1))
    like = lambda k: F.size(F.filter(F.slice(lines, 1, k), url_or_path))
    n = F.size(lines)
    plain = F.when((n < 10) & F.exists(lines, code_line), False).otherwise(like(10) >= F.least(F.lit(5), F.floor(n / 2)))
    other = (n > 5) & (like(5) >= F.least(F.lit(3), F.floor(n / 2)))
    return F.when((n == 0) | ending.isin(CONTENT_EXTENSIONS), False).when(ending.isin(LIST_EXTENSIONS), True).when(ending == ".txt", plain).otherwise(other)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text file, without blanks and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).where((line != "") & ~F.startswith(line, F.lit("#")))


def from_map(spark: SparkSession, contents: dict[str, str]) -> DataFrame:
    """Texts by their source, as a table to scan."""
    return spark.createDataFrame(list(contents.items()), "source_url string, content string").withColumn("size_bytes", F.octet_length("content").cast("long"))


def response_content(responses: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Fetched responses (``url, status, content_type, body``) as texts.

    Statuses outside 2xx give no row. A 2xx response of another type than the allowed
    ones keeps its row with empty content, unless its type is missing or its path ends
    in ``.js``.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    fine = (kind == "") | any_in(kind, allowed or ALLOWED_TYPES)
    script = F.endswith(F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))), F.lit(".js"))
    return responses.where(F.col("status").between(200, 299)).select(F.col("url").alias("source_url"), F.when(fine | script, F.col("body")).otherwise("").alias("content"))


def pages_as_content(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").alias("source_url"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("size_bytes"))

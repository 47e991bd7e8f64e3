"""Source trees: which files to read, and their text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import language_of
from skein.operators.predicates import MIGRATION_MARKERS, MIGRATION_PAIR, TEST_CODE, TEST_FILES, TEST_FOLDERS, TEST_PACKAGES, TEST_PROJECTS, anti_prefix, ilike_any
from skein.sources.folders import glob, qualified, text_of

#: Folders to pass over, extensions to read, and the size from which files are left out.
IGNORED = (".git", "bin", "obj", "node_modules", "dist", "coverage", "packages", ".idea", ".vs", ".vscode")
EXTENSIONS = (".cs", ".csproj", ".sln", ".sql", ".json", ".md", ".yml", ".yaml", ".config", ".props", ".targets", ".razor", ".cshtml")
BIGGEST = 512_000


def wanted_paths(files: DataFrame, ignored: Sequence[str] = IGNORED, extensions: Sequence[str] = EXTENSIONS, biggest: int = BIGGEST) -> DataFrame:
    """Of files (path, length, ...) those in no ignored folder, of a known extension and small enough."""
    parts = F.split(F.lower("path"), "/")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, ignored))) & ext.isin(*extensions) & (F.col("length") < biggest))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, length, language, content of the files under root worth reading; in a git repository, those alone that its
    ignore rules let through. Names are judged first, from a listing that reads no content; contents are then read by
    folder, of files of a known extension and small enough, in folders where a file is left."""
    base = qualified(spark, root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(escaped(root)).select("path", "length")
    named = listed.select(F.col("path").alias("at"), F.substring("path", len(base) + 2, 1 << 20).alias("path"), "length")
    kept = wanted_paths(named)
    if glob(spark, f"{escaped(root)}/.git"):
        depth = kept.agg(F.max(F.size(F.split("path", "/")))).head()[0] or 0
        kept = not_ignored(kept, ignore_rules(spark, root, depth))
    folders = [r[0] for r in kept.select(F.regexp_replace("at", "/[^/]*$", "")).distinct().collect()]  # fewer than the files that Spark's own index lists
    if not folders:
        return spark.createDataFrame([], "path string, length long, language string, content string")
    ends = ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in EXTENSIONS)
    source = spark.read.format("binaryFile").load([f"{escaped(folder)}/*.{{{ends}}}" for folder in folders])
    files = source.filter(F.col("length") < BIGGEST).select("path", "length", "content").join(kept.select(F.col("at").alias("path")), "path", "left_semi")
    text = files.select("path", "length", language_of(F.col("path")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    fit = anti_prefix(text, test_folders(text), "path", "folder")
    code = F.col("language") == "csharp"
    pair = F.col("content").ilike(f"%{MIGRATION_PAIR[0]}%") & F.col("content").ilike(f"%{MIGRATION_PAIR[1]}%")
    slashed = F.lower("path")
    test = ilike_any(F.col("content"), [*TEST_PACKAGES, *TEST_CODE]) | ilike_any(slashed, [f"%{f}%" for f in TEST_FOLDERS]) | slashed.rlike(TEST_FILES)
    return fit.filter(~(code & (ilike_any(F.col("content"), MIGRATION_MARKERS) | pair | test)))


def test_folders(files: DataFrame) -> DataFrame:
    """folder of each project file that is a test project, by its name or its text."""
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    told = ilike_any(F.col("content"), TEST_PACKAGES) | name.rlike(TEST_PROJECTS[0]) | name.rlike(TEST_PROJECTS[1])
    return files.filter(F.lower("path").endswith(".csproj") & told).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


def escaped(path: str) -> str:
    """The path as a pattern that matches it alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def ignore_rules(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """The lines of the ignore files in so many levels of folders, and of the repository's own: folder (relative to root),
    line, number. The repository's own come before all others. Spark's readers pass over names that begin with a dot, so
    these few small files are read by name."""
    base, here = qualified(spark, root), escaped(root)
    lines = []
    for name in (f"{base}/.git/info/exclude", *(p for k in range(depth) for p in glob(spark, f"{here}{'/*' * k}/.gitignore"))):
        own = name.endswith("/.git/info/exclude")
        if own and not glob(spark, f"{here}/.git/info/exclude"):
            continue
        folder = "" if own else name[len(base) + 1 :].rpartition("/")[0]
        lines += [(folder, line, n - (1 << 30) * own) for n, line in enumerate(text_of(spark, name).splitlines())]
    return spark.createDataFrame(lines, "folder string, line string, number int")


def ignore_regex(pattern: Column) -> Column:
    """A pattern of an ignore file (without ! and the last slash) as a regular expression for paths relative to its folder.
    Bracketed classes may hold letters, digits, dots, underscores and the ranges a-z, A-Z, 0-9; any other bracket, and a
    character after a backslash that is none of * and ?, stands for itself."""
    steps = [
        (r"\\(.)", "$1"), (r"^/", ""),
        (r"\[(!?(?:a-z|A-Z|0-9|[A-Za-z0-9_.])+)\]", "\x03$1\x04"),
        (r"([.+(){}^$|\[\]\\])", r"\\$1"),
        ("\x03!", "[^"), ("\x03", "["), ("\x04", "]"),
        (r"(^|/)\*\*/", "$1\x01"), (r"/\*\*$", "/\x02"), (r"\*+", "[^/]*"), (r"\?", "[^/]"),
        ("\x01", "(?:.*/)\x05"), ("\x02", ".+"), ("\x05", "?"),
    ]
    out = pattern
    for old, put in steps:
        out = F.regexp_replace(out, F.lit(old), F.lit(put))
    return F.concat(F.lit("^"), F.when(pattern.contains("/"), "").otherwise("(?:.*/)?"), out, F.lit("$"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files (path, ...) that no rule (folder, line, number) ignores. A file or folder is ignored if the last rule that
    fits it, of the deepest folder that has one, isn't negated; so is all that lies in an ignored folder. Every folder is
    judged once, by rules of the folders above it alone."""
    told = F.regexp_replace("line", r"(?<!\\)\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(told, "^!", ""), "/$", "")
    lines = rules.filter(~told.rlike("^#|^!?/?$"))
    ready = lines.select(F.col("folder").alias("base"), "number", told.startswith("!").alias("negated"), told.endswith("/").alias("folders_only"), ignore_regex(plain).alias("regex"))
    parts = F.split("path", "/")
    above = lambda first, last: F.transform(F.sequence(F.lit(first), last), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nodes = files.select("path", F.posexplode(above(1, F.size(parts))).alias("k", "node"), F.size(parts).alias("depth")).select("node", (F.col("k") + 1 < F.col("depth")).alias("is_folder")).distinct()
    parts = F.split("node", "/")
    under = nodes.select("node", "is_folder", F.explode(above(0, F.size(parts) - 1)).alias("base")).join(ready, "base")
    rest = F.when(F.col("base") == "", F.col("node")).otherwise(F.expr("substring(node, length(base) + 2)"))
    fits = under.filter((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(rest, F.col("regex")))
    last = fits.groupBy("node").agg(F.max_by("negated", F.struct(F.length("base"), "number")).alias("negated"))
    return anti_prefix(files, last.filter("NOT negated").select(F.col("node").alias("folder")), "path", "folder")

"""Row and file predicates. Word lists are parameters; the defaults are fixed values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import any_of

#: A plan lists so many lengths of names at most; for more, all beginnings or endings are tried.
LENGTHS = 1000
#: Patterns of rule and knowledge candidates.
RULE_CONTENT = (
    "throw new", "BusinessException", "ValidationException", "não pode", "nao pode", "deve", "obrigatório", "obrigatorio", "inválido", "invalido", "ErroContext", "ErrosContext", "ErroBase", "AdicionarErro", "AdicionaErro", "AddErro",
    "AddError", "AddFailure", "AddNotification", "Notificar", "Notification", "TemErro", "HasError", "IsValid", "Validate", "Validator", "RuleFor", "Elegivel", "Elegível", "Permite", "Bloqueado", "Cancelado", "Vencido",
)
KNOWLEDGE_PATHS = ("%.csproj", "%Program.cs", "%Startup.cs", "%appsettings%")
KNOWLEDGE_CONTENT = ("HttpClient", "MassTransit", "RabbitMQ", "Kafka", "MediatR", "EntityFramework", "TODO", "FIXME", "HACK")
SEMANTIC_PATHS = ("handler", "service", "application", "domain", "usecase", "use_case", "policy", "policies", "specification", "specifications", "query")
SEMANTIC_SYMBOLS = ("handler", "service", "application", "domain", "usecase", "policy", "specification", "validar", "validate", "pode", "permite", "elegiv", "cancel", "aprova", "bloque", "venc")
NOT_FOLDERS = ("constants", "constant", "mappings", "mapping", "entitiemappings", "configurations", "configuration", "options")
NOT_FILES = ("%dto.cs", "%request.cs", "%response.cs", "%viewmodel.cs")
NOT_CONTENT = ("IEntityTypeConfiguration<", "EntityTypeBuilder<")
#: Markers of database migrations and of tests.
MIGRATION_MARKERS = (": Migration", ":Migration", ": ModelSnapshot", ":ModelSnapshot", "MigrationBuilder", "BuildTargetModel", "[Migration(")
MIGRATION_PAIR = ("[DbContext(", "ProductVersion")
TEST_PACKAGES = (
    "<IsTestProject>true</IsTestProject>", "Microsoft.NET.Test.Sdk", "MSTest.Sdk", "MSTest.TestFramework", "coverlet.collector", 'PackageReference Include="xunit"', "PackageReference Include='xunit'", 'PackageReference Include="NUnit"',
    "PackageReference Include='NUnit'",
)
TEST_CODE = ("using Xunit", "using NUnit.Framework", "Microsoft.VisualStudio.TestTools.UnitTesting", "[Fact", "[Theory", "[Test", "[TestCase", "[TestMethod", "[TestClass", "[TestFixture", "[SetUp", "[OneTimeSetUp", "[TearDown", "[OneTimeTearDown")
TEST_PROJECTS = (r"(?i)(^|[._-])(test|tests|unittests|integrationtests|functionaltests|acceptancetests|spec|specs)([._-]|$)", r"(?i)(tests|specs)$")
TEST_FOLDERS = ("/test/", "/tests/", "/unittests/", "/unit.tests/", "/integrationtests/", "/integration.tests/", "/functionaltests/", "/functional.tests/", "/acceptancetests/", "/acceptance.tests/", "/spec/", "/specs/", ".tests/", ".specs/")
TEST_FILES = r"(?i)(tests|specs)\.cs$"


def like_pattern(text: str) -> str:
    """A contains-pattern, unless the text is a pattern already; a lone escape is literal."""
    out, k = "", 0
    while k < len(text):
        if text[k] == "\\":
            out += text[k : k + 2] if text[k + 1 : k + 2] in ("%", "_", "\\") else "\\\\"
            k += 2 if text[k + 1 : k + 2] in ("%", "_", "\\") else 1
        else:
            out += text[k]
            k += 1
    return out if "%" in out else f"%{out}%"


def ilike_any(column: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern fits, whatever case; null for a null column, as in SQL; false for no patterns. Patterns that
    only ask for a text within are looked for in one pass."""
    plain = [p.strip("%") for p in patterns if not set(p.strip("%")) & set("%_\\") and (p == p.strip("%") or p[:1] == p[-1:] == "%")]
    rest = [p for p in patterns if p.strip("%") not in plain]
    found = [F.lower(column).rlike(any_of(plain))] if plain else []
    return reduce(lambda a, b: a | b, [*found, *(column.ilike(like_pattern(p)) for p in rest)], F.lit(False)) if patterns else F.lit(False)


def suffix_match(column: Column, suffix: str) -> Column:
    """Equal, or ending in the suffix; % and _ in it are wildcards."""
    return (column == suffix) | column.ilike("%" + like_pattern("%" + suffix)[1:])


def multi_contains(columns: Sequence[Column], text: str | None) -> Column:
    """Whether any column contains the text; all rows if there is none."""
    if not (text or "").strip():
        return F.lit(True)
    return reduce(lambda a, b: a | b, (c.ilike(f"%{like_pattern('%' + text.strip())[1:]}%") for c in columns))


def rule_candidate(words: Sequence[str] = RULE_CONTENT) -> Column:
    return ilike_any(F.col("content"), words)


def knowledge_candidate(paths: Sequence[str] = KNOWLEDGE_PATHS, words: Sequence[str] = KNOWLEDGE_CONTENT) -> Column:
    return ilike_any(F.col("file_path"), paths) | ilike_any(F.col("content"), words)


def semantic_candidate(words: Sequence[str] = RULE_CONTENT, paths: Sequence[str] = SEMANTIC_PATHS, symbols: Sequence[str] = SEMANTIC_SYMBOLS, folders: Sequence[str] = NOT_FOLDERS, files: Sequence[str] = NOT_FILES) -> Column:
    wanted = rule_candidate(words) | ilike_any(F.col("file_path"), paths) | ilike_any(F.col("symbol_name"), symbols)
    slashed = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    typed = (F.col("chunk_type") == "type") & F.col("content").ilike("% interface %")
    unwanted = ilike_any(slashed, [f"%/{f}/%" for f in folders]) | ilike_any(F.col("file_path"), files) | ilike_any(F.col("content"), NOT_CONTENT) | typed
    return wanted & ~unwanted


def migration_marker(language: str = "csharp", markers: Sequence[str] = MIGRATION_MARKERS) -> Column:
    pair = reduce(lambda a, b: a & b, (F.col("content").ilike(f"%{m}%") for m in MIGRATION_PAIR))
    return (F.col("language") == language) & (ilike_any(F.col("content"), markers) | pair)


def test_marker(language: str = "csharp", packages: Sequence[str] = TEST_PACKAGES, code: Sequence[str] = TEST_CODE) -> Column:
    return ilike_any(F.col("content"), packages) | ((F.col("language") == language) & ilike_any(F.col("content"), code))


def test_path(project: Column, path: Column) -> Column:
    """Whether the names alone tell a test."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, [*(project.rlike(r) for r in TEST_PROJECTS), ilike_any(slashed, [f"%{f}%" for f in TEST_FOLDERS]), slashed.rlike(TEST_FILES)])


FILE = ["project_id", "file_path"]


def marked_files(chunks: DataFrame, marker: Column) -> DataFrame:
    """The files of which any chunk has the marker."""
    return chunks.filter(marker).select(*FILE).distinct()


def with_marker(chunks: DataFrame, marker: Column) -> DataFrame:
    return chunks.join(marked_files(chunks, marker), FILE, "left_semi")


def without_marker(chunks: DataFrame, marker: Column) -> DataFrame:
    return chunks.join(marked_files(chunks, marker), FILE, "left_anti")


def test_files(chunks: DataFrame, projects: DataFrame, marker: Column | None = None) -> DataFrame:
    """The distinct files that are tests by name or by content."""
    told = chunks.select(*FILE).distinct().join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").filter(test_path(F.col("project"), F.col("file_path"))).select(*FILE)
    return told.unionByName(marked_files(chunks, test_marker() if marker is None else marker)).distinct()


def unfit_files(chunks: DataFrame, projects: DataFrame, migration: Column | None = None, test: Column | None = None) -> DataFrame:
    """Files that are migrations or tests."""
    return marked_files(chunks, migration_marker() if migration is None else migration).unionByName(test_files(chunks, projects, test)).distinct()


def indexable(chunks: DataFrame, projects: DataFrame, migration: Column | None = None, test: Column | None = None) -> DataFrame:
    """Chunks of files that are neither migrations nor tests."""
    return chunks.join(unfit_files(chunks, projects, migration, test), FILE, "left_anti")


def anti_prefix(files: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """Files under none of the folders: each path is joined by its own prefixes, so no pair is tried in vain."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = files.select(path, F.explode(above).alias(folder)).join(folders.select(folder).distinct(), folder, "left_semi").select(path).distinct()
    return files.join(hit, path, "left_anti")


def few_lengths(names: DataFrame, name: str) -> list[int] | None:
    """The distinct lengths of the names; None if there are more than LENGTHS."""
    found = names.select(F.length(name).alias("n")).filter("n IS NOT NULL").distinct().limit(LENGTHS + 1).collect()
    return None if len(found) > LENGTHS else sorted(r["n"] for r in found)


def prefix_assign(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the first root (by position) that is a prefix of it, on the same terms."""
    low, own = F.lower(F.col(path)), roots.select(F.lower(root).alias("key"), root, "position")
    lengths = few_lengths(own, "key")
    parts = F.transform(F.sequence(F.lit(0), F.length(low)), lambda n: F.left(low, n)) if lengths is None else F.array(*(F.left(low, F.lit(n)) for n in lengths))
    spread = files.select(path, F.explode(F.array_distinct(parts)).alias("key"))
    best = spread.join(own, "key").groupBy(path).agg(F.min_by(root, "position").alias(root))
    return files.join(best, path, "left").select(path, root)

"""Which files of a tree are read, and which its ignore rules leave out."""

import shutil
import subprocess

import pytest

from skein.sources import files

RULES = {
    "": "# notes\n*.log\n/build/\nout\n!keep.log\ndocs/**/draft.md\n[Dd]ebug/\n\\#odd\nx?z.cs\ntail/**\n**/deep/a.cs\n  \n!/\na+b(.cs\n[q\n",
    "sub": "!*.log\n/only.cs\nbuild/\n",
}
PATHS = [
    "a.log", "keep.log", "build/x.cs", "sub/build/x.cs", "other/build/x.cs", "out", "k/out/y.cs", "k/outer/y.cs", "docs/draft.md", "docs/a/b/draft.md", "docs/final.md", "Debug/q.cs", "k/debug/q.cs",
    "#odd", "xyz.cs", "xz.cs", "tail/a/b.cs", "tail.cs", "p/q/deep/a.cs", "deep/a.cs", "sub/b.log", "sub/c/b.log", "sub/only.cs", "sub/c/only.cs", "build/keep.log", "a+b(.cs", "aab(.cs", "[q", "z/debug", "plain.cs",
]


def kept(spark, paths, rules):
    lines = [(folder, line, n) for folder, text in rules.items() for n, line in enumerate(text.split("\n"))]
    told = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r["path"] for r in files.not_ignored(told, spark.createDataFrame(lines, "folder string, line string, number int")).collect()}


def test_ignore_rules(spark):
    gone = {"a.log", "build/x.cs", "sub/build/x.cs", "out", "k/out/y.cs", "docs/draft.md", "docs/a/b/draft.md", "Debug/q.cs", "k/debug/q.cs", "#odd", "xyz.cs", "tail/a/b.cs", "p/q/deep/a.cs", "deep/a.cs", "sub/only.cs", "build/keep.log", "a+b(.cs", "[q"}
    assert set(PATHS) - kept(spark, PATHS, RULES) == gone
    assert kept(spark, PATHS, {"": ""}) == set(PATHS) and kept(spark, [], RULES) == set()


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_ignore_rules_as_git_has_them(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for folder, text in RULES.items():
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text(text.replace("[q\n", ""))
    paths = [p for p in PATHS if p != "out"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    told = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, text=True, check=True).stdout
    rules = files.ignore_rules(spark, str(tmp_path), 4)
    found = {r["path"] for r in files.not_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert found == {p for p in told.split("\0") if p and not p.endswith(".gitignore")}


def test_no_content_of_an_ignored_folder_is_read(spark, tmp_path, monkeypatch):
    root = tmp_path / "my {tree} [1]"
    for name, text in {".git/info/exclude": "own.cs\n", ".gitignore": "gen/\n*.sql\n!good.sql\n", "a/A.CS": "class A { }", "a/own.cs": "class O { }", "gen/B.cs": "class B { }", "bin/C.cs": "class C { }", "a/obj/D.cs": "class D { }", "x.sql": "s", "good.sql": "s", "big.md": "x" * 512_000, "small.md": "y" * 511_999}.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    found = files.read_tree(spark, str(root))
    assert {r["path"].rsplit("/", 1)[1] for r in found.collect()} == {"A.CS", "good.sql", "small.md"}
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert any("content#" in x for x in scans) and all("LessThan(length,512000)" in x for x in scans if "content#" in x)
    loaded = []
    real = type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda self, path=None, *a, **k: (loaded.append(path), real(self, path, *a, **k))[1])
    files.read_tree(spark, str(root))
    assert {p.rsplit("/", 2)[1].replace("\\", "") for p in loaded[-1]} == {"a", "my {tree} [1]"}  # no content of bin, gen or obj
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.txt").write_text("x")
    assert files.read_tree(spark, str(tmp_path / "none")).count() == 0

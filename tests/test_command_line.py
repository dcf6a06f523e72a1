import json
import subprocess

import pytest

from lodestone import __main__ as cli


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, body in {"src/a.ts": "import { b } from './b';\nexport function main() { b(); }\n", "src/b.ts": "export function b() {}\n", "README.md": "# T\n## Usage\nrun it\n", "pyproject.toml": ""}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    (root / "src/b.ts").write_text("export function b() { token(); }\n")
    return root, tmp_path_factory.mktemp("store")


def run(spark, capsys, repo, *arguments):
    assert cli.main([*arguments, "--root", str(repo[0]), "--store", str(repo[1])]) == 0
    out = capsys.readouterr().out
    return [json.loads(line) for line in out.splitlines()] if out.startswith("{") else out.strip()


def test_commands(spark, capsys, repo):
    do = lambda *a: run(spark, capsys, repo, *a)
    assert do("detect") == "python" and do("status")[0]["exists"] is False
    assert do("refresh")[0]["file_count"] == 4 and do("status")[0]["exists"] is True
    assert do("graph-build")[0]["node_count"] == 6
    assert [r["target"] for r in do("query-graph", "main", "--pattern", "callees_of")] == ["src/b.ts::b"]
    assert {r["file_path"] for r in do("impact-radius")} == {"src/a.ts", "src/b.ts"}
    assert {r["file_path"]: r["depth"] for r in do("reverse-imports", "--changed", "src/b.ts")} == {"src/a.ts": 1, "src/b.ts": 0}
    assert do("detect-changes")[0]["security_hits"] == 1 and do("minimal-context")[0]["changed_files"] == 1
    assert do("list-flows")[0]["entry"] == "src/a.ts::main" and do("get-flow", "main")[0]["nodes"] == ["src/a.ts::main", "src/b.ts::b"]
    assert do("affected-flows")[0]["name"] == "flow:main"
    assert {r["name"] for r in do("list-communities")} == {"src", "README.md", "pyproject.toml"} and do("get-community", "src")[0]["node_count"] == 4
    assert do("architecture-overview")[0]["warning"].startswith("No major") and len(do("review-context")) == 2
    assert do("docs-section") == "## Usage\nrun it" and do("prompt").startswith("[snapshot]") and "debug_issue" in do("prompts")
    assert do("graph-postprocess")[0] == {"flows": 1, "communities": 3}
    lexical = do("semantic-search", "main", "--limit", "5")
    assert [(r["qualified_name"], r["score"]) for r in lexical] == [("src/a.ts::main", 1.0)]  # no vectors yet
    assert do("embed-graph")[0]["count"] == 2 and do("embed-graph")[0]["count"] == 2
    hybrid = do("semantic-search", "main", "--limit", "5")
    assert hybrid[0]["qualified_name"] == "src/a.ts::main" and len(hybrid) == 2 and hybrid[0]["score"] < 0.1
    assert do("query-symbol", "main")[0]["definitions"] == 1 and do("refactor-preview", "main")[0]["line"] == 2
    assert do("generate-wiki") == "3" and do("get-wiki-page", "src").startswith("# src")
    assert do("registry-add", "one")[0]["alias"] == "one" and do("registry-list")[0]["node_count"] == 6
    assert do("cross-repo-search", "main")[0]["repo_alias"] == "one" and len(do("cross-repo-impact")) == 2
    assert do("registry-remove", "one") == "" and do("find-large-functions", "--min-lines", "1")
    assert do("refactor-apply", "main", "start") == "1" and "function start()" in (repo[0] / "src/a.ts").read_text()
    assert do("init") == "python" and json.loads((repo[0] / ".lodestone.json").read_text())["preset"] == "python"

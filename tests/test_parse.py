from lodestone.operators import build, parse

PY = '''import os
from .util import helper
from pkg import thing

class Base:
    def run(self):
        helper()
        self.stop()

class Child(Base):
    def stop(self):
        def inner():
            os.getcwd()
        return inner()

def main():
    Child().run()
'''
TS = '''import { a } from './a';
import './side';
const lazy = require("../lazy");
export class Cat extends Animal implements Pet {
  private name: string = "x {";
  speak(loud: boolean): void {
    if (loud) { this.roar(); }
    helper(1);
  }
}
export async function go(x: number) { // { comment
  const inner = (y: number) => { return twice(y); };
  return new Cat(inner(x));
}
'''
RS = '''use crate::graph::query;
struct Point { x: i32 }
impl Display for Point {
    fn show(&self) -> String { format!("{}", self.x) }
}
pub fn main() { let p = make(); p.show(); }
'''
GO = 'package main\nimport (\n  "fmt"\n  "os"\n)\ntype Box struct { v int }\nfunc (b *Box) Put(v int) { fmt.Println(v) }\nfunc main() { run() }\n'
JAVA = 'import java.util.List;\npublic class Dog extends Animal {\n  public Dog() { super(); }\n  public void bark(int n) throws Exception {\n    voice.play(n);\n  }\n}\n'
CPP = '#include <vector>\n#include "own.h"\nclass Shape : public Base {\n  int area() { return side(); }\n};\nint main(int argc) { Shape s; s.area(); return 0; }\n'
CS = 'using System.Text;\nclass A : B {\n  public int Go() { return Run(); }\n}\n'
RB = "require 'json'\nclass Foo < Bar\n  def go(x)\n    if x\n      run(x)\n    end\n  end\nend\ndef top\n  Foo.new\nend\n"


def facts(path, source):
    rows = parse.parse_source(path, source)
    symbols = [(r["kind"], r["qualified_name"], r["line_start"], r["line_end"]) for r in rows if r["rec"] == "symbol"]
    return symbols, [r["target_name"] for r in rows if r["rec"] == "import"], [(r["kind"], r["source"], r["target_name"]) for r in rows if r["rec"] == "reference"]


def test_python():
    symbols, imports, references = facts("m.py", PY)
    assert symbols == [("class", "m.py::Base", 5, 8), ("function", "m.py::Base.run", 6, 8), ("class", "m.py::Child", 10, 14), ("function", "m.py::Child.stop", 11, 14), ("function", "m.py::Child.inner", 12, 13), ("function", "m.py::main", 16, 17)]
    assert imports == ["os", ".util", "pkg"]
    assert ("inherits", "m.py::Child", "Base") in references
    assert {("calls", "m.py::Base.run", "helper"), ("calls", "m.py::Base.run", "stop"), ("calls", "m.py::Child.inner", "getcwd"), ("calls", "m.py::Child.stop", "inner"), ("calls", "m.py::main", "run"), ("calls", "m.py::main", "Child")} <= set(references)


def test_typescript():
    symbols, imports, references = facts("c.ts", TS)
    assert symbols == [("class", "c.ts::Cat", 4, 10), ("function", "c.ts::Cat.speak", 6, 9), ("function", "c.ts::go", 11, 14), ("function", "c.ts::inner", 12, 12)]
    assert imports == ["./a", "./side", "../lazy"]
    assert {("inherits", "c.ts::Cat", "Animal"), ("inherits", "c.ts::Cat", "Pet"), ("calls", "c.ts::Cat.speak", "roar"), ("calls", "c.ts::Cat.speak", "helper"), ("calls", "c.ts::inner", "twice"), ("calls", "c.ts::go", "Cat"), ("calls", "c.ts::go", "inner")} == set(references)


def test_rust_go():
    symbols, imports, references = facts("p.rs", RS)
    assert [s[:2] for s in symbols] == [("class", "p.rs::Point"), ("class", "p.rs::Point"), ("function", "p.rs::Point.show"), ("function", "p.rs::main")]
    assert imports == ["crate::graph::query"]
    assert {("calls", "p.rs::Point.show", "format"), ("calls", "p.rs::main", "make"), ("calls", "p.rs::main", "show")} == set(references)
    symbols, imports, references = facts("b.go", GO)
    assert [s[:2] for s in symbols] == [("class", "b.go::Box"), ("function", "b.go::Put"), ("function", "b.go::main")]
    assert imports == ["fmt", "os"]
    assert {("calls", "b.go::Put", "Println"), ("calls", "b.go::main", "run")} == set(references)


def test_braces_with_types():
    symbols, imports, references = facts("D.java", JAVA)
    assert [s[:2] for s in symbols] == [("class", "D.java::Dog"), ("function", "D.java::Dog.Dog"), ("function", "D.java::Dog.bark")]
    assert imports == ["java.util.List"] and ("inherits", "D.java::Dog", "Animal") in references and ("calls", "D.java::Dog.bark", "play") in references
    symbols, imports, references = facts("s.cpp", CPP)
    assert [s[:2] for s in symbols] == [("class", "s.cpp::Shape"), ("function", "s.cpp::Shape.area"), ("function", "s.cpp::main")]
    assert imports == ["vector", "own.h"] and ("inherits", "s.cpp::Shape", "Base") in references and ("calls", "s.cpp::Shape.area", "side") in references
    symbols, imports, references = facts("a.cs", CS)
    assert [s[:2] for s in symbols] == [("class", "a.cs::A"), ("function", "a.cs::A.Go")] and imports == ["System.Text"]
    assert set(references) == {("inherits", "a.cs::A", "B"), ("calls", "a.cs::A.Go", "Run")}


def test_ruby():
    symbols, imports, references = facts("f.rb", RB)
    assert symbols == [("class", "f.rb::Foo", 2, 8), ("function", "f.rb::Foo.go", 3, 7), ("function", "f.rb::top", 9, 11)]
    assert imports == ["json"] and set(references) == {("inherits", "f.rb::Foo", "Bar"), ("calls", "f.rb::Foo.go", "run"), ("calls", "f.rb::top", "new")}


def test_broken_and_odd_sources():
    assert facts("x.py", "def ok(:\n  pass\nclass Y\n")[0] == [("function", "x.py::ok", 1, 1), ("class", "x.py::Y", 1, 1)]
    assert facts("x.kt", "class K\n")[0] == [("class", "x.kt::K", 1, 1)]
    for path in ("e.py", "e.ts", "e.rs", "e.rb", "e.vue", "e.ipynb", "e"):
        assert facts(path, "") == ([], [], [])
    for path in ("e.ts", "e.java", "e.go", "e.rs", "e.cpp", "e.rb", "e.cs"):  # never hangs, never fails
        for source in ("(((", "}}}{{{", "class", "fn (", "import", "const x = (", "def", "func (", "class A {", "impl<", "use "):
            facts(path, source)


def test_normalisers():
    assert parse.normalize_source("a.vue", '<template/><script lang="ts">let a</script><script>b()</script>') == ("let a\nb()\n", "typescript")
    assert parse.normalize_source("a.vue", "<p>") == ("<p>", "vue")
    book = '{"metadata": {"language_info": {"name": "python"}}, "cells": [{"cell_type": "code", "source": ["def f():\\n", "  pass"]}, {"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": "g()"}]}'
    assert parse.normalize_source("a.ipynb", book) == ("def f():\n  pass\ng()\n", "python")
    assert parse.normalize_source("a.ipynb", "{") == ("{", "notebook")
    assert facts("a.ipynb", book)[0][0][:2] == ("function", "a.ipynb::f")
    assert parse.normalize_source("a.py", "a\n# COMMAND ----------\nb")[0] == "a\n\n\nb"


def test_patterns_in_the_jvm_agree(spark):
    sources = [("a.ts", TS), ("b.py", PY), ("c.rs", RS), ("d.js", 'const f = async (a) => 1;\nlet q = require("x")\nimport z from "z"\n'), ("e.txt", ""), ("n.ts", None)]
    files = spark.createDataFrame(sources, "path string, content string")
    want_symbols, want_imports = set(), set()
    for path, content in sources:
        if content is not None:
            own = parse._Facts(path, parse.language_name(path))
            parse._parse_by_pattern(content, own)
            want_symbols |= {(path, r["kind"], r["qualified_name"], r["language"]) for r in own.rows if r["rec"] == "symbol"}
            want_imports |= {(path, r["target_name"]) for r in own.rows if r["rec"] == "import"}
    got = {(r.file_path, r.kind, r.qualified_name, r.language) for r in parse.fallback_symbols(files).collect()}
    assert got == want_symbols and len(got) > 8
    assert {tuple(r) for r in parse.fallback_imports(files).collect()} == want_imports


FILES = [
    ("app/main.ts", "h1", "import { go } from './lib/util';\nimport x from '../app/lib';\nexport function main() { go(); helper(); missing(); }\n"),
    ("app/lib/util.ts", "h2", "export function go() { return 1; }\nexport function helper() {}\n"),
    ("app/lib/index.ts", "h3", "export class Thing extends Base {}\n"),
    ("app/base.ts", "h4", "export class Base {}\nfunction helper() { go(); }\n"),
    ("pkg/mod.py", "h5", "from .other import f\nimport pkg.deep\ndef g():\n    f()\n"),
    ("pkg/other.py", "h6", "def f(): pass\n"),
    ("pkg/deep/__init__.py", "h7", "\n"),
    ("notes.md", "h8", None),
]


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string, content string")


def test_build(spark):
    nodes, edges, _ = build.build(snapshot(spark, FILES))
    got = {(r.kind, r.source, r.target) for r in edges.filter("kind <> 'contains'").collect()}
    assert got == {
        ("imports_from", "file::app/main.ts", "file::app/lib/util.ts"),
        ("imports_from", "file::app/main.ts", "file::app/lib/index.ts"),
        ("imports_from", "file::pkg/mod.py", "file::pkg/other.py"),
        ("imports_from", "file::pkg/mod.py", "file::pkg/deep/__init__.py"),
        ("inherits", "app/lib/index.ts::Thing", "app/base.ts::Base"),
        ("calls", "app/main.ts::main", "app/lib/util.ts::go"),
        ("calls", "app/main.ts::main", "app/base.ts::helper"),  # the first by path
        ("calls", "app/base.ts::helper", "app/lib/util.ts::go"),
        ("calls", "pkg/mod.py::g", "pkg/other.py::f"),
    }
    assert {(r.qualified_name, r.language, r.line_end) for r in nodes.filter("kind = 'file'").collect()} >= {("file::notes.md", "unknown", 0), ("file::app/main.ts", "typescript", 3)}
    assert edges.filter("kind = 'contains'").count() == nodes.filter("kind <> 'file'").count()


def test_incremental_equals_full(spark):
    before = snapshot(spark, FILES)
    after_rows = [r for r in FILES if r[0] != "app/base.ts"]
    after_rows[1] = ("app/lib/util.ts", "h2b", "export function helper2() {}\nexport function go() {}\n")
    after_rows.append(("app/new.ts", "h9", "import './main';\nfunction late() { main(); }\n"))
    after = snapshot(spark, after_rows)
    full = build.build(after)
    nodes, edges, facts = build.build(before)
    step = build.update(after, build.stored_tables(before, nodes, edges, facts))
    for a, b in zip(full, (step[t] for t in ("nodes", "edges", "facts"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    changed, stale = build.changed_files(after, build.file_index(before))
    assert {r.path for r in changed.collect()} == {"app/lib/util.ts", "app/new.ts"} and [r.file_path for r in stale.collect()] == ["app/base.ts"]

"""A language added from outside: one function of one text, resolved with all others."""

import re

from pyspark.sql import functions as F

from lodestar.operators.tokens import GO_TOKENS, tokenize
from lodestar.operators import navigate, resolve
from lodestar.plans.indexing import index_files
from lodestar.plans.languages import LANGUAGES, TABLES, Language, read_by


def toy(text):
    """Lines ``rule name``, ``  use name``, ``let name`` and ``load spec as alias``."""
    lines, opened = text.split("\n"), -1
    for n, line in enumerate(lines, 1):
        word = line.split()
        if line.startswith("rule "):
            opened += 1
            end = next((k for k in range(n, len(lines)) if not lines[k].startswith(" ")), len(lines))
            yield "defs", {"name": word[1], "start_line": n, "end_line": end, "signature": line}
        elif line.startswith("  use "):
            yield "refs", {"name": word[1], "line": n, "enclosing": opened}
        elif line.startswith("load "):
            yield "imports", {"spec": word[1], "alias": word[3], "names": {word[3]: word[1]}, "line": n}
        elif re.match(" *let ", line):
            yield "locals", {"name": word[1]}


TOY = Language({".toy": "toy"}, lambda file: F.col(file).contains("_check."), read_by(toy))
FILES = [
    ("r1", "a.toy", "load core as c\nrule one\n  let x\n  let x\n  use two\nrule solo\n"),
    ("r1", "b_check.toy", "rule two\n  use one\n  use missing\n"),
    ("r1", "m.go", "package m\n\nfunc Run() {\n\tsolo()\n}\n"),
    ("r2", "a.toy", ""),
    ("r2", "b.toy", None),
    ("r2", "notes.txt", "rule none"),
]


def test_a_language_of_its_own(spark):
    files = spark.createDataFrame(FILES, "repo string, file string, content string")
    facts = index_files(files, ("repo",), languages=(*LANGUAGES, TOY))
    assert {(r.repo, r.file, r.lang, r.is_test) for r in facts.files.collect()} >= {("r1", "a.toy", "toy", False), ("r1", "b_check.toy", "toy", True), ("r1", "m.go", "go", False)}
    assert facts.files.filter("file = 'notes.txt'").count() == 0
    assert {(r.name, r.pos, r.start_line, r.end_line) for r in facts.defs.filter("file LIKE '%.toy'").collect()} == {("one", 0, 2, 5), ("solo", 1, 6, 6), ("two", 0, 1, 3)}
    assert [(r["name"]) for r in facts.locals.filter("file = 'a.toy'").collect()] == ["x"]
    assert facts.imports.filter("file = 'a.toy'").first().names == {"c": "core"}
    graph = resolve.resolve(facts)
    calls = {(r.src, r.dst) for r in graph.edges.filter("kind = 'calls'").collect()}
    assert ("sym:a.toy#one:function", "sym:b_check.toy#two:function") in calls
    assert ("sym:m.go#Run:function", "sym:a.toy#solo:function") in calls  # names are found over languages
    around = navigate.neighbors(graph).filter("anchor = 'file:a.toy' AND label = 'Defined here'")
    assert {r.node for r in around.collect()} == {"sym:a.toy#one:function", "sym:a.toy#solo:function"}


def test_without_it_such_files_are_left_out(spark):
    files = spark.createDataFrame(FILES[:3], "repo string, file string, content string")
    assert {r.file for r in index_files(files, ("repo",)).files.collect()} == {"m.go"}
    empty = read_by(toy)(files.limit(0), ["repo"])
    assert set(empty) == set(TABLES) and all(t.count() == 0 for t in empty.values())


def test_go_tokens_are_dealt_once(spark, tmp_path):
    """What is read off the written tokens filters them: no exchange before the first filter or aggregate."""
    from lodestar.operators.extract_go import extract_go

    files = spark.createDataFrame([("m.go", "package m\n\nfunc (s *S) Run(a int) {\n\tfor k := range a {\n\t\tsolo(k)\n\t}\n}\n")], "file string, content string")
    facts = extract_go(files)
    plan = facts["locals"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert sorted(r["name"] for r in facts["locals"].collect()) == ["a", "k", "s"]
    assert [(r["name"], r["kind"], r["receiver"]) for r in facts["defs"].collect()] == [("Run", "method", "S")]


def test_tokens_are_scanned_not_sorted(spark):
    """What stands around each token of a file, against a plain reading; files do not run into each other."""
    texts = {"a.go": "// x\nfunc f(a, b int) {\n\tg(h(1)[0]) /* y\n */ }", "b.go": "", "c.go": ") } x ( y", "d.go": "// only", "e.go": None, "f.go": "s := `a\nb` + 'c'"}
    files = spark.createDataFrame(list(texts.items()), "file string, content string")
    tokens = tokenize(files, GO_TOKENS)
    assert not re.search("Window|Sort", tokens._jdf.queryExecution().optimizedPlan().toString())
    got = {}
    for r in sorted(tokens.collect(), key=lambda r: (r.file, r.i)):
        got.setdefault(r.file, []).append(r)
    assert sorted(got) == ["a.go", "c.go", "f.go"]
    assert [r.tok for r in got["a.go"]] == "func f ( a , b int ) { g ( h ( 1 ) [ 0 ] ) }".split()
    assert [r.line for r in got["a.go"]] == [2] * 9 + [3] * 10 + [4] and [r.endl for r in got["f.go"]] == [1, 1, 2, 2, 2]
    for file, rows in got.items():
        depth = {"{}": 0, "()": 0, "[]": 0}
        stack = {}
        for n, r in enumerate(rows):
            assert texts[file][r.off :].startswith(r.tok)
            for k in depth:
                depth[k] -= r.tok == k[1]
            assert [r.d, r.p, r.b] == list(depth.values())
            level = r.p + (r.tok == "(")
            if r.tok == "(":
                stack[level] = n
            opened = rows[stack[level]] if level in stack else None
            assert (r.open_at, r.open_prev1) == ((opened.i, opened.prev1) if opened else (None, None))
            for k in depth:
                depth[k] += r.tok == k[0]
            near = {f"prev{k}": rows[n - k].tok if n >= k else None for k in (1, 2, 3)} | {f"next{k}": rows[n + k].tok if n + k < len(rows) else None for k in (1, 2, 3, 4)}
            assert {c: r[c] for c in near} == near
            assert r.next_cls == (rows[n + 1].cls if n + 1 < len(rows) else None)
            assert r.fol == (n == 0 or rows[n - 1].endl < r.line)

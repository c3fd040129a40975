"""Golden answers over the two fixture repositories, from source text to navigation."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators import navigate, resolve, validate
from lodestar.plans import verification
from lodestar.plans.navigator import Navigator, NullNavigator
from lodestar.sources.files import read_tree
from lodestar.plans.indexing import index_files, reindex
from lodestar.sources import files as listing
from lodestar.session import settle

HERE = os.path.dirname(__file__)
GO = os.path.join(HERE, "fixtures", "go")
TS = os.path.join(HERE, "fixtures", "ts")


def index(spark, root):
    known = settle(read_tree(spark, root, contents=True), "known")
    facts = index_files(known.select("file", "content"), (), listing.go_module(known), None)
    return Navigator(facts, resolve.resolve(facts), known.select("file", "bytes"), None, root)


@pytest.fixture(scope="module")
def go(spark):
    return index(spark, GO)


@pytest.fixture(scope="module")
def ts(spark):
    return index(spark, TS)


def names(df, label=None):
    if label:
        df = df.filter(F.col("label") == label)
    return [r["node"].split("#")[1].rsplit(":", 1)[0] for r in df.orderBy("rank").collect()]


def test_expand_a_handler_file(go):
    groups = go.expand("api/entries.go")
    assert names(groups, "Defined here") == ["addEntry", "listEntries"]
    assert {"DecodeEntry", "WriteProblem", "AddEntry"} <= set(names(groups, "Related code"))
    assert {"Test_addEntry", "Test_listEntries"} <= set(names(groups, "Related tests"))
    text = go.text(groups)
    assert text.startswith("Defined here:\n") and "→ codec/codec.go:20" in text


def test_calls_through_aliases_are_exact(go):
    callees = go.callees("addEntry")
    assert {"DecodeEntry", "WriteProblem", "AddEntry"} <= set(names(callees))
    assert {r["confidence"] for r in callees.collect()} == {"exact"}


def test_case_is_kept_apart(go):
    assert names(go.tests_for("store/rules.go#AddEntry")) == ["Test_AddEntry"]


def test_no_guessed_edges(go):
    assert resolve.graph_stats(go.graph).first()["heuristic_edges"] == 0


def test_change_surface(go):
    groups = go.impact(["store/rules.go"])
    assert "addEntry" in names(groups, "Direct callers")
    assert "Server.Routes" in names(groups, "Indirect callers")
    tests = {r["test_file"] for r in go.covering_tests(["store/rules.go", "store/store.go"]).collect()}
    assert tests == {"store/rules_test.go", "api/entries_test.go"}


def test_wrong_path_finds_the_real_one(go):
    best = go.path_candidates("server/api/entry.go").orderBy("rank").first()
    assert best["file"] == "api/entries.go"


def test_unknown_anchor_is_not_guessed(go):
    assert go.resolve("NoSuchThing")["status"] == "notfound"
    assert go.resolve("api/entries.go:12")["node"].endswith("#addEntry:function")
    assert go.resolve("Server.Routes")["status"] == "symbol"


def test_file_relations(go):
    assert go.tests_for("api/entries.go").count() == 3
    callers = names(go.callers("codec/codec.go"))
    assert "addEntry" in callers and "WriteJSON" not in callers


def test_related_files(go):
    found = [r["file"] for r in go.related_files("api/entries.go", 5).orderBy("rank").collect()]
    assert "store/rules.go" in found and any(f.endswith("_test.go") for f in found)


def test_outline_and_envelope(go):
    outline = go.outline("store/rules.go")
    assert "store/rules.go (26 lines, package store, 3 symbols)" in outline or "package store, 3 symbols" in outline
    assert "     13  func AddEntry(b *Book, e codec.Entry) error" in outline
    rows = go.envelope("store/rules.go#AddEntry")
    assert "CheckEntry" in names(rows, "Calls") and "addEntry" in names(rows, "Called by")


def test_clean_repository_has_no_unknowns(go, ts):
    for nav in (go, ts):
        assert validate.unknown_symbols(nav.facts, nav.graph).collect() == []


def test_invented_symbols_are_flagged(spark, go):
    """Two invented calls are reported, a changed constant is not."""
    text = open(os.path.join(GO, "store/rules.go"), encoding="utf-8").read()
    for old, new in (
        ("if err := CheckEntry(e); err != nil {", "codec.Normalize(e.Account)\n\tif err := CheckEntry(e); err != nil {"),
        ("return ErrTooLarge", "reportLarge(e)\n\t\treturn ErrTooLarge"),
        ("if e.Cents > 1000 {", "if e.Cents > 500 {"),
    ):
        assert old in text
        text = text.replace(old, new)
    facts = reindex(go.facts, spark.createDataFrame([("store/rules.go", text)], "file STRING, content STRING"))
    before = validate.unknown_symbols(go.facts, go.graph)
    found = validate.new_unknowns(before, validate.unknown_symbols(facts, resolve.resolve(facts))).orderBy("pos").collect()
    assert [(r["name"], r["qualifier"], r["reason"]) for r in found] == [
        ("Normalize", "codec", "not-in-package"), ("reportLarge", None, "not-found"),
    ]


def test_edit_brings_symbol_and_caller(spark):
    nav = index(spark, GO)
    assert nav.find("Normalize").filter("stage = 'exact'").count() == 0
    codec = open(os.path.join(GO, "codec/codec.go"), encoding="utf-8").read()
    api = open(os.path.join(GO, "api/entries.go"), encoding="utf-8").read()
    nav.note_edit(
        spark.createDataFrame(
            [
                ("codec/codec.go", codec + "\nfunc Normalize(name string) string {\n\treturn name\n}\n"),
                ("api/entries.go", api.replace("e, err := codec.DecodeEntry(r.Body)", "e, err := codec.DecodeEntry(r.Body)\n\t_ = codec.Normalize(e.Account)")),
            ],
            "file STRING, content STRING",
        )
    )
    assert names(nav.callers("Normalize")) == ["addEntry"]


def test_compile_scope(go):
    changed = go._changed(["store/rules.go"])
    scope = {r["package"] for r in verification.compile_scope(changed, go.impact(["store/rules.go"])).collect()}
    assert {"./store/...", "./api/..."} <= scope
    kinds = verification.detect_projects(go.known).first()
    assert (kinds["kind"], kinds["compile_all"]) == ("go", "go build ./...")


def test_typescript_receiver_types(ts):
    callees = ts.callees("src/handlers/entries.ts#addEntryHandler")
    method = callees.filter(F.col("node") == "sym:src/service/ledger.ts#LedgerService.addEntry:method").collect()
    assert [r["confidence"] for r in method] == ["exact"]
    assert {"decodeEntry", "answer", "problem"} <= set(names(callees))


def test_typescript_tests(ts):
    tests = ts.tests_for("src/handlers/entries.ts#addEntryHandler").collect()
    assert {r["node_file"] for r in tests} == {"tests/entries.test.ts"}


def test_typescript_imports(spark, ts):
    resolved = resolve.resolve_imports(ts.facts).filter("file = 'tests/entries.test.ts'").collect()
    assert {r["spec"]: r["import_file"] for r in resolved} == {
        "vitest": None,
        "../src/handlers/entries.js": "src/handlers/entries.ts",
        "../src/service/ledger.js": "src/service/ledger.ts",
        "../src/store/book.js": "src/store/book.ts",
    }
    files = spark.createDataFrame([("src/index.ts",), ("src/deep/index.ts",), ("lib/a.ts",)], "file STRING")
    asked = spark.createDataFrame([("src", "./deep"), ("src", "node:fs"), ("src", "@app/a"), ("", "./src/")], "dir STRING, spec STRING")
    aliases = spark.createDataFrame([("@app/*", "lib/*", 0)], "prefix STRING, target STRING, ord BIGINT")
    targets = {(r["dir"], r["spec"]): r["target"] for r in resolve.ts_import_targets(asked, files, aliases).collect()}
    assert targets == {("src", "./deep"): "src/deep/index.ts", ("src", "@app/a"): "lib/a.ts"}


def test_without_a_graph(spark):
    nav = NullNavigator(spark)
    assert nav.expand("x").count() == 0 and nav.outline("x") == "" and nav.envelope("x") is None and not nav.enabled


def test_strongest_edges_answer_as_all_lines_do(spark, go, ts):
    for nav in (go, ts):
        pairs = resolve.resolve(nav.facts, per_line=False)
        of = ["src", "dst", "kind"]
        assert pairs.edges.count() == pairs.edges.select(*of).distinct().count() == nav.graph.edges.select(*of).distinct().count()
        columns = ["anchor", "label", "node", "via", "confidence", "line"]
        kept, every = (sorted(map(str, navigate.relations(g).select(*columns).collect())) for g in (pairs, nav.graph))
        assert kept == every and len(every) > 20


def test_files_of_a_change_are_those_of_its_whole_surface(spark, go, ts):
    for nav in (go, ts):
        changed = nav.graph.files.select(F.col("file").alias("change"), "file", F.lit(0).alias("ord"))
        surface = navigate.impact(nav.graph, changed, None).select("change", "node_file").union(changed.select("change", "file")).distinct()
        files = navigate.impact_files(nav.graph, changed)
        assert sorted(map(tuple, files.collect())) == sorted(map(tuple, surface.collect()))

"""Graph maintenance as a stream of edited files."""

import json
import os

from lodestar.operators import resolve
from lodestar.plans.indexing import index_files
from lodestar.session import settle
from lodestar.sources import files as listing
from lodestar.sources.sinks import load_graph
from lodestar.streaming import ledger
from lodestar.streaming.maintain import follow_edits

GO = os.path.join(os.path.dirname(__file__), "fixtures", "go")


def test_graph_follows_edits(spark, tmp_path):
    known = settle(listing.read_tree(spark, GO, contents=True), "known")
    facts = index_files(known.select("file", "content"), (), listing.go_module(known), None)
    codec = open(os.path.join(GO, "codec/codec.go"), encoding="utf-8").read()
    rules = open(os.path.join(GO, "store/rules.go"), encoding="utf-8").read()
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    edits = [
        {"file": "codec/codec.go", "content": codec + "\nfunc Normalize(name string) string {\n\treturn name\n}\n"},
        {"file": "store/rules.go", "content": rules.replace("return b.Put(e)", "codec.Normalize(e.Account)\n\treturn b.Put(e)")},
    ]
    (inbox / "1.json").write_text("".join(json.dumps(e) + "\n" for e in edits))
    stream = spark.readStream.schema("file STRING, content STRING").json(str(inbox))
    query = follow_edits(stream, facts, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    graph = load_graph(spark, str(tmp_path / "out" / "v0" / "graph"))
    calls = graph.edges.filter("kind = 'calls' AND dst = 'sym:codec/codec.go#Normalize:function'").collect()
    assert [(r["src"], r["confidence"]) for r in calls] == [("sym:store/rules.go#AddEntry:function", "exact")]
    assert resolve.graph_stats(graph).first()["files"] == 7


def test_attribution_keeps_state_across_batches_without_python(spark, tmp_path):
    batches = [
        [("r", "a", 1, 1, "read", None, None), ("r", "a", 2, 1, "read", None, None), ("r", "a", 3, 2, "surface", "graph", None), ("r", "b", 4, 2, "edit", None, None)],
        [("r", "b", 5, 3, "surface", "search", None), ("s", "a", 6, 3, "read", None, "h1")],
        [("r", "a", 7, 4, "surface", "task", None), ("r", "a", 8, 4, "read", None, "h2"), ("r", "b", 9, 4, "read", None, "h1"), ("r", "b", 10, 4, "read", None, "h1"), ("s", "a", 11, 4, "read", None, "h1")],
    ]
    names = [c.split()[0] for c in ledger.TOUCH_SCHEMA.split(",")]
    inbox = tmp_path / "touches"
    inbox.mkdir()
    for n, rows in enumerate(batches):
        (inbox / f"{n}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        os.utime(inbox / f"{n}.json", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(ledger.TOUCH_SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
    path = ledger.attribute_to_files(stream, "touches")
    got = spark.read.schema(ledger.OUTPUT_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    expected = [
        ("r", "a", 1, "read", "unseen", None, False, False), ("r", "a", 2, "read", "unseen", None, True, False),  # of two unknown contents none is known to be the same
        ("r", "b", 4, "edit", "unseen", None, False, False), ("s", "a", 6, "read", "unseen", None, False, False),
        ("r", "a", 8, "read", "graph", 2, True, False), ("r", "b", 9, "read", "search", 3, False, False),
        ("r", "b", 10, "read", "search", 3, True, True), ("s", "a", 11, "read", "unseen", None, True, True),
    ]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == expected
    whole = spark.createDataFrame([r for rows in batches for r in rows], ledger.TOUCH_SCHEMA)
    assert sorted(map(tuple, ledger.attribute(whole).collect()), key=lambda r: r[2]) == expected
    assert "Python" not in ledger.attribute(whole, ledger.left_by(whole))._jdf.queryExecution().toString()

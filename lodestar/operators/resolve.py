"""Name resolution: from per-file facts to a confidence-tiered graph.

Every fact table carries the repository ``keys`` and ``file``. The listing order of a
repository is the code-unit order of its paths, so ``(file, pos)`` orders its nodes.

References repeat: a file asks the same question (name, qualifier, declared type) many
times. The cascade runs once per distinct question. Each stage is first reduced to one
row per lookup key, so that deciding which stage answers is a chain of key joins without
fan-out; only the answering stage is then expanded to its targets. Intermediate tables
that several later steps read are written to the shared folder once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import CONFIDENCE_RANK, MAX_AMBIGUOUS_FANOUT, TS_EXTENSIONS, lookup_sql
from lodestar.functions.paths import basename, directory, extname, join_path, normalize
from lodestar.session import settle


@dataclass(frozen=True)
class Facts:
    """Extraction output. ``modules(keys, go_module)`` and
    ``aliases(keys, prefix, target, ord)`` may be None."""

    files: DataFrame
    defs: DataFrame
    refs: DataFrame
    imports: DataFrame
    locals: DataFrame | None = None
    modules: DataFrame | None = None
    aliases: DataFrame | None = None
    keys: tuple = ()


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    unresolved: DataFrame
    keys: tuple = ()
    per_pair: bool = False  # only the strongest edge of each pair and kind


def file_id(file: Column) -> Column:
    return F.concat(F.lit("file:"), file)


def symbol_id(file: Column, receiver: Column, name: Column, kind: Column) -> Column:
    return F.concat(F.lit("sym:"), file, F.lit("#"), qualified_name(receiver, name), F.lit(":"), kind)


def qualified_name(receiver: Column, name: Column) -> Column:
    return F.when(receiver.isNotNull() & (receiver != ""), F.concat(receiver, F.lit("."), name)).otherwise(name)


def build_nodes(facts: Facts) -> DataFrame:
    """One node per file and per definition; of two with one id, the later values win."""
    keys = list(facts.keys)
    files = facts.files.select(
        *keys,
        file_id(F.col("file")).alias("id"),
        F.lit("file").alias("kind"),
        basename("file").alias("name"),
        F.col("file").alias("qualified"),
        "file",
        "lang",
        F.lit(1).alias("start_line"),
        F.col("line_count").alias("end_line"),
        F.lit(True).alias("exported"),
        F.lit(None).cast("string").alias("receiver"),
        "pkg",
        F.lit(None).cast("string").alias("signature"),
        F.lit(-1).alias("pos"),
        "is_test",
    )
    about = facts.files.select(*keys, "file", "lang", "pkg", "is_test")
    values = ["kind", "name", "qualified", "file", "lang", "start_line", "end_line", "exported", "receiver", "pkg", "signature", "is_test"]
    symbols = (
        facts.defs.join(about, [*keys, "file"])
        .withColumn("qualified", qualified_name(F.col("receiver"), F.col("name")))
        .withColumn("id", symbol_id(F.col("file"), F.col("receiver"), F.col("name"), F.col("kind")))
        .groupBy(*keys, "id")
        .agg(F.max_by(F.struct(*values), "pos").alias("v"), F.min("pos").alias("pos"))
        .select(*keys, "id", "v.*", "pos")
    )
    return files.unionByName(symbols.select(*files.columns)).withColumn("dir", directory("file"))


# -- imports ----------------------------------------------------------------------


def go_import_dir(spec: Column, module: Column) -> Column:
    """Directory of a Go import path inside the module; null for an outside package."""
    inside = F.substring(spec, F.length(module) + 2, F.length(spec))
    return F.when(spec == module, F.lit("")).when(spec.startswith(F.concat(module, F.lit("/"))), inside)


def _candidates(base: Column) -> Column:
    """Paths a module specifier may stand for, in order of preference."""
    ext = extname(base)
    bare = F.left(base, F.length(base) - F.length(ext))
    exts = F.array(*[F.lit(e) for e in TS_EXTENSIONS])

    def grown(stem):
        plain = F.transform(exts, lambda e: F.concat(stem, e))
        index = F.transform(exts, lambda e: F.concat(stem, F.lit("/index"), e))
        return F.concat(plain, index)

    shortened = F.when(ext.isin(*TS_EXTENSIONS), F.concat(F.array(bare), grown(bare))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(grown(base), shortened, F.array(base))


def ts_import_targets(asked: DataFrame, files: DataFrame, aliases: DataFrame | None, keys=()) -> DataFrame:
    """``asked(keys, dir, spec)`` -> ``(keys, dir, spec, target)``, first existing candidate."""
    keys = list(keys)
    distinct = asked.select(*keys, "dir", "spec").distinct()
    trailing = F.when(F.col("spec").endswith("/"), F.lit("/")).otherwise(F.lit(""))
    relative = distinct.filter(F.col("spec").startswith(".")).select(
        *keys, "dir", "spec", F.lit(0).cast("long").alias("base_ord"),
        F.concat(join_path("dir", "spec"), trailing).alias("base"),
    )
    bases = relative
    if aliases is not None:
        # An alias prefix is matched by equality on every prefix of the specifier.
        lengths = F.sequence(F.lit(0), F.length("spec"))
        prefixed = distinct.filter(~F.col("spec").startswith(".")).select(
            *keys, "dir", "spec",
            F.explode(F.transform(lengths, lambda n: F.substring("spec", F.lit(1), n))).alias("stem"),
        )
        known = aliases.withColumn("stem", F.regexp_replace("prefix", "\\*$", ""))
        matched = prefixed.join(known, [*keys, "stem"])
        rest = F.substring(F.col("spec"), F.length("stem") + 1, F.length("spec"))
        starred = F.concat(F.regexp_replace("target", "\\*$", ""), rest)
        base = normalize(F.when(F.col("target").endswith("*"), starred).otherwise(F.col("target")))
        bases = relative.unionByName(
            matched.select(*keys, "dir", "spec", F.col("ord").cast("long").alias("base_ord"), base.alias("base"))
        )
    tries = bases.select(*keys, "dir", "spec", "base_ord", F.posexplode(_candidates(F.col("base"))).alias("prio", "target"))
    hits = tries.join(files.select(*keys, F.col("file").alias("target")), [*keys, "target"])
    return hits.groupBy(*keys, "dir", "spec").agg(F.min_by("target", F.struct("base_ord", "prio")).alias("target"))


def resolve_imports(facts: Facts) -> DataFrame:
    """Each import with ``import_dir`` (Go) or ``import_file`` (TS/JS), null when external."""
    keys = list(facts.keys)
    about = facts.files.select(*keys, "file", "lang")
    imports = facts.imports.join(about, [*keys, "file"]).withColumn("dir", directory("file"))
    if facts.modules is None:
        imports = imports.withColumn("go_module", F.lit(None).cast("string"))
    elif keys:
        imports = imports.join(facts.modules, keys, "left")
    else:
        imports = imports.withColumn("go_module", facts.modules.select("go_module").scalar())
    is_go = F.col("lang") == "go"
    targets = ts_import_targets(imports.filter(~is_go), facts.files, facts.aliases, keys)
    joined = imports.join(targets, [*keys, "dir", "spec"], "left")
    return joined.select(
        *keys, "file", "lang", "pos", "line", "spec", "alias", "names",
        F.when(is_go, go_import_dir(F.col("spec"), F.col("go_module"))).alias("import_dir"),
        F.when(~is_go, F.col("target")).alias("import_file"),
    )


def bindings(imports: DataFrame, keys=()) -> DataFrame:
    """What each locally bound import name of a file stands for; the last binding wins.

    ``(keys, file, local, pkg_dir, ns_file, named_file, named_original)``
    """
    keys = list(keys)
    inside = imports.filter(F.col("import_dir").isNotNull() | F.col("import_file").isNotNull())
    none = F.lit(None).cast("string")
    alias = inside.filter(F.col("alias").isNotNull()).select(
        *keys, "file", F.col("alias").alias("local"), "pos",
        F.col("import_dir").alias("pkg_dir"), F.col("import_file").alias("ns_file"),
        none.alias("named_file"), none.alias("named_original"),
    )
    named = inside.filter(F.col("import_file").isNotNull()).select(
        *keys, "file", "pos", "import_file", F.explode("names").alias("local", "named_original")
    ).select(
        *keys, "file", "local", "pos", none.alias("pkg_dir"), none.alias("ns_file"),
        F.col("import_file").alias("named_file"), "named_original",
    )
    return alias.unionByName(named).groupBy(*keys, "file", "local").agg(
        F.max_by("pkg_dir", F.when(F.col("pkg_dir").isNotNull(), F.col("pos"))).alias("pkg_dir"),
        F.max_by("ns_file", F.when(F.col("ns_file").isNotNull(), F.col("pos"))).alias("ns_file"),
        F.max_by("named_file", F.when(F.col("named_file").isNotNull(), F.col("pos"))).alias("named_file"),
        F.max_by("named_original", F.when(F.col("named_file").isNotNull(), F.col("pos"))).alias("named_original"),
    )


# -- lookup tables ------------------------------------------------------------------


def _heads(nodes: DataFrame, by: list, limit: int) -> DataFrame:
    """Number of nodes per key, and id and ``is_test`` of the first ``limit`` in listing order."""
    listing = Window.partitionBy(*by).orderBy("file", "pos")
    first = (
        nodes.select(*by, "id", "is_test", "file", "pos")
        .withColumn("_n", F.row_number().over(listing))
        .filter(F.col("_n") <= limit)
        .groupBy(*by)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id", "is_test"))), lambda s: F.struct(s["id"].alias("id"), s["is_test"].alias("is_test"))).alias("heads"))
    )
    return nodes.groupBy(*by).agg(F.count("*").alias("n")).join(first, by)


def _present(nodes: DataFrame, by: list, flag: str) -> DataFrame:
    return nodes.select(*by).distinct().withColumn(flag, F.lit(True))


def _look(df: DataFrame, index: DataFrame, keys: list, on: dict, out: dict) -> DataFrame:
    """Left join on ``{index column: expression over df}`` plus the repository keys."""
    renamed = index.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_k_{c}") for c in on],
        *[F.col(c).alias(o) for c, o in out.items()],
    )
    condition = None
    for name, value in [*[(k, F.col(k)) for k in keys], *on.items()]:
        term = value == F.col(f"_k_{name}")
        condition = term if condition is None else condition & term
    return df.join(renamed, condition, "left").drop(*[f"_k_{c}" for c in [*keys, *on]])


def typed_owners(questions: DataFrame, symbols: DataFrame, bound: DataFrame, keys: list) -> DataFrame:
    """Files that declare a receiver's type, in search order.

    ``questions(keys, file, dir, lang, qualifier_type)`` distinct; the answer holds
    ``(.., owner_name, owner_file, owner_ord)``. The next group is searched only when
    the one before it has no owner at all.
    """
    asked = questions.select(*keys, "file", "dir", "lang", "qualifier_type").distinct()
    places = symbols.select(*keys, F.col("file").alias("o_file"), F.col("dir").alias("o_dir"), F.col("name").alias("o_name"),
                            F.col("pos").alias("o_pos"), F.col("kind").alias("o_kind"))

    def order(group, tier):
        return F.struct(F.lit(group).alias("g"), F.lit(tier).alias("t"), F.col("o_file").alias("f"), F.col("o_pos").alias("p"))

    def found(part, on, group, tier):
        pairs = [F.col(f"a.{k}") == F.col(f"p.{k}") for k in keys]
        joined = part.alias("a").join(places.alias("p"), _all(pairs + [F.col(f"a.{x}") == F.col(f"p.{y}") for x, y in on.items()]))
        return joined.select(
            *[F.col(f"a.{k}") for k in keys], "a.file", "a.qualifier_type", F.col("p.o_name").alias("owner_name"),
            F.col("p.o_file").alias("owner_file"), order(group, tier).alias("owner_ord"),
        )

    owners = found(asked, {"file": "o_file", "qualifier_type": "o_name"}, 0, 0)
    owners = owners.unionByName(
        found(asked.filter(F.col("lang") == "go"), {"dir": "o_dir", "qualifier_type": "o_name"}, 0, 1)
    )
    via = _look(asked, bound, keys, {"file": F.col("file"), "local": F.col("qualifier_type")},
                {"named_file": "b_file", "named_original": "b_name"}).filter(F.col("b_file").isNotNull())
    owners = owners.unionByName(found(via, {"b_file": "o_file", "b_name": "o_name"}, 1, 0))
    unique = (
        symbols.filter(F.col("kind").isin("type", "interface"))
        .groupBy(*keys, "name")
        .agg(F.count("*").alias("n"), F.min("file").alias("o_file"), F.min("pos").alias("o_pos"))
        .filter(F.col("n") == 1)
    )
    anywhere = _look(asked, unique, keys, {"name": F.col("qualifier_type")}, {"o_file": "o_file", "o_pos": "o_pos"}).filter(
        F.col("o_file").isNotNull()
    )
    owners = owners.unionByName(
        anywhere.select(*keys, "file", "qualifier_type", F.col("qualifier_type").alias("owner_name"),
                        F.col("o_file").alias("owner_file"), order(2, 0).alias("owner_ord"))
    )
    by = [*keys, "file", "qualifier_type"]
    nearest = owners.groupBy(*by).agg(F.min("owner_ord.g").alias("_g"))
    kept = owners.join(nearest, by).filter(F.col("owner_ord.g") == F.col("_g"))
    return kept.groupBy(*by, "owner_name", "owner_file").agg(F.min("owner_ord").alias("owner_ord"))


def _all(terms: list) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


# -- the cascade ----------------------------------------------------------------------


def answer_questions(asked: DataFrame, nodes: DataFrame, bound: DataFrame, keys: list, fanout: int) -> DataFrame:
    """Resolve distinct questions ``(keys, file, dir, lang, name, qualifier, qualifier_type)``.

    Returns ``(.., stage, confidence, n, dst, dst_test, cand)``: one row per target of the most
    certain stage that applies. Ambiguous answers keep the true count ``n`` and at most
    ``fanout`` targets; what to do with a count above it is left to the caller.
    """
    symbols = nodes.filter(F.col("kind") != "file")
    methods = symbols.filter(F.col("kind") == "method")
    in_file = _present(symbols, [*keys, "file", "name"], "hit")
    in_dir = _present(symbols, [*keys, "dir", "name"], "hit")
    everywhere = _heads(symbols, [*keys, "name"], fanout)
    any_method = _heads(methods, [*keys, "name"], fanout)
    by_receiver = _present(methods, [*keys, "receiver", "name"], "hit")

    q = ["file", "dir", "lang", "name", "qualifier", "qualifier_type"]
    null = F.lit(None).cast("string")
    typed = asked.filter(F.coalesce("qualifier_type", F.lit("")) != "")
    owners = typed_owners(typed, symbols, bound, keys)
    owned = methods.select(*keys, F.col("file").alias("owner_file"), F.col("receiver").alias("owner_name"), "name").distinct()
    typed_hits = settle(
        typed.join(owners, [*keys, "file", "qualifier_type"])
        .join(owned, [*keys, "owner_file", "owner_name", "name"])
        .groupBy(*keys, *q)
        .agg(F.min_by(F.struct("owner_file", "owner_name"), "owner_ord").alias("o")),
        "typed",
    )
    typed_answers = typed_hits.select(
        *keys, *q, F.lit("R2").alias("stage"), F.col("o.owner_file").alias("at_file"), null.alias("at_dir"),
        F.col("name").alias("at_name"), F.col("o.owner_name").alias("at_receiver"),
    )
    same_question = _all([F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in q])
    rest = asked.alias("l").join(typed_hits.alias("r"), same_question, "left_anti")

    is_go = F.col("lang") == "go"
    has_qualifier = F.coalesce("qualifier", F.lit("")) != ""

    # Qualified names: package, namespace, imported owner, then any method of the name.
    ql = _look(rest.filter(has_qualifier), bound, keys, {"file": F.col("file"), "local": F.col("qualifier")},
               {"pkg_dir": "pkg_dir", "ns_file": "ns_file", "named_file": "b_file", "named_original": "b_name"})
    ql = _look(ql, in_dir, keys, {"dir": F.col("pkg_dir"), "name": F.col("name")}, {"hit": "in_pkg"})
    ql = _look(ql, in_file, keys, {"file": F.col("ns_file"), "name": F.col("name")}, {"hit": "in_ns"})
    ql = _look(ql, in_file, keys, {"file": F.col("b_file"), "name": F.col("b_name")}, {"hit": "has_owner"})
    ql = _look(ql, by_receiver, keys, {"receiver": F.when(F.col("has_owner"), F.col("b_name")), "name": F.col("name")}, {"hit": "owned"})
    go_pkg = is_go & F.col("pkg_dir").isNotNull()
    ts_ns = ~is_go & F.col("ns_file").isNotNull()
    ql = ql.withColumn(
        "stage",
        F.when(go_pkg, F.when(F.col("in_pkg"), "R3"))
        .when(ts_ns, F.when(F.col("in_ns"), "R4"))
        .when(~is_go & F.col("owned"), "R5")
        .otherwise("R6"),
    )
    qualified = ql.select(
        *keys, *q, "stage",
        F.when(F.col("stage") == "R4", F.col("ns_file")).alias("at_file"),
        F.when(F.col("stage") == "R3", F.col("pkg_dir")).alias("at_dir"),
        F.col("name").alias("at_name"),
        F.when(F.col("stage") == "R5", F.col("b_name")).alias("at_receiver"),
    )

    # Bare names: this file, the imported name or the same package, then anywhere.
    un = _look(rest.filter(~has_qualifier), in_file, keys, {"file": F.col("file"), "name": F.col("name")}, {"hit": "here"})
    un = _look(un, bound, keys, {"file": F.col("file"), "local": F.col("name")}, {"named_file": "b_file", "named_original": "b_name"})
    un = _look(un, in_file, keys, {"file": F.col("b_file"), "name": F.col("b_name")}, {"hit": "imported"})
    un = _look(un, in_dir, keys, {"dir": F.col("dir"), "name": F.col("name")}, {"hit": "beside"})
    un = un.withColumn(
        "stage",
        F.when(F.col("here"), "R7").when(~is_go & F.col("imported"), "R8").when(is_go & F.col("beside"), "R9").otherwise("R10"),
    )
    bare = un.select(
        *keys, *q, "stage",
        F.when(F.col("stage") == "R7", F.col("file")).when(F.col("stage") == "R8", F.col("b_file")).alias("at_file"),
        F.when(F.col("stage") == "R9", F.col("dir")).alias("at_dir"),
        F.when(F.col("stage") == "R8", F.col("b_name")).otherwise(F.col("name")).alias("at_name"),
        null.alias("at_receiver"),
    )
    decided = settle(typed_answers.unionByName(qualified).unionByName(bare).filter(F.col("stage").isNotNull()), "decided")

    def expand(stages, index, on):
        part = decided.filter(F.col("stage").isin(*stages))
        targets = index.select(
            *[F.col(k).alias(f"t_{k}") for k in keys],
            *[F.col(c).alias(f"t_{c}") for c in on],
            F.col("id").alias("dst"),
            F.col("is_test").alias("dst_test"),
            F.struct(F.col("file").alias("t_f"), F.col("pos").alias("t_p")).alias("cand"),
        )
        condition = _all([F.col(k) == F.col(f"t_{k}") for k in keys] + [v == F.col(f"t_{c}") for c, v in on.items()])
        joined = part.join(targets, condition)
        return joined.select(*keys, *q, "stage", F.lit("exact").alias("confidence"), F.lit(1).cast("long").alias("n"), "dst", "dst_test", "cand")

    def expand_heads(stage, index):
        part = _look(decided.filter(F.col("stage") == stage), index, keys, {"name": F.col("name")}, {"n": "n", "heads": "heads"})
        part = part.filter(F.col("n").isNotNull())
        confidence = F.when(F.col("n") == 1, "likely").otherwise("heuristic")
        # heads are in listing order, so their position orders them
        return part.select(
            *keys, *q, "stage", confidence.alias("confidence"), "n", F.posexplode("heads").alias("i", "head")
        ).select(*keys, *q, "stage", "confidence", "n", F.col("head.id").alias("dst"), F.col("head.is_test").alias("dst_test"), F.struct(F.lit("").alias("t_f"), F.col("i").alias("t_p")).alias("cand"))

    name, at = F.col("at_name"), F.col
    answers = expand(["R4", "R7", "R8"], symbols, {"file": at("at_file"), "name": name})
    for more in (
        expand(["R3", "R9"], symbols, {"dir": at("at_dir"), "name": name}),
        expand(["R2"], methods, {"file": at("at_file"), "receiver": at("at_receiver"), "name": name}),
        expand(["R5"], methods, {"receiver": at("at_receiver"), "name": name}),
        expand_heads("R6", any_method),
        expand_heads("R10", everywhere),
    ):
        answers = answers.unionByName(more)
    return answers


def resolve(facts: Facts, fanout: int = MAX_AMBIGUOUS_FANOUT, nodes: DataFrame | None = None, per_line: bool = True) -> Graph:
    """Nodes and edges of every repository in ``facts``.

    Without ``per_line`` only the ``strongest`` edge of each pair and kind is kept, which is
    all that relations and file graphs read; both forms take one shuffle of the edges.
    """
    keys = list(facts.keys)
    nodes = settle(build_nodes(facts), "nodes") if nodes is None else nodes
    symbols = nodes.filter(F.col("kind") != "file")
    about = facts.files.select(*keys, "file", "lang", "is_test").withColumn("dir", directory("file"))
    # both ends of every edge are nodes, so that edges need not look them up
    listed = facts.defs.join(facts.files.select(*keys, "file"), [*keys, "file"], "left_semi")
    defs = listed.select(
        *keys, "file", "pos", "name", "kind", "start_line", "receiver", "implements_names",
        symbol_id(F.col("file"), F.col("receiver"), F.col("name"), F.col("kind")).alias("def_id"),
    )
    imports = settle(resolve_imports(facts), "imports")
    bound = settle(bindings(imports, keys), "bindings")
    no_line = F.lit(None).cast("int")

    def edge(df, src, dst, kind, confidence, line, phase, pos, cand=None, in_test=None, to_test=None):
        cand = cand if cand is not None else F.struct(F.lit("").alias("t_f"), F.lit(0).alias("t_p"))
        in_test, to_test = [F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for c in (in_test, to_test)]
        return df.select(
            *keys, src.alias("src"), dst.alias("dst"), kind.alias("kind"), confidence.alias("confidence"), line.alias("line"),
            F.struct(F.col("file").alias("f"), F.lit(phase).alias("phase"), pos.alias("pos"), cand.alias("cand")).alias("ord"),
            in_test.alias("in_test"), to_test.alias("to_test"),
        )

    exact = F.lit("exact")
    contains = edge(defs, file_id(F.col("file")), F.col("def_id"), F.lit("contains"), exact, no_line, 0, F.col("pos"))

    # An import of a Go package points at every file of its directory, any other at one file.
    go_files = about.select(*keys, F.col("dir").alias("import_dir"), F.col("file").alias("other"))
    to_package = imports.filter(F.col("import_dir").isNotNull()).join(go_files, [*keys, "import_dir"])
    to_package = to_package.filter(F.col("other") != F.col("file"))
    imported = edge(
        to_package, file_id(F.col("file")), file_id(F.col("other")), F.lit("imports"), exact, F.col("line"), 1, F.col("pos")
    ).unionByName(
        edge(
            imports.filter(F.col("import_file").isNotNull()), file_id(F.col("file")), file_id(F.col("import_file")),
            F.lit("imports"), exact, F.col("line"), 1, F.col("pos"),
        )
    )

    # References and heritage names ask; distinct questions are answered once.
    enclosing = defs.select(*keys, "file", F.col("pos").alias("enclosing"), F.col("def_id").alias("encl_id"))
    refs = (
        facts.refs.join(about, [*keys, "file"])
        .join(enclosing, [*keys, "file", "enclosing"], "left")
        .select(
            *keys, "file", "dir", "lang", "pos", "name", "qualifier", "qualifier_type", "line",
            F.coalesce("encl_id", file_id(F.col("file"))).alias("src"),
            F.when(F.col("kind") == "call", "calls").otherwise("references").alias("edge_kind"), "is_test",
        )
    )
    null = F.lit(None).cast("string")
    heritage = (
        defs.select(*keys, "file", "pos", "start_line", "def_id", F.explode("implements_names").alias("name"))
        .join(about, [*keys, "file"])
        .select(
            *keys, "file", "dir", "lang", "pos", "name", null.alias("qualifier"), null.alias("qualifier_type"),
            F.col("start_line").alias("line"), F.col("def_id").alias("src"), F.lit("implements").alias("edge_kind"), "is_test",
        )
    )
    lookups = settle(refs.unionByName(heritage), "lookups")
    q = ["file", "dir", "lang", "name", "qualifier", "qualifier_type"]
    asked = settle(lookups.select(*keys, *q).distinct(), "questions")
    answers = settle(answer_questions(asked, nodes, bound, keys, fanout), "answers")
    matched = (
        lookups.alias("l")
        .join(
            answers.alias("a"),
            _all([F.col(f"l.{k}") == F.col(f"a.{k}") for k in keys] + [F.col(f"l.{c}").eqNullSafe(F.col(f"a.{c}")) for c in q]),
            "left",
        )
        .select(
            *[F.col(f"l.{k}") for k in keys], "l.file", "l.pos", "l.line", "l.src", "l.edge_kind", "l.is_test",
            "a.dst", "a.dst_test", "a.confidence", "a.n", "a.cand",
        )
    )
    is_heritage = F.col("edge_kind") == "implements"
    dropped = F.col("dst").isNull() | ((F.col("confidence") == "heuristic") & (F.col("n") > fanout))
    referenced = matched.filter(~is_heritage & ~dropped)
    ref_edges = edge(referenced, F.col("src"), F.col("dst"), F.col("edge_kind"), F.col("confidence"), F.col("line"), 2, F.col("pos"), F.col("cand"),
                     (F.col("edge_kind") == "calls") & F.col("is_test"), F.col("dst_test"))
    unresolved = matched.filter(~is_heritage & dropped).select(*keys, "file", "pos").distinct()

    impl_edges = edge(
        heritage_targets(lookups.filter(is_heritage), answers, keys, q, fanout), F.col("src"), F.col("dst"), F.lit("implements"),
        F.col("confidence"), F.col("line"), 4, F.col("pos"), F.col("cand"),
    )

    # Methods refer to their owning type: in the file, else in the directory.
    receivers = defs.filter((F.col("kind") == "method") & (F.coalesce("receiver", F.lit("")) != "")).withColumn("dir", directory("file"))
    first_in_file = symbols.groupBy(*keys, "file", "name").agg(F.min_by("id", "pos").alias("owner"))
    first_in_dir = symbols.groupBy(*keys, "dir", "name").agg(F.min_by("id", F.struct("file", "pos")).alias("owner"))
    owned = _look(receivers, first_in_file, keys, {"file": F.col("file"), "name": F.col("receiver")}, {"owner": "near"})
    owned = _look(owned, first_in_dir, keys, {"dir": F.col("dir"), "name": F.col("receiver")}, {"owner": "far"})
    owned = owned.withColumn("owner", F.coalesce("near", "far")).filter(F.col("owner").isNotNull())
    owner_edges = edge(owned, F.col("def_id"), F.col("owner"), F.lit("references"), exact, F.col("start_line"), 3, F.col("pos"))

    affinity = edge(
        test_affinity(defs, about, symbols, keys, fanout), F.col("def_id"), F.col("dst"), F.lit("tests"),
        F.col("confidence"), F.col("start_line"), 5, F.col("pos"), F.col("cand"),
    )

    direct = contains.unionByName(imported).unionByName(ref_edges).unionByName(owner_edges).unionByName(impl_edges).unionByName(affinity)
    # A call from a test file into the code also counts as coverage, after everything else.
    own = F.struct(F.col("kind").alias("k"), F.lit(0).alias("pass"))
    covers = F.array(own, F.struct(F.lit("tests").alias("k"), F.lit(1).alias("pass")))
    passes = F.when(F.col("in_test") & ~F.col("to_test"), covers).otherwise(F.array(own))
    spread = direct.filter(F.col("src") != F.col("dst")).select(
        *keys, "src", "dst", "confidence", "line", "ord", "in_test", F.inline(passes).alias("kind", "pass")
    )
    # Dealt by pair, so that all lines of a pair meet in one task, whichever form is asked for.
    best = F.min(F.struct(F.struct("pass", "ord").alias("ord"), "confidence", "in_test"))
    lined = spread.repartition(*keys, "src", "dst").groupBy(*keys, "src", "dst", "kind", "line").agg(best.alias("v"))
    edges = lined.select(*keys, "src", "dst", "kind", "v.confidence", "line", "v.ord", (F.col("v.in_test") & (F.col("kind") == "calls")).alias("in_test"))
    if per_line:
        edge_key = F.concat_ws("|", "kind", "src", "dst", F.coalesce("line", F.lit(0)).cast("string"))
        edges = edges.select(*keys, edge_key.alias("id"), "src", "dst", "kind", "confidence", "line", "ord", "in_test")
    else:
        edges = strongest(edges, keys)
    return Graph(nodes, edges, facts.files, unresolved, tuple(keys), not per_line)


def strongest(edges: DataFrame, keys=()) -> DataFrame:
    """The edge of highest confidence, then the earliest, of each pair and kind."""
    by = [*keys, "src", "dst", "kind"]
    trust = F.expr(lookup_sql("confidence", CONFIDENCE_RANK, "0"))
    row = F.struct((-trust).alias("c"), "ord", "confidence", "line", "in_test")
    best = edges.groupBy(*by).agg(F.min(row).alias("v"))
    return best.select(*by, "v.confidence", "v.line", "v.ord", "v.in_test")


def heritage_targets(lookups: DataFrame, answers: DataFrame, keys: list, q: list, fanout: int) -> DataFrame:
    """The first ``fanout`` targets of each heritage name, cut per question before the join."""
    order = Window.partitionBy(*keys, *q).orderBy("cand")
    cut = answers.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= fanout)
    on = _all([F.col(f"l.{k}") == F.col(f"a.{k}") for k in keys] + [F.col(f"l.{c}").eqNullSafe(F.col(f"a.{c}")) for c in q])
    return lookups.alias("l").join(cut.alias("a"), on).select(
        *[F.col(f"l.{k}") for k in keys], "l.file", "l.pos", "l.line", "l.src", "a.dst", "a.confidence", "a.cand"
    )


def test_affinity(defs: DataFrame, about: DataFrame, symbols: DataFrame, keys: list, fanout: int) -> DataFrame:
    """Targets a test's name points at: same directory first, else anywhere outside tests."""
    stripped = F.regexp_replace("name", "^(Test|Benchmark|Fuzz|Example)_?", "")
    tests = (
        defs.filter(F.col("kind") == "test")
        .join(about.filter("is_test"), [*keys, "file"])
        .withColumn("stem", F.split(stripped, "_").getItem(0))
        .filter(F.col("stem") != "")
    )
    code = symbols.filter(~F.col("is_test"))
    local = _heads(code, [*keys, "dir", "name"], fanout)
    anywhere = _heads(code, [*keys, "name"], fanout)
    found = _look(tests, local, keys, {"dir": F.col("dir"), "name": F.col("stem")}, {"n": "l_n", "heads": "l_heads"})
    found = _look(found, anywhere, keys, {"name": F.col("stem")}, {"n": "g_n", "heads": "g_heads"})
    found = found.withColumn("n", F.coalesce("l_n", "g_n")).withColumn("heads", F.coalesce("l_heads", "g_heads"))
    found = found.filter(F.col("n") <= fanout)
    return found.select(
        *keys, "file", "pos", "start_line", "def_id",
        F.when(F.col("n") == 1, "exact").otherwise("heuristic").alias("confidence"), F.posexplode("heads").alias("i", "head"),
    ).withColumn("dst", F.col("head.id")).withColumn("cand", F.struct(F.lit("").alias("t_f"), F.col("i").alias("t_p")))


def graph_stats(graph: Graph) -> DataFrame:
    """Files, symbols, edges, heuristic edges and unresolved references per repository."""
    keys = list(graph.keys)
    tagged = (
        graph.nodes.select(*keys, F.when(F.col("kind") == "file", "files").otherwise("symbols").alias("what"))
        .unionByName(graph.edges.select(*keys, F.when(F.col("confidence") == "heuristic", "heuristic").otherwise("edges").alias("what")))
        .unionByName(graph.unresolved.select(*keys, F.lit("unresolved").alias("what")))
    )
    counts = [F.count_if(F.col("what").isin(*w)).alias(o) for w, o in (
        (["files"], "files"), (["symbols"], "symbols"), (["edges", "heuristic"], "edges"), (["heuristic"], "heuristic_edges"), (["unresolved"], "unresolved_refs"))]
    return tagged.groupBy(*keys).agg(*counts)

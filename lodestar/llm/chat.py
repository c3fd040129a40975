"""Chat formatting over reply trees: paths by pointer doubling, branches by score, one text per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import settle

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates read as commands. Each gets a backslash after its first letter.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
#: Written after the end of each turn.
BREAK = "\n"


def tree() -> Column:
    """The conversation as a key that is never null: a record that may hold a null."""
    return F.struct("conv_id").alias("conv_id")


def escaped(text: Column) -> Column:
    """``text`` without any control string; a backslash is doubled first, so nothing is lost."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    """A backslash stands for nothing but the letter after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as the simplest reply trees: each answers the one before.

    Rows of equal turn follow each other by role, then text, nulls first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    placed = settle(rows.select("conv_id", node.alias("node"), "role", "text"), "chat-turns")
    return placed.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, node, depth) of the ``branches`` best root-to-leaf paths of each conversation.

    Each round joins the table of ancestors with itself and so doubles how far it reaches, twice;
    the rounds end when no row has anything above it. Paths are read off from the leaves, the
    longest steps first. A path's score is the sum over its nodes; ties go to the smaller leaf.
    Rows without a conv_id are one conversation. ``branches=None`` keeps every path. A node whose
    parent is missing is a root. Each round's table is written to the shared folder.
    """
    keys = nodes.select(tree(), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    present = keys.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("present"))
    jump = keys.join(present, ["conv_id", "parent"], "left").select(
        "conv_id", "node", F.when(F.col("present"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("length")
    )
    inner = keys.select("conv_id", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    # jump: who is 4 ** k above, for the nodes that are that deep; rooted: sums up to the root;
    # hops[k]: who is one, two and three times 4 ** k above
    jump, hops = settle(jump, "chat-jump"), []
    rooted, jump = jump.filter(F.col("up").isNull()), jump.filter(F.col("up").isNotNull())
    while not jump.isEmpty():
        if len(hops) > 20:
            raise ValueError("parents form a circle")
        far = jump.unionByName(rooted).select(
            "conv_id", F.col("node").alias("at"), F.col("up").alias("next"), F.col("sum").alias("sum2"), F.col("length").alias("length2")
        )
        step = jump.withColumnRenamed("up", "up1")
        for k in (1, 2, 3):
            above = far.withColumnRenamed("at", f"up{k}").withColumnRenamed("next", f"up{k + 1}")
            step = step.join(above, ["conv_id", f"up{k}"], "left").withColumns(
                {"sum": F.col("sum") + F.coalesce("sum2", F.lit(0.0)), "length": F.col("length") + F.coalesce("length2", F.lit(0))}
            ).drop("sum2", "length2")
        passed = F.array_compact(F.array("up1", "up2", "up3")).alias("passed")
        stepped = settle(step.select("conv_id", "node", F.col("up4").alias("up"), "sum", "length", passed), "chat-jump")
        hops.append(stepped.select("conv_id", "node", "passed"))
        stepped = stepped.drop("passed")
        rooted, jump = rooted.unionByName(stepped.filter(F.col("up").isNull())), stepped.filter(F.col("up").isNotNull())
    leaves = rooted.join(inner, ["conv_id", "node"], "left_anti")
    if branches is not None:
        best = Window.partitionBy("conv_id").orderBy(F.desc("sum"), "node")
        leaves = leaves.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= branches)
    found = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.col("length").alias("depth"))
    found = settle(found, "chat-leaves")  # as stored columns, leaf and node are told apart by the planner
    for k in reversed(range(len(hops))):
        line = F.when(F.col("passed").isNull(), F.array("node")).otherwise(F.concat(F.array("node"), "passed"))
        above = found.join(hops[k], ["conv_id", "node"], "left").select("conv_id", "leaf", "depth", F.posexplode(line).alias("n", "node"))
        found = above.select("conv_id", "leaf", "node", (F.col("depth") - F.col("n") * F.lit(4**k)).cast("long").alias("depth"))
        if k % 4 == 3:
            found = settle(found, "chat-paths")  # plans stay as short for deep trees
    return found.select("conv_id.conv_id", "leaf", "node", "depth")


def format_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf, formatted and loss_spans (start, end in code points) of each chosen path.

    Null texts and roles are formatted as empty. The spans cover the escaped texts of the
    assistant's turns. One conversation becomes one text, so a path has to fit into a row.
    """
    chosen = paths(nodes, branches).select(tree(), "leaf", "node", "depth").join(nodes.select(tree(), "node", "role", "text"), ["conv_id", "node"])
    role, body = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(BODY))
    pieces = chosen.select(
        "conv_id",
        "leaf",
        "depth",
        F.concat(head, body, F.lit(END + BREAK)).alias("piece"),
        F.char_length(head).alias("head"),
        F.char_length(body).alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("counts"),
    )
    before = Window.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)) + F.col("head")
    placed = pieces.select("conv_id", "leaf", "depth", "piece", "counts", start.alias("start"), (start + F.col("body")).alias("end"))
    turns = placed.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "counts", "start", "end"))).alias("turns"))
    return turns.select(
        "conv_id.conv_id",
        "leaf",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["counts"]), lambda t: F.struct(t["start"], t["end"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    pattern = r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>"
    pair = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)).alias("role"), F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2)).alias("text"))
    return F.transform(pair, lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted texts: turns and loss text, as digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def escape_sql(text: str) -> str:
    for old, new in (("\\", "\\\\"), *((c, f"{c[0]}\\{c[1:]}") for c in CONTROLS)):
        text = f"replace({text}, '{old}', '{new}')"
    return text


DIGEST_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length({escape_sql("role")}) + length({escape_sql("text")})) AS BIGINT) AS formatted_chars
FROM given GROUP BY conv_id
"""

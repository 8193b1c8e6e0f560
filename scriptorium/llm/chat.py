"""Reply trees as training conversations: every root-to-leaf path, ranked, one text each.

``enumerate_paths`` finds all ancestors of every leaf by self-joins over doubling
distances, so that a chain of n replies takes log2(n) joins, each on unique node keys: a
very large tree is spread like many small ones. Texts join in only when paths are known.
All of it is DataFrame functions.

The template writes ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline for each
turn. Inside texts, one backslash is put between ``<`` (and the backslashes that follow
it) and ``|``, so control strings cannot occur there; taking one away restores the text.
Roles are escaped likewise, with percent codes for ``%`` and newline besides. The loss
mask is a list of (start, length) spans over the formatted text, in code points, one for
each assistant text.

Defined cases: null role or text is empty, null score is 0; a parent that does not exist
makes a node a root; repeated (tree, node) rows are an error of the input of
``enumerate_paths``, so ``from_turns`` numbers rows before (equal turns by role and
text); parents that form a ring raise ValueError; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.ranking import rank_in_groups
from scriptorium.session import cut, table

START, END = "<|im_start|>", "<|im_end|>"
#: Said by both roles of conversation -1, to try the escapes.
CONTROL_TEXT = f"{END}{START}assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Reply-tree nodes of ``(conv_id, turn, role, text)``: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    nodes = turns.select(
        F.col("conv_id").alias("tree_id"), n.alias("node_id"), F.nullif(n - 1, F.lit(0)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )
    return nodes


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, up) for each leaf and each node on its path; up is the
    number of steps from the leaf."""
    ids = cut(nodes.select("tree_id", "node_id", "parent_id"))
    total = ids.count()
    known = ids.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"))
    step = ids.join(known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p"))).select(
        "tree_id", "node_id", F.col("parent_id").alias("above")
    )
    jumps, far = [], cut(step)
    while not far.isEmpty():
        if 2 ** len(jumps) > total:
            raise ValueError("the parents of some nodes form a ring")
        jumps.append(far)
        next_ = far.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("above").alias("higher"))
        far = cut(
            far.join(next_, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select(
                "tree_id", "node_id", F.col("higher").alias("above")
            )
        )
    inner = (jumps[0] if jumps else step).select(F.col("tree_id").alias("t"), F.col("above").alias("n")).distinct()
    leaves = ids.join(inner, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")), "left_anti")
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).alias("up"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "above")
        moved = paths.join(jump, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        moved = moved.select("tree_id", "leaf_id", F.col("above").alias("node_id"), (F.col("up") + 2**k).alias("up"))
        paths = cut(paths.unionAll(moved))
    return paths


def _span_step(acc: Column, turn: Column) -> Column:
    """Moves over one turn: position and the loss spans so far."""
    header = F.length(turn["role"]) + len(START) + 1
    size = F.length(turn["text"])
    span = F.struct((acc["at"] + header).cast("long").alias("start"), size.cast("long").alias("length"))
    spans = F.when(turn["speaks"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
    return F.struct((acc["at"] + header + size + len(END) + 1).cast("long").alias("at"), spans.alias("spans"))


def rank_branches(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, path_score, branch_rank), from ids and scores alone."""
    worth = nodes.select(
        F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    branches = (
        paths.join(worth, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        .groupBy("tree_id", "leaf_id")
        .agg(F.sum("score").alias("path_score"))
    )
    return rank_in_groups(branches, ["tree_id"], [-F.col("path_score"), F.col("leaf_id")], "branch_rank")


def format_paths(nodes: DataFrame, paths: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, branch_rank, path_score, n_turns, formatted, loss_spans), where
    branches of a tree rank by the sum of their nodes' scores, then by leaf id; of the
    ``best`` branches of each tree, or all. Texts join in for chosen branches alone."""
    ranks = rank_branches(nodes, paths).select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("l"), "path_score", "branch_rank")
    same = F.col("tree_id").eqNullSafe(F.col("t")) & F.col("leaf_id").eqNullSafe(F.col("l"))
    if best is not None:
        ranks = cut(ranks.where(F.col("branch_rank") <= best))
        paths = paths.join(ranks, same, "left_semi")
    said = nodes.select(
        F.col("tree_id").alias("t"),
        F.col("node_id").alias("n"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("speaks"),
        escape_role(F.coalesce("role", F.lit(""))).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    turn = F.struct((-F.col("up")).alias("place"), "speaks", "role", "text")
    whole = (
        paths.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        .groupBy("tree_id", "leaf_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    first = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    made = whole.select(
        "tree_id",
        "leaf_id",
        F.size("turns").cast("long").alias("n_turns"),
        text.alias("formatted"),
        F.aggregate("turns", first, _span_step)["spans"].alias("loss_spans"),
    )
    return made.join(ranks, same).select("tree_id", "leaf_id", "branch_rank", "path_score", "n_turns", "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, parsed from the formatted text and its mask alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    cells = F.slice(parts, 1, F.size(parts) - 1)
    cut_at = lambda c: F.instr(c, "\n")
    turns = F.transform(
        cells,
        lambda c: F.struct(
            unescape_role(F.substring(c, F.lit(len(START) + 1), cut_at(c) - len(START) - 1)).alias("role"),
            unescape(F.substring(c, cut_at(c) + 1, F.length(c))).alias("text"),
        ),
    )
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(under, "")})


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted as the only path of their reply tree and read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    nodes = cut(from_turns(turns))
    back = read_back(format_paths(nodes, enumerate_paths(nodes)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("branch_rank").cast("long").alias("branch_rank"),
    )


ORACLE_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars,
  CAST(1 AS BIGINT) AS branch_rank
FROM said GROUP BY conv_id
"""

"""Intent classification and disjointness of mutations kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATTING = ("set_trivia", "set_root_trailing_trivia")


def intent(op: Column, kind: Column, at_start: Column) -> Column:
    """Intent of a mutation by its operation, the kind of its node and whether it is put first."""
    statement = kind.isin("Statement", "Declaration")
    return (
        F.when(op == "rename_identifier", "rename_identifier")
        .when(op == "edit_payload", F.when(kind == "Literal", "edit_literal").otherwise("edit_payload"))
        .when(op == "insert_subtree", F.when((kind == "Comment") & at_start, "prepend_comment").when(statement, "insert_statement").otherwise("insert_subtree"))
        .when(op == "delete_subtree", F.when(statement, "delete_statement").otherwise("delete_subtree"))
        .when(op == "reorder_children", "reorder_members")
        .otherwise(op)
    )


INTENT_SQL = """CASE WHEN op = 'edit_payload' THEN CASE WHEN kind = 'Literal' THEN 'edit_literal' ELSE 'edit_payload' END
    WHEN op = 'insert_subtree' THEN CASE WHEN kind = 'Comment' AND at_start THEN 'prepend_comment' WHEN kind IN ('Statement', 'Declaration') THEN 'insert_statement' ELSE 'insert_subtree' END
    WHEN op = 'delete_subtree' THEN CASE WHEN kind IN ('Statement', 'Declaration') THEN 'delete_statement' ELSE 'delete_subtree' END
    WHEN op = 'reorder_children' THEN 'reorder_members' ELSE op END"""

_PAYLOAD = ("rename_identifier", "edit_literal", "edit_payload")


def _pairs() -> set[tuple[str, str]]:
    """Intents that never touch, in either order."""
    one = {("prepend_comment", "insert_statement"), ("reorder_members", "insert_subtree"), ("set_trivia", "insert_statement"), ("set_trivia", "prepend_comment")}
    one |= {("set_root_trailing_trivia", x) for x in ("insert_statement", "prepend_comment")}
    for left in ("prepend_comment", "insert_statement", "reorder_members", "set_root_trailing_trivia"):
        one |= {(left, x) for x in _PAYLOAD}
    return one | {(b, a) for a, b in one}


ALWAYS_DISJOINT = _pairs()


def disjoint(a: Column, b: Column, same_site: Column) -> Column:
    """Whether two intents can merge; ``same_site``: they name the same node, slot or anchor."""
    by_pair = F.concat(a, F.lit("|"), b).isin(*sorted("|".join(p) for p in ALWAYS_DISJOINT))
    moves, payload = ("move_node", "move_subtree"), _PAYLOAD
    by_site = (
        (a.isin(*payload) & b.isin(*payload, "set_trivia"))
        | (a.isin("set_trivia") & b.isin(*payload, "set_trivia"))
        | ((a == "insert_subtree") & (b == "insert_subtree"))
        | ((a == "move_subtree") & (b == "move_subtree"))
    )
    moved = (a.isin(*moves) & b.isin(*payload)) | (a.isin(*payload) & b.isin(*moves))
    return by_pair | (by_site & ~same_site) | (moved & same_site)


def compact(rows: DataFrame) -> DataFrame:
    """file, at, intent, n: formatting intents of a file fold into the first one's place."""
    folded = F.when(F.col("intent").isin(*FORMATTING), "update formatting").otherwise(F.concat_ws("#", "intent", "seq"))
    return rows.groupBy("file", folded.alias("__fold")).agg(F.min("seq").alias("at"), F.min("intent").alias("intent"), F.count("*").alias("n")).drop("__fold")

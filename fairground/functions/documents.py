"""Limits on JSON documents, told from the text without building the document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most characters in texts, most levels of nesting, most values.
MAX_TEXT, MAX_DEPTH, MAX_NODES = 500_000, 20, 10_000
STRINGS = r'"(?:\\.|[^"\\])*"'


def json_shape(x: Column) -> Column:
    """struct(depth, nodes, chars): levels of arrays and objects, the number of values, containers among them, and the characters in texts and keys.

    The text must be JSON; that is not checked here.
    """
    bare = F.regexp_replace(F.regexp_replace(x, STRINGS, "s"), r"\s+", "")
    opened = F.filter(F.split(bare, ""), lambda c: c.isin("[", "]", "{", "}"))
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    depth = F.aggregate(opened, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    # One value for the document, one for each comma, one for each container that isn't empty.
    nodes = 1 + F.regexp_count(bare, F.lit(",")) + F.regexp_count(bare, F.lit(r"[\[{](?![\]}])"))
    chars = F.length(x) - F.length(F.regexp_replace(x, STRINGS, "")) - 2 * F.regexp_count(x, F.lit(STRINGS))
    return F.struct(depth.alias("depth"), nodes.alias("nodes"), chars.alias("chars"))


def within_limits(x: Column, text: int = MAX_TEXT, depth: int = MAX_DEPTH, nodes: int = MAX_NODES) -> Column:
    """Whether a JSON text holds little text and few values and isn't nested deeply; null isn't."""
    shape = json_shape(x)
    return F.coalesce((shape["chars"] <= text) & (shape["depth"] <= depth) & (shape["nodes"] <= nodes), F.lit(False))

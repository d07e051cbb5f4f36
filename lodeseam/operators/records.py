"""Nested records as rows: shredded to one row a node, redacted, digested, compared, and put together again at any depth.

A record is a JSON text.  Each level of nesting is one pass over the nodes of the level above, so a task never holds more
than the members of one container, and records of any shape share the passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written
from .findings import SENSITIVE_KEYS

#: Members that differ between two runs of the same thing.
VOLATILE_KEYS = ("duration_ms", "trace_id", "timestamp", "elapsed_ms", "started_at", "finished_at")
NODE = ["id", "path", "parent", "depth", "place", "name", "kind", "value"]


def shred(records: DataFrame, drop: tuple[str, ...] = (), stop: str | None = None) -> DataFrame:
    """id, path, parent, depth, place, name, kind (object, array, string, other), value (of a leaf: text, or its JSON).

    ``records``: id, record (JSON text).  A path is a JSON Pointer; a member's name may hold anything.  ``place`` is a
    member's index in an array, and its rank by name in an object.  Members named in ``drop`` are left out with all that is
    below them; those whose name matches ``stop`` become the leaf [redacted].  A text that is not JSON is a string leaf, a
    null record has no nodes.
    """
    parsed = F.coalesce(F.try_parse_json("record"), F.try_parse_json(F.to_json(F.array("record")).substr(F.lit(2), F.length(F.to_json(F.array("record"))) - 2)))
    top = records.where("record is not null").select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("name"), parsed.alias("v"))
    levels, level = [], top
    while True:
        level = written(_typed(level, stop), "record-level")
        levels.append(level)
        inner = level.where("kind in ('object', 'array') and v is not null")
        if inner.isEmpty():
            break
        members = inner.select("id", "path", "depth", "kind", F.col("v").alias("_v")).lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        name = F.when(F.col("kind") == "object", F.col("key"))
        rows = members.select("id", F.concat("path", F.lit("/"), F.coalesce(F.when(F.col("kind") == "object", step), F.col("pos").cast("string"))).alias("path"), F.col("path").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("pos").alias("place"), name.alias("name"), F.col("value").alias("v"))
        level = rows.where(F.coalesce(~F.col("name").isin(*drop), F.lit(True))) if drop else rows
    return reduce(DataFrame.unionByName, [x.select(*NODE) for x in levels])


def _typed(nodes: DataFrame, stop: str | None) -> DataFrame:
    shape = F.schema_of_variant("v")
    hidden = F.coalesce(F.rlike("name", F.lit(stop)), F.lit(False)) if stop else F.lit(False)
    kind = F.when(hidden, "string").when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").when(shape == "STRING", "string").otherwise("other")
    value = F.when(hidden, F.lit("[redacted]")).when(kind == "string", F.try_variant_get("v", "$", "string")).when(kind == "other", F.to_json("v"))
    return nodes.withColumn("kind", kind).withColumn("value", value)


def assemble(nodes: DataFrame) -> DataFrame:
    """id, record: the JSON text of shredded nodes, members of objects by name."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    leaf = F.when(F.col("kind") == "string", quoted(F.col("value"))).when(F.col("kind") == "other", F.col("value"))
    text = nodes.select("id", "path", "parent", "depth", "place", "name", "kind", leaf.alias("json"))
    below = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = text.where(F.col("depth") == depth)
        if below is not None:
            parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda x: x["item"])
            joined = below.select("id", F.col("parent").alias("path"), "place", F.when(F.col("name").isNull(), F.col("json")).otherwise(F.concat(quoted(F.col("name")), F.lit(":"), "json")).alias("item"))
            level = level.join(joined.groupBy("id", "path").agg(F.array_join(parts, ",").alias("inner")), ["id", "path"], "left")
            inner = F.coalesce("inner", F.lit(""))
        else:
            inner = F.lit("")
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("json"))
        below = level.withColumn("json", whole).select("id", "path", "parent", "place", "name", "json")
    return below.select("id", F.col("json").alias("record"))


def redact_records(records: DataFrame) -> DataFrame:
    """id, record: at any depth, what a sensitive name holds replaced and every other text redacted; numbers and the rest as they were."""
    nodes = shred(records, stop=SENSITIVE_KEYS)
    hidden = F.coalesce(F.rlike("name", F.lit(SENSITIVE_KEYS)), F.lit(False))
    return assemble(nodes.withColumn("value", F.when((F.col("kind") == "string") & ~hidden, X.redact(F.col("value"))).otherwise(F.col("value"))))


def digests(nodes: DataFrame) -> DataFrame:
    """Nodes with digest: of a leaf its kind and value, of a container its members' names, places in arrays, and digests."""
    own = F.sha2(F.concat_ws("\0", "kind", F.coalesce("value", F.lit(""))), 256)
    below, levels = None, []
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is not None:
            parts = F.transform(F.sort_array(F.collect_list(F.struct(F.when(F.col("name").isNull(), F.col("place")).alias("p"), F.col("name").alias("n"), "digest"))), lambda x: F.concat_ws("\0", x["n"], x["digest"]))
            inner = below.groupBy("id", F.col("parent").alias("path")).agg(F.array_join(parts, "\1").alias("_inner"))
            level = level.join(inner, ["id", "path"], "left")
        else:
            level = level.withColumn("_inner", F.lit(None).cast("string"))
        container = F.col("kind").isin("object", "array")
        below = written(level.withColumn("digest", F.when(container, F.sha2(F.concat_ws("\0", "kind", F.coalesce("_inner", F.lit(""))), 256)).otherwise(own)).drop("_inner"), "record-digests")
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def compare(left: DataFrame, right: DataFrame, volatile: tuple[str, ...] = VOLATILE_KEYS) -> DataFrame:
    """id, path, change (added, removed, changed), before, after: where two sets of records (id, record) differ, volatile members apart.

    From the top, only containers whose digests differ are entered, so equal subtrees cost their top.  A container that only
    one side has is one row; an array's members are compared by index.
    """
    a, b = (digests(shred(x, drop=volatile)).select("id", "path", "parent", "depth", "kind", "value", "digest") for x in (left, right))
    renamed = lambda df, side: df.select("id", "path", "parent", *[F.col(c).alias(f"{c}_{side}") for c in ("kind", "value", "digest")], F.col("depth").alias(f"depth_{side}"))
    deepest = max(x.agg(F.max("depth")).first()[0] or 0 for x in (a, b))
    entered, found = None, []
    for depth in range(deepest + 1):
        l, r = (renamed(x.where(F.col("depth") == depth), side) for x, side in ((a, "a"), (b, "b")))
        if entered is not None:
            l, r = (x.join(entered.withColumnRenamed("path", "parent"), ["id", "parent"], "left_semi") for x in (l, r))
        both = l.join(r.drop("parent"), ["id", "path"], "full_outer").where("digest_a is null or digest_b is null or digest_a <> digest_b")
        both = written(both, "record-compare")
        inside = (F.col("kind_a") == F.col("kind_b")) & F.col("kind_a").isin("object", "array")
        change = F.when(F.col("digest_a").isNull(), "added").when(F.col("digest_b").isNull(), "removed").otherwise("changed")
        found.append(both.where(~F.coalesce(inside, F.lit(False))).select("id", "path", change.alias("change"), F.coalesce("value_a", "kind_a").alias("before"), F.coalesce("value_b", "kind_b").alias("after")))
        entered = both.where(inside).select("id", "path")
    return reduce(DataFrame.unionByName, found)

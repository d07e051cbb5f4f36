"""Joins that bind a relation's text reference to one symbol: exactly one candidate binds, more are ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(symbols: DataFrame, *keys: str) -> DataFrame:
    """keys, n (symbols of that name), target (the least): one row per name, so that a reference meets one row however hot the name is."""
    return symbols.groupBy(*keys).agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("target"))


def _by_name(symbols: DataFrame) -> DataFrame:
    return _known(symbols.select("symbol", F.col("qualified").alias("target_ref")), "target_ref").withColumn("method", F.lit("exact"))


def _by_suffix(symbols: DataFrame) -> DataFrame:
    """Every dotted suffix of a qualified name is a name: matching suffixes is an equi-join."""
    parts = F.split("qualified", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    rows = symbols.where(F.size(parts) > 2).select("symbol", suffix.alias("target_ref"))
    return _known(rows, "target_ref").withColumn("method", F.lit("suffix"))


def _by_file(symbols: DataFrame) -> DataFrame:
    return _known(symbols.select("symbol", "path", F.col("name").alias("target_ref")), "path", "target_ref").withColumn("method", F.lit("same_file"))


def _bare(ref: Column) -> Column:
    """Names that bind in their own file only; ``this``, ``super`` and ``self`` never do."""
    return ~F.contains(ref, F.lit(".")) & ~ref.isin("this", "super", "self")


def link_exact(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relation_id, n, target, method.  ``relations``: relation_id, path, target_ref; ``symbols``: symbol, path, name (short), qualified."""
    return relations.select("relation_id", "target_ref").join(_by_name(symbols), "target_ref").drop("target_ref")


def link_suffix(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dotted references that end a qualified name, itself not included."""
    return relations.select("relation_id", "target_ref").join(_by_suffix(symbols), "target_ref").drop("target_ref")


def link_same_file(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bare names within their own file."""
    bare = relations.where(_bare(F.col("target_ref"))).select("relation_id", "path", "target_ref")
    return bare.join(_by_file(symbols), ["path", "target_ref"]).drop("path", "target_ref")


def link(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relation_id, status (resolved, ambiguous, unresolved), target, method, confidence, inferred.

    By full name, else by suffix, else within the file: the first way with a candidate decides, and binds if it has just one.
    A relation that has a ``target`` already passes through as it is.  Bound here, it is inferred, and its ``confidence``
    (0.5 where none is given) is 0.9 at least.
    """
    given = F.col("target") if "target" in relations.columns else F.lit(None)
    sure = F.col("confidence") if "confidence" in relations.columns else F.lit(0.5)
    dotted = symbols.select("symbol", "qualified")
    order = F.when(F.col("method") == "exact", 0).otherwise(1)
    names = _by_name(dotted).unionByName(_by_suffix(dotted)).groupBy("target_ref").agg(F.min_by(F.struct("n", "target", "method"), order).alias("_named"))
    own = _by_file(symbols).select("path", "target_ref", F.struct("n", "target", "method").alias("_own"))
    kind = dict(symbols.dtypes)["symbol"]
    rows = relations.select("relation_id", "path", "target_ref", given.cast(kind).alias("_given"), F.coalesce(sure.cast("double"), F.lit(0.5)).alias("_sure"))
    rows = rows.join(names, "target_ref", "left").join(own, ["path", "target_ref"], "left")
    way = F.coalesce("_named", F.when(_bare(F.col("target_ref")), F.col("_own")))
    found = rows.select("relation_id", "_given", "_sure", way.alias("w"))
    one = F.col("_given").isNull() & (F.col("w.n") == 1)
    status = F.when(F.col("_given").isNotNull() | one, "resolved").when(F.col("w.n") > 1, "ambiguous").otherwise("unresolved")
    return found.select(
        "relation_id",
        status.alias("status"),
        F.coalesce("_given", F.when(one, F.col("w.target"))).alias("target"),
        F.when(F.col("_given").isNull(), F.col("w.method")).alias("method"),
        F.when(one, F.greatest("_sure", F.lit(0.9))).otherwise(F.col("_sure")).alias("confidence"),
        F.coalesce(one, F.lit(False)).alias("inferred"),
    )


def link_warnings(linked: DataFrame, relations: DataFrame) -> DataFrame:
    """relation_id, path, code, message: a row for each reference that more than one symbol could mean."""
    unclear = linked.where("status = 'ambiguous'").select("relation_id", "method")
    message = F.concat(F.lit("more than one symbol for "), F.col("target_ref"), F.lit(" by "), F.col("method"))
    return relations.join(unclear, "relation_id").select("relation_id", "path", F.lit("ambiguous_reference").alias("code"), message.alias("message"))


def relation_key(*parts: Column) -> Column:
    """A relation's id: a digest of snapshot, kind, source, reference and, once it is bound, its target."""
    return F.left(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(32))


def type_endpoints(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Endpoints that are ids of units move from the symbol columns to unit columns: source, target, source_unit, target_unit."""
    ids = units.select("unit_id").distinct()
    for end in ("source", "target"):
        relations = relations.join(ids.select(F.col("unit_id").alias(end), F.lit(True).alias("_unit")), end, "left")
        relations = relations.withColumn(f"{end}_unit", F.when(F.col("_unit"), F.col(end))).withColumn(end, F.when(F.col("_unit").isNull(), F.col(end))).drop("_unit")
    return relations


def link_reexported(relations: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """relation_id, target, method: references package.Class.method to a class that the package's module only imports.

    ``symbols``: symbol, kind (module, class, method), qualified; ``imports``: module (qualified name), imported (qualified
    name).  The package must be one module, by name or suffix, have one import that ends in the class, and that class one
    such method.
    """
    parts = F.split("target_ref", r"\.")
    n = F.size(parts)
    asked = relations.where(n >= 3).select(
        "relation_id", F.array_join(F.slice(parts, 1, n - 2), ".").alias("target_ref"), F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("name")
    )
    modules = symbols.where("kind = 'module'").select(F.col("qualified").alias("symbol"), "qualified")
    last = modules.where(F.contains("qualified", F.lit("."))).select("symbol", F.regexp_extract("qualified", r"([^.]+)$", 1).alias("target_ref"))
    named = _by_name(modules).unionByName(_by_suffix(modules)).unionByName(_known(last, "target_ref").withColumn("method", F.lit("suffix")))
    module = named.groupBy("target_ref").agg(F.min_by(F.struct("n", "target"), F.col("method")).alias("m")).where("m.n = 1").select("target_ref", F.col("m.target").alias("module"))
    imported = imports.select("module", F.regexp_extract("imported", r"([^.]+)$", 1).alias("class"), "imported").groupBy("module", "class").agg(F.count_distinct("imported").alias("n"), F.min("imported").alias("imported"))
    methods = _known(symbols.where("kind = 'method'").select("symbol", "qualified"), "qualified").where("n = 1").select("qualified", "target")
    found = asked.join(module, "target_ref").join(imported.where("n = 1").drop("n"), ["module", "class"])
    found = found.select("relation_id", F.concat_ws(".", "imported", "name").alias("qualified")).join(methods, "qualified")
    return found.select("relation_id", "target", F.lit("reexported").alias("method"))


def module_candidates(path: Column, target: Column) -> Column:
    """Names that an import in ``path`` may mean: a relative specifier's files, a relative Python module, or the target itself.

    Empty where a specifier climbs above the root.
    """
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("at"), F.lit(True).alias("ok"))

    def walk(a: Column, p: Column) -> Column:
        up = p == ".."
        at = F.when(up, F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0)))).when(p.isin("", "."), a["at"]).otherwise(F.concat(a["at"], F.array(p)))
        return F.struct(at.alias("at"), (a["ok"] & ~(up & (F.size(a["at"]) == 0))).alias("ok"))

    resolved = F.aggregate(F.concat(above, F.split(target, "/")), start, walk, lambda a: F.when(a["ok"], F.array_join(a["at"], "/")))
    kinds = F.array(*map(F.lit, (".js", ".jsx", ".ts", ".tsx")))
    own = F.when(F.rlike(F.lower(resolved), F.lit(r"\.(js|jsx|ts|tsx)$")), F.array(resolved)).otherwise(F.transform(kinds, lambda k: F.concat(resolved, k)))
    files = F.when(resolved.isNull(), none).otherwise(F.array_distinct(F.concat(own, F.transform(kinds, lambda k: F.concat(resolved, F.lit("/index"), k)))))
    level = F.char_length(F.regexp_extract(target, r"^(\.*)", 1))
    package = F.slice(above, 1, F.greatest(F.size(above) - level + 1, F.lit(0)))
    rest = F.regexp_replace(target, r"^\.+", "")
    python = F.array(F.array_join(F.when(rest != "", F.concat(package, F.array(rest))).otherwise(package), "."))
    specifier = (F.startswith(target, F.lit(".")) & F.contains(target, F.lit("/")))
    return F.when(specifier, files).when(F.startswith(target, F.lit(".")), python).otherwise(F.array(target))


def link_imports(relations: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports bound to modules (symbol, qualified): by candidate name, else by a dotted suffix.  relation_id, n, target, method."""
    named = relations.select("relation_id", F.explode(module_candidates(F.col("path"), F.col("target_ref"))).alias("qualified"))
    found = named.join(modules.select("symbol", "qualified"), "qualified")
    exact = found.groupBy("relation_id").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("target")).withColumn("method", F.lit("module"))
    rest = relations.join(exact.select("relation_id"), "relation_id", "left_anti")
    return exact.unionByName(link_suffix(rest, modules))

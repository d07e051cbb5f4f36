"""Maps of a corpus: file classes, counts, reading order, directory cards and the catalog tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Fixed values.
README_NAMES = ("readme.md", "readme.txt", "readme")
CONFIG_NAMES = (
    "package.json", "pyproject.toml", "requirements.txt", "setup.py", "vite.config.ts", "vite.config.js", "tsconfig.json", "dockerfile", "docker-compose.yml",
)
ENTRY_NAMES = ("main.py", "app.py", "server.py", "index.js", "index.ts", "main.ts", "main.tsx", "main.jsx")
DOC_SEGMENTS = ("docs", "doc", "documentation")
SOURCE_SEGMENTS = ("src", "app", "service", "services", "backend", "frontend", "desktop")
CLASSES = ("readme", "config", "source", "docs", "tests", "other")


def file_class(path: Column, language: Column) -> Column:
    low = F.lower(path)
    name, parts = X.file_name(low), F.split(low, "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(name.isin(*README_NAMES), "readme")
        .when(has(DOC_SEGMENTS) | F.coalesce(language == "markdown", F.lit(False)), "docs")
        .when(X.is_test_path(path), "tests")
        .when(name.isin(*CONFIG_NAMES) | F.coalesce(language.isin("json", "yaml", "toml"), F.lit(False)), "config")
        .when(has(SOURCE_SEGMENTS) | F.coalesce(language.isin("python", "javascript", "typescript"), F.lit(False)), "source")
        .otherwise("other")
    )


def is_entry(path: Column) -> Column:
    return X.file_name(F.lower(path)).isin(*ENTRY_NAMES)


def top_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("/")


def counts(files: DataFrame) -> DataFrame:
    """snapshot_id, facet (language, class, folder), value, files: three groupings in one pass.  ``files``: snapshot_id, path, language."""
    shaped = files.select("snapshot_id", "language", file_class(F.col("path"), F.col("language")).alias("class"), top_folder(F.col("path")).alias("folder"))
    sets = [["snapshot_id", c] for c in ("language", "class", "folder")]
    ids = [F.grouping(c).alias(f"_{c}") for c in ("language", "class", "folder")]
    rows = shaped.groupingSets(sets, "snapshot_id", "language", "class", "folder").agg(F.count(F.lit(1)).alias("files"), *ids)
    facet = F.when(F.col("_language") == 0, "language").when(F.col("_class") == 0, "class").otherwise("folder")
    return rows.select("snapshot_id", facet.alias("facet"), F.coalesce("language", "class", "folder").alias("value"), "files")


def reading_order(files: DataFrame, limit: int = 12) -> DataFrame:
    """snapshot_id, position, path: by class, entry points first, then depth and path."""
    priority = F.array_position(F.array(*map(F.lit, CLASSES)), file_class(F.col("path"), F.col("language")))
    order = Window.partitionBy("snapshot_id").orderBy(priority, F.when(is_entry(F.col("path")), 0).otherwise(1), F.size(F.split("path", "/")), "path")
    return files.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("snapshot_id", "position", "path")


def directory_cards(files: DataFrame, tops: int = 3) -> DataFrame:
    """snapshot_id, directory, parent, files, languages: every ancestor of every file, with its commonest languages."""
    parts = X.folders(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i * 0 + 1, i), "/"))
    rows = files.where(F.size(parts) > 0).select("snapshot_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.explode(above).alias("directory"))
    each = rows.groupBy("snapshot_id", "directory", "language").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "language"))), 1, tops), lambda x: x["language"])
    cards = each.groupBy("snapshot_id", "directory").agg(F.sum("n").alias("files"), F.array_join(ranked, ",").alias("languages"))
    return cards.withColumn("parent", F.when(F.contains("directory", F.lit("/")), F.regexp_replace("directory", "/[^/]*$", "")))


def overview(files: DataFrame) -> DataFrame:
    """One card per snapshot: files, folders, the five commonest languages, and what was not found."""
    each = files.select("snapshot_id", "path", F.coalesce("language", F.lit("unknown")).alias("language"), file_class(F.col("path"), F.col("language")).alias("class"), is_entry(F.col("path")).alias("entry"))
    by_language = each.groupBy("snapshot_id", "language").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "language"))), 1, 5), lambda x: x["language"])
    languages = by_language.groupBy("snapshot_id").agg(F.array_join(ranked, ",").alias("languages"))
    unknown = [("entry", F.max(F.col("entry").cast("int"))), ("tests", F.max((F.col("class") == "tests").cast("int"))), ("config", F.max((F.col("class") == "config").cast("int")))]
    missing = F.array_join(F.filter(F.array(*[F.when(m == 0, name) for name, m in unknown]), lambda x: x.isNotNull()), ",")
    cards = each.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(top_folder(F.col("path"))).alias("folders"), missing.alias("missing"))
    return cards.join(languages, "snapshot_id")


def reading_guide(files: DataFrame) -> DataFrame:
    """snapshot_id, stage (entry_points, configuration, modules, tests), position, path."""
    kind = file_class(F.col("path"), F.col("language"))
    stage = F.when(is_entry(F.col("path")), "entry_points").when(kind == "config", "configuration").when(kind == "tests", "tests").otherwise("modules")
    order = Window.partitionBy("snapshot_id", "stage").orderBy("path")
    return files.select("snapshot_id", stage.alias("stage"), "path").withColumn("position", F.row_number().over(order))


def is_catalog_entry(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files with ``entry``: an entry file's name, or a symbol named main in it.  ``symbols``: snapshot_id, path, name."""
    mains = symbols.where(F.lower("name") == "main").select("snapshot_id", "path").distinct().withColumn("_main", F.lit(True))
    return files.join(mains, ["snapshot_id", "path"], "left").withColumn("entry", is_entry(F.col("path")) | F.coalesce("_main", F.lit(False))).drop("_main")


def is_config(path: Column, language: Column) -> Column:
    return X.file_name(F.lower(path)).isin(*CONFIG_NAMES) | F.coalesce(F.lower(language).isin("json", "yaml", "toml"), F.lit(False))


def key_files(files: DataFrame, most: int = 12) -> DataFrame:
    """snapshot_id, facet (readme, config, entrypoints, docs, tests), position, path: the first ``most`` of each by path."""
    kind = file_class(F.col("path"), F.col("language"))
    facets = F.array(F.when(kind.isin("readme", "config", "docs", "tests"), kind), F.when(is_entry(F.col("path")), "entrypoints"))
    rows = files.select("snapshot_id", "path", F.explode(F.filter(facets, lambda f: f.isNotNull())).alias("facet")).distinct()
    order = Window.partitionBy("snapshot_id", "facet").orderBy("path")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("snapshot_id", "facet", "position", "path")


def top_folders(files: DataFrame, most: int = 12) -> DataFrame:
    """snapshot_id, position, folder, files: the largest first-level folders."""
    n = files.groupBy("snapshot_id", top_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    order = Window.partitionBy("snapshot_id").orderBy(F.desc("files"), "folder")
    return n.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("snapshot_id", "position", "folder", "files")


def summary_text(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """snapshot_id, summary: a few sentences made by rule from the map.  ``chunks``: snapshot_id, chunks."""
    languages = files.groupBy("snapshot_id", F.coalesce("language", F.lit("unknown")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "l"))), lambda x: x["l"])
    named = languages.groupBy("snapshot_id").agg(F.array_join(ranked, ", ").alias("languages"), F.sum("n").alias("files"))
    keys = key_files(files, 3).groupBy("snapshot_id").pivot("facet", ["readme", "entrypoints", "config"]).agg(F.sort_array(F.collect_list(F.struct("position", "path"))))
    listed = lambda c, n: F.array_join(F.transform(F.slice(c, 1, n), lambda x: x["path"]), ", ")
    said = lambda c, label, n: F.when(F.size(F.col(c)) > 0, F.concat(F.lit(label), listed(c, n), F.lit(".")))
    rows = named.join(keys, "snapshot_id", "left").join(chunks, "snapshot_id", "left")
    size = F.concat(F.col("files").cast("string"), F.lit(" files, mostly "), F.col("languages"), F.lit("."))
    indexed = F.when(F.coalesce("chunks", F.lit(0)) > 0, F.concat(F.col("chunks").cast("string"), F.lit(" chunks are indexed."))).otherwise(F.lit("Nothing is indexed yet."))
    return rows.select("snapshot_id", F.concat_ws(" ", size, said("readme", "Start with ", 1), said("entrypoints", "Entry points: ", 3), said("config", "Configuration: ", 3), indexed).alias("summary"))


def card_id(snapshot: Column, kind: Column, identity: Column) -> Column:
    return F.concat(F.lit("catalog_"), kind, F.lit("_"), F.left(F.sha2(F.concat_ws("\0", snapshot, kind, identity), 256), F.lit(24)))


def source_ids(evidence: DataFrame, *keys: str) -> DataFrame:
    """keys, source_ids: sorted distinct ids of the evidence of a path or card.  ``evidence``: keys, unit_id."""
    return evidence.where("unit_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_set("unit_id")).alias("source_ids"))


def symbol_cards(symbols: DataFrame) -> DataFrame:
    """snapshot_id, kind, title, path, summary, unknowns: a card per symbol (symbol, kind, name, qualified, path, signature)."""
    title = F.coalesce("qualified", "name", F.lit("symbol"))
    unknown = F.when(F.coalesce("signature", F.lit("")) == "", "no full signature").otherwise("")
    return symbols.select("snapshot_id", F.lit("symbol").alias("kind"), title.alias("title"), "path", F.concat_ws(" ", F.col("kind"), title, F.lit("in"), F.col("path")).alias("summary"), unknown.alias("unknowns"))


def file_cards(files: DataFrame, symbols: DataFrame, evidence: DataFrame) -> DataFrame:
    """snapshot_id, kind, title, path, categories, symbols, sources, unknowns: a card per file.

    ``files``: snapshot_id, path, language, is_test, parse_status; ``evidence``: snapshot_id, path, unit_id.
    """
    n = symbols.groupBy("snapshot_id", "path").agg(F.count(F.lit(1)).alias("symbols"))
    own = evidence.groupBy("snapshot_id", "path").agg(F.count_distinct("unit_id").alias("sources"))
    rows = is_catalog_entry(files, symbols).join(n, ["snapshot_id", "path"], "left").join(own, ["snapshot_id", "path"], "left")
    some = F.filter(F.array(F.when(F.col("entry"), "entry_point"), F.when(F.col("is_test"), "test"), F.when(is_config(F.col("path"), F.col("language")), "configuration")), lambda x: x.isNotNull())
    categories = F.when(F.size(some) > 0, F.array_join(some, ",")).otherwise("module")
    odd = F.when(~F.coalesce("parse_status", F.lit("parsed")).isin("parsed", "success", "succeeded"), F.concat(F.lit("parse status "), F.col("parse_status")))
    unknowns = F.concat_ws("; ", F.when(F.coalesce("sources", F.lit(0)) == 0, "no evidence"), odd)
    return rows.select(
        "snapshot_id", F.lit("file").alias("kind"), F.col("path").alias("title"), "path", categories.alias("categories"), F.coalesce("symbols", F.lit(0)).alias("symbols"),
        F.coalesce("sources", F.lit(0)).alias("sources"), unknowns.alias("unknowns"),
    )


def subsystem_cards(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """snapshot_id, kind, title, path, files, sources, unknowns: a card per first-level folder, root for files at the top."""
    top = lambda df: df.withColumn("_top", F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^([^/]*)/", 1)).otherwise("root"))
    n = top(files).groupBy("snapshot_id", "_top").agg(F.count_distinct("path").alias("files"))
    own = top(evidence).groupBy("snapshot_id", "_top").agg(F.count_distinct("unit_id").alias("sources"))
    rows = n.join(own, ["snapshot_id", "_top"], "left")
    return rows.select(
        "snapshot_id", F.lit("subsystem").alias("kind"), F.concat("_top", F.lit(" subsystem")).alias("title"), F.when(F.col("_top") != "root", F.col("_top")).alias("path"), "files",
        F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.coalesce("sources", F.lit(0)) == 0, "role unknown").otherwise("").alias("unknowns"),
    )


def parents(cards: DataFrame) -> DataFrame:
    """cards with card_id and parent_id: overview over subsystems, those over all of their directories, directories over files, files over symbols.

    ``cards``: snapshot_id, kind, identity (path, title or name), path.
    """
    identity = lambda kind, c: card_id(F.col("snapshot_id"), F.lit(kind), c)
    top = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^([^/]*)/", 1)).otherwise(F.col("path"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    parent = (
        F.when(F.col("kind") == "subsystem", identity("overview", F.lit("")))
        .when(F.col("kind") == "reading_guide", identity("overview", F.lit("")))
        .when(F.col("kind") == "directory", identity("subsystem", top))
        .when(F.col("kind") == "file", F.when(folder == "", identity("subsystem", F.lit("root"))).otherwise(identity("directory", folder)))
        .when(F.col("kind") == "symbol", identity("file", F.col("path")))
    )
    return cards.withColumn("card_id", card_id(F.col("snapshot_id"), F.col("kind"), F.col("identity"))).withColumn("parent_id", parent)


def tree(cards: DataFrame, levels: int = 5) -> DataFrame:
    """card_id, root_id, level, path_ids: every card below its root.  Cards whose parent is missing are roots.

    The catalog has five levels, so this is one join a level, on the parent.
    """
    ids = cards.select(F.col("card_id").alias("parent_id"))
    roots = cards.join(ids, "parent_id", "left_anti").select("card_id", F.col("card_id").alias("root_id"), F.lit(0).alias("level"), F.col("card_id").alias("path_ids"))
    found = at = roots
    for level in range(1, levels):
        below = cards.select("card_id", "parent_id").join(at.select(F.col("card_id").alias("parent_id"), "root_id", "path_ids"), "parent_id")
        at = below.select("card_id", "root_id", F.lit(level).alias("level"), F.concat_ws("/", "path_ids", "card_id").alias("path_ids"))
        found = found.unionByName(at)
    return found


def navigation_rows(cards: DataFrame, most: int = 12, each: int = 4) -> DataFrame:
    """snapshot_id, card_id, unit_id: up to ``each`` sources of the overview, guide and subsystem cards, ``most`` cards by kind and id."""
    chosen = cards.where(F.col("kind").isin("overview", "reading_guide", "subsystem"))
    order = Window.partitionBy("snapshot_id").orderBy("kind", "card_id")
    first = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.select("snapshot_id", "card_id", F.explode(F.slice("source_ids", 1, each)).alias("unit_id"))


def overview_answer(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """snapshot_id, files, summary, reading_order (paths, comma-joined): what an overview of a snapshot says."""
    n = files.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"))
    order = reading_order(files).groupBy("snapshot_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ",").alias("reading_order"))
    return n.join(summary_text(files, chunks), "snapshot_id").join(order, "snapshot_id", "left")

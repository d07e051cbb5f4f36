"""Cutting texts into units: line windows, token-budget chunks, headings, paragraphs, JSON keys, and rebuilding files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (from 1), line"""
    return docs.select(*keys, F.posexplode(X.split_lines(F.col("content"))).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def fixed_windows(docs: DataFrame, key: str, size: int = 40) -> DataFrame:
    """Windows of ``size`` lines: key, start_line, end_line, content, n_words.  Cut inside the row: nothing shuffles."""
    whole = docs.select(key, X.split_lines(F.col("content")).alias("l")).where(F.size("l") > 0)
    starts = whole.select(key, "l", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(size))).alias("start_line"))
    cut = starts.select(key, "start_line", F.slice("l", F.col("start_line"), F.lit(size)).alias("own"))
    content = F.array_join("own", "\n")
    return cut.select(key, "start_line", (F.col("start_line") + F.size("own") - 1).alias("end_line"), content.alias("content"), F.regexp_count(content, F.lit(r"\S+")).alias("n_words"))


def token_chunks(docs: DataFrame, key: str, max_tokens: int = 600) -> DataFrame:
    """Greedy runs of lines of at most ``max_tokens`` estimated tokens (a longer line stands alone): key, chunk, start_line, end_line, tokens.

    A fold over the row's line sizes; the state is the list of finished chunks and the open one.
    """
    sized = docs.select(key, F.transform(X.split_lines(F.col("content")), X.estimate_tokens).alias("sizes")).where(F.size("sizes") > 0)
    run = lambda start, end, tokens: F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), tokens.cast("int").alias("tokens"))
    none = F.expr("cast(array() as array<struct<start_line: int, end_line: int, tokens: int>>)")
    state = F.struct(none.alias("done"), F.lit(1).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("tokens"))

    def step(a, n):
        full = (a["at"] >= a["start"]) & (a["tokens"] + n > max_tokens)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(run(a["start"], a["at"], a["tokens"])))).otherwise(a["done"]).alias("done"),
            F.when(full, a["at"] + 1).otherwise(a["start"]).alias("start"),
            (a["at"] + 1).alias("at"),
            (F.when(full, 0).otherwise(a["tokens"]) + n).alias("tokens"),
        )

    folded = F.aggregate("sizes", state, step, lambda a: F.concat(a["done"], F.array(run(a["start"], a["at"], a["tokens"]))))
    return sized.select(key, F.posexplode(folded).alias("chunk", "c")).select(key, "chunk", "c.*")


def slices(units: DataFrame, key: str, max_tokens: int = 600, overlap_tokens: int = 60) -> DataFrame:
    """key, slice (from 0), start_line, end_line, tokens, content: units over ``max_tokens`` cut into greedy runs of lines.

    ``units``: key, start_line, content.  A run starts with the last line of the one before it if that line has at most
    ``overlap_tokens`` and leaves room for the next.  Units within the limit or of one line stay whole.  A fold over each
    row's lines; nothing shuffles.
    """
    lines_ = X.split_lines(F.col("content"))
    sized = units.select(key, F.col("start_line").alias("_from"), lines_.alias("_l"), F.transform(lines_, X.estimate_tokens).alias("_s")).where(F.size("_l") > 0)
    total = F.aggregate("_s", F.lit(0), lambda a, n: a + n)
    run = lambda start, end, tokens: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), tokens.cast("int").alias("tokens"))
    none = F.expr("cast(array() as array<struct<start: int, end: int, tokens: int>>)")
    state = F.struct(none.alias("done"), F.lit(1).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("tokens"), F.lit(0).alias("last"))

    def step(a, n):
        full = (a["at"] >= a["start"]) & (a["tokens"] + n > max_tokens)
        back = full & (a["last"] <= overlap_tokens) & (a["last"] + n <= max_tokens) & (a["at"] > a["start"])
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(run(a["start"], a["at"], a["tokens"])))).otherwise(a["done"]).alias("done"),
            F.when(back, a["at"]).when(full, a["at"] + 1).otherwise(a["start"]).alias("start"),
            (a["at"] + 1).alias("at"),
            (F.when(back, a["last"]).when(full, 0).otherwise(a["tokens"]) + n).alias("tokens"),
            n.alias("last"),
        )

    folded = F.aggregate("_s", state, step, lambda a: F.concat(a["done"], F.array(run(a["start"], a["at"], a["tokens"]))))
    whole = F.array(run(F.lit(1), F.size("_l"), total))
    cut = F.when((total <= max_tokens) | (F.size("_l") == 1), whole).otherwise(folded)
    rows = sized.select(key, "_from", "_l", F.posexplode(cut).alias("slice", "c"))
    content = F.array_join(F.slice("_l", F.col("c.start"), F.col("c.end") - F.col("c.start") + 1), "\n")
    first = F.col("_from") - 1
    return rows.select(key, "slice", (first + F.col("c.start")).alias("start_line"), (first + F.col("c.end")).alias("end_line"), F.col("c.tokens").alias("tokens"), content.alias("content"))


def headings(docs: DataFrame, key: str) -> DataFrame:
    """ATX headings outside fenced code: key, line_no, level, title.  Fences are followed inside each row."""
    state = F.struct(F.lit(0).alias("fences"), F.expr("cast(array() as array<struct<line_no: int, line: string>>)").alias("found"), F.lit(0).alias("at"))

    def step(a, line):
        fences = a["fences"] + F.rlike(line, F.lit(r"^\s*(```|~~~)")).cast("int")
        here = (fences % 2 == 0) & F.rlike(line, F.lit(r"^#{1,6}\s+\S"))
        item = F.array(F.struct((a["at"] + 1).alias("line_no"), line.alias("line")))
        return F.struct(fences.alias("fences"), F.when(here, F.concat(a["found"], item)).otherwise(a["found"]).alias("found"), (a["at"] + 1).alias("at"))

    # most texts have none: the fold runs only over texts with a line that starts like a heading
    some = docs.where(F.rlike("content", F.lit(r"(?m)^#{1,6}\s")))
    rows = some.select(key, F.explode(F.aggregate(X.split_lines(F.col("content")), state, step, lambda a: a["found"])).alias("h")).select(key, "h.line_no", "h.line")
    return rows.select(key, "line_no", F.char_length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+|\s+#*\s*$", "")).alias("title"))


def paragraphs(docs: DataFrame, key: str) -> DataFrame:
    """Runs of lines between blank ones: key, paragraph (from 1), start_line, end_line, n_chars.

    A line is marked by whether it is blank and the one before it was; the starts are then zipped with the ends, all inside
    the row.
    """
    whole = docs.select(key, X.split_lines(F.col("content")).alias("l"))
    blank = lambda x: F.trim(x) == ""
    at = F.transform("l", lambda x, i: F.struct(i.alias("i"), blank(x).alias("b"), F.coalesce(blank(F.get("l", i - 1)), F.lit(True)).alias("p"), F.coalesce(blank(F.get("l", i + 1)), F.lit(True)).alias("n")))
    marked = whole.select(key, "l", at.alias("m"))
    starts = F.transform(F.filter("m", lambda x: ~x["b"] & x["p"]), lambda x: x["i"])
    ends = F.transform(F.filter("m", lambda x: ~x["b"] & x["n"]), lambda x: x["i"])
    rows = marked.select(key, "l", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("p", "x"))
    own = F.slice("l", F.col("x.s") + 1, F.col("x.e") - F.col("x.s") + 1)
    chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return rows.select(key, (F.col("p") + 1).cast("long").alias("paragraph"), (F.col("x.s") + 1).alias("start_line"), (F.col("x.e") + 1).alias("end_line"), chars.alias("n_chars"))


def split_paragraphs(units: DataFrame, key: str, most: int = 1500, overlap: int = 120) -> DataFrame:
    """key, part (from 0), start_line, end_line, content: paragraphs over ``most`` characters cut at lines.

    ``units``: key, start_line, content.  A part starts with the last lines of the one before it that have ``overlap``
    characters together; a longer line stands alone.  No line is lost.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, start, content in zip(f[key], f["start_line"], f["content"], strict=True):
                lines_ = (content or "").split("\n")
                at, first, size, part = 0, 0, 0, 0
                while at < len(lines_):
                    n = len(lines_[at]) + 1
                    if size and size + n > most:
                        out.append((k, part, start + first, start + at - 1, "\n".join(lines_[first:at])))
                        back, got = at, 0
                        while back > first + 1 and got < overlap:
                            back -= 1
                            got += len(lines_[back]) + 1
                        if got + n > most:
                            back, got = at, 0
                        first, size, part = back, got, part + 1
                    size += n
                    at += 1
                out.append((k, part, start + first, start + len(lines_) - 1, "\n".join(lines_[first:])))
            yield pd.DataFrame(out, columns=[key, "part", "start_line", "end_line", "content"])

    kind = dict(units.dtypes)[key]
    return units.select(key, "start_line", "content").mapInPandas(each, f"{key} {kind}, part int, start_line int, end_line int, content string")


def rebuild(chunks: DataFrame, key: str) -> DataFrame:
    """Files from overlapping chunks (key, start_line, content): of a line's copies the first that is not empty stays; gaps are empty.

    Returns key, n_lines, content.
    """
    rows = chunks.select(key, "start_line", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    best = rows.groupBy(key, (F.col("start_line") + F.col("p")).alias("line_no")).agg(
        F.coalesce(F.min_by(F.when(F.col("line") != "", F.col("line")), F.when(F.col("line") != "", F.col("start_line"))), F.lit("")).alias("line")
    )
    whole = best.groupBy(key).agg(F.max("line_no").alias("n_lines"), F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_lines")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "\n")
    return whole.select(key, "n_lines", text.alias("content"))


def json_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Top-level keys of a JSON object column: key, json_path, value (text)."""
    pairs = rows.select(key, F.explode(F.from_json(value, "map<string,string>")).alias("k", "value"))
    return pairs.select(key, F.concat(F.lit("$."), F.col("k")).alias("json_path"), "value")


#: Files that lock versions; nothing in them is worth a row.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock")


def config_rows(docs: DataFrame) -> DataFrame:
    """snapshot_id, path, ord, json_path, name, kind (object or value), value, parent: every node of JSON and TOML files.

    The root is ``$``.  Keys go in the order of their text.  Lock files give nothing; a file that does not parse, or of a
    form there is no parser for, gives one row of kind ``fallback``.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import tomllib

        for f in frames:
            out: list[tuple] = []
            for snapshot, path, content in zip(f["snapshot_id"], f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1].lower()
                if name in LOCK_FILES:
                    continue
                try:
                    if not name.endswith((".json", ".toml")):
                        raise ValueError(name)
                    root = json.loads(content or "") if name.endswith(".json") else tomllib.loads(content or "")
                except (ValueError, RecursionError):
                    out.append((snapshot, path, 0, "$", None, "fallback", content, None))
                    continue
                todo, n = [("$", None, None, root)], 0
                while todo:
                    at, key, parent, value = todo.pop()
                    inner = isinstance(value, dict | list)
                    out.append((snapshot, path, n, at, key, "object" if inner else "value", None if inner else json.dumps(value, default=str, ensure_ascii=False), parent))
                    n += 1
                    below = sorted(((str(k), v) for k, v in value.items()), key=lambda x: x[0]) if isinstance(value, dict) else []
                    below = [(f"{at}.{k}", k, at, v) for k, v in below]
                    if isinstance(value, list):
                        below = [(f"{at}[{i}]", key, at, v) for i, v in enumerate(value)]
                    todo += reversed(below)
            yield pd.DataFrame(out, columns=["snapshot_id", "path", "ord", "json_path", "name", "kind", "value", "parent"])

    schema = "snapshot_id string, path string, ord int, json_path string, name string, kind string, value string, parent string"
    return docs.select("snapshot_id", "path", "content").mapInPandas(each, schema)


def key_lines(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """key, ord, line_no: where the n-th row of a name stands, the n-th line that holds it; rows without such a line are left out.

    ``rows``: key, ord, name; ``docs``: key, content.
    """
    tokens = F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_.-]+)")))
    held = lines(docs, key).select(key, "line_no", F.explode(tokens).alias("name")).join(rows.select(key, "name").distinct(), [key, "name"], "left_semi")
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy(key, "name").orderBy("line_no")))
    asked = rows.where("name is not null").withColumn("_n", F.row_number().over(Window.partitionBy(key, "name").orderBy("ord")))
    return asked.select(key, "ord", "name", "_n").join(held, [key, "name", "_n"]).select(key, "ord", "line_no")


_FACT = "snapshot_id string, path string, fact string, kind string, name string, target string, start_line int, end_line int, is_async boolean, signature string, decorators string, alias string, confidence double"


def python_symbols(docs: DataFrame) -> DataFrame:
    """Modules, classes and functions of Python sources, and what they contain, import, inherit and call.

    One tagged row per fact: snapshot_id, path, fact ('symbol', 'relation' or 'diagnostic'), kind, name (qualified; of a
    relation the source), target, start_line, end_line, is_async, signature, decorators (comma-joined), alias (of an import)
    and confidence (of a call: 1 for a name of the module itself, 0.95 through an import or self).  An import counts in the
    class or function it stands in, and below.  A file that does not parse, or is nested too deeply, gives a diagnostic.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        from collections import deque

        def bound(head: str, owner: str, imported: dict[tuple[str, str], str]) -> str | None:
            """What a name was imported as, in its own scope or one around it."""
            while True:
                if (owner, head) in imported:
                    return imported[owner, head]
                if "." not in owner:
                    return None
                owner = owner.rpartition(".")[0]

        columns = [c.split()[0] for c in _FACT.split(", ")]
        for f in frames:
            out: list[tuple] = []
            for snapshot, path, content in zip(f["snapshot_id"], f["path"], f["content"], strict=True):
                module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")

                def add(fact, kind, name, target, line, end, head=(snapshot, path), is_async=False, signature=None, decorators=None, alias=None, confidence=None):
                    out.append((*head, fact, kind, name, target, line, end, is_async, signature, decorators, alias, confidence))

                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
                    line = getattr(e, "lineno", None) or 1
                    add("diagnostic", "syntax_error", module, str(e)[:200] or "nested too deeply", line, line)
                    continue
                before = len(out)
                add("symbol", "module", module, None, 1, max(1, len((content or "").splitlines())))
                imported: dict[tuple[str, str], str] = {}
                own = {n.name for n in tree.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)}
                todo = deque((n, module, "module", "") for n in tree.body)
                try:
                    while todo:
                        node, owner, inside, class_ = todo.popleft()
                        name = owner
                        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                            name = f"{owner}.{node.name}"
                            is_class = isinstance(node, ast.ClassDef)
                            kind = "class" if is_class else "method" if inside == "class" else "function"
                            signature = f"class {node.name}" if is_class else f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                            add("symbol", kind, name, None, node.lineno, node.end_lineno, is_async=isinstance(node, ast.AsyncFunctionDef), signature=signature, decorators=",".join(map(ast.unparse, node.decorator_list)))
                            add("relation", "contains", owner, name, node.lineno, node.lineno, confidence=1.0)
                            if is_class:
                                for b in node.bases:
                                    add("relation", "inherits", name, ast.unparse(b), node.lineno, node.lineno, confidence=1.0)
                                class_ = name
                            inside = "class" if is_class else "function"
                        elif isinstance(node, ast.Import):
                            for a in node.names:
                                imported[owner, a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                                add("relation", "imports", owner, a.name, node.lineno, node.lineno, alias=a.asname, confidence=1.0)
                        elif isinstance(node, ast.ImportFrom):
                            base = "." * node.level + (node.module or "")
                            for a in node.names:
                                target = f"{base}.{a.name}" if node.module else f"{base}{a.name}"
                                imported[owner, a.asname or a.name] = target
                                add("relation", "imports", owner, target, node.lineno, node.lineno, alias=a.asname, confidence=1.0)
                        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
                            said = ast.unparse(node.func)
                            head, _, rest = said.partition(".")
                            if head in ("self", "cls") and class_ and rest:
                                target, sure = f"{class_}.{rest}", 0.95
                            elif (origin := bound(head, owner, imported)) is not None:
                                target, sure = origin + (f".{rest}" if rest else ""), 0.95
                            else:
                                target, sure = (f"{module}.{said}", 1.0) if said in own else (said, 0.5)
                            add("relation", "calls", owner, target, node.lineno, node.lineno, confidence=sure)
                        todo += [(c, name, inside, class_) for c in ast.iter_child_nodes(node)]
                except RecursionError:
                    del out[before:]
                    add("diagnostic", "syntax_error", module, "nested too deeply", 1, 1)
            yield pd.DataFrame(out, columns=columns)

    return docs.select("snapshot_id", "path", "content").mapInPandas(each, _FACT)


def function_slices(docs: DataFrame, max_tokens: int = 600) -> DataFrame:
    """path, name, slice (from 0), start_line, end_line of Python functions over ``max_tokens``: cut where nested definitions start, else by lines."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        import re

        token = re.compile(X.TOKEN_ESTIMATE.removeprefix("(?U)"))
        size = lambda part: sum(len(token.findall(x)) for x in part)
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                lines_ = (content or "").splitlines()
                for node in ast.walk(tree):
                    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) or size(lines_[node.lineno - 1 : node.end_lineno]) <= max_tokens:
                        continue
                    starts = sorted({n.lineno for n in node.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)} | {node.lineno})
                    if len(starts) == 1:
                        used = 0
                        for k in range(node.lineno, node.end_lineno + 1):
                            n = size(lines_[k - 1 : k])
                            if used and used + n > max_tokens:
                                starts.append(k)
                                used = 0
                            used += n
                    ends = [s - 1 for s in starts[1:]] + [node.end_lineno]
                    out += [(path, node.name, i, s, e) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
            yield pd.DataFrame(out, columns=["path", "name", "slice", "start_line", "end_line"])

    return docs.select("path", "content").mapInPandas(each, "path string, name string, slice int, start_line int, end_line int")


def top_level_nodes(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, skipped): classes and functions directly below their module, and how many files of each other extension there are."""
    modules = facts.where("fact = 'symbol' and kind = 'module'").select("snapshot_id", "path", F.col("name").alias("_m"))
    symbols = facts.where("fact = 'symbol' and kind in ('class', 'function')").join(modules, ["snapshot_id", "path"])
    nodes = symbols.where(F.regexp_replace("name", r"\.[^.]*$", "") == F.col("_m")).drop("_m")
    extension = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    skipped = files.where(extension != ".py").groupBy("snapshot_id", extension.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    return nodes, skipped


def parser_for(path: Column, language: Column) -> Column:
    """The first parser that takes a file: python, markdown, config, else fallback."""
    low = F.lower(path)
    return (
        F.when((language == "python") | F.endswith(low, F.lit(".py")), "python")
        .when((language == "markdown") | F.endswith(low, F.lit(".md")), "markdown")
        .when(language.isin("json", "yaml", "toml") | F.rlike(low, F.lit(r"\.(json|ya?ml|toml)$")), "config")
        .otherwise("fallback")
    )


def parse(docs: DataFrame) -> DataFrame:
    """snapshot_id, path, parser, fact, kind, name, start_line, end_line: what each file's parser finds.

    ``docs``: snapshot_id, path, language, content.  One job per parser over its own files.  A file without any fact gets the
    fallback's row, one for the whole file; a failing file gives a diagnostic and never stops the job.
    """
    routed = docs.withColumn("parser", F.coalesce(parser_for(F.col("path"), F.col("language")), F.lit("fallback")))
    of = lambda name: routed.where(F.col("parser") == name)
    shape = ["snapshot_id", "path", "parser", "fact", "kind", "name", "start_line", "end_line"]
    python = python_symbols(of("python")).where("fact <> 'relation'").withColumn("parser", F.lit("python")).select(*shape)
    keyed = of("markdown").withColumn("_k", F.concat_ws("\0", "snapshot_id", "path"))
    parts = F.split("_k", "\0")
    line = F.col("line_no")
    markdown = markdown_sections(keyed, "_k").select(
        parts[0].alias("snapshot_id"), parts[1].alias("path"), F.lit("markdown").alias("parser"), F.lit("unit").alias("fact"), F.lit("section").alias("kind"), F.col("section").alias("name"), line.alias("start_line"), line.alias("end_line")
    )
    config = config_rows(of("config")).where("kind <> 'fallback'").select(
        "snapshot_id", "path", F.lit("config").alias("parser"), F.lit("unit").alias("fact"), "kind", F.col("json_path").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")
    )
    facts = python.unionByName(markdown).unionByName(config)
    empty = routed.join(facts.where("fact <> 'diagnostic'").select("snapshot_id", "path").distinct(), ["snapshot_id", "path"], "left_anti")
    size = F.greatest(F.size(X.split_lines(F.col("content"))), F.lit(1))
    fallback = empty.select("snapshot_id", "path", F.lit("fallback").alias("parser"), F.lit("unit").alias("fact"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.lit(1).alias("start_line"), size.alias("end_line"))
    return facts.unionByName(fallback)


def markdown_sections(docs: DataFrame, key: str) -> DataFrame:
    """Sections of Markdown texts: key, line_no, level, title, section (path of titles; repeats are numbered), parent.

    ATX and underlined headings outside code fences.  A stack of open sections runs over each text's headings.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        fence_mark, atx, under = re.compile(r"\s*(`{3,}|~{3,})"), re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"(=+|-+)\s*$")
        for f in frames:
            out = []
            for k, text in zip(f[key], f["content"], strict=True):
                lines, fence, found, at = (text or "").splitlines(), None, [], 0
                while at < len(lines):
                    line = lines[at]
                    mark = fence_mark.match(line)
                    if mark:
                        char = mark[1][0]
                        fence = None if fence == char else fence or char
                    elif fence is None:
                        head = atx.match(line)
                        below = under.match(lines[at + 1]) if at + 1 < len(lines) and line.strip() else None
                        if head and head[2]:
                            found.append((len(head[1]), head[2], at + 1))
                        elif below and not head:
                            found.append((1 if below[1][0] == "=" else 2, line.strip(), at + 1))
                            at += 1
                    at += 1
                open_: list[tuple[int, str]] = []
                times: dict[str, int] = {}
                for level, title, line_no in found:
                    while open_ and open_[-1][0] >= level:
                        open_.pop()
                    parent = open_[-1][1] if open_ else None
                    path = f"{parent}/{title}" if parent else title
                    times[path] = times.get(path, 0) + 1
                    section = path if times[path] == 1 else f"{path}[{times[path]}]"
                    open_.append((level, section))
                    out.append((k, line_no, level, title, section, parent))
            yield pd.DataFrame(out, columns=[key, "line_no", "level", "title", "section", "parent"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "content").mapInPandas(each, f"{key} {kind}, line_no int, level int, title string, section string, parent string")


def repoint(references: DataFrame, remap: DataFrame, columns: list[str]) -> DataFrame:
    """References moved to the first slice of a unit that was split: ``remap`` has old_id, new_id; other ids stay."""
    for c in columns:
        moved = remap.select(F.col("old_id").alias(c), F.col("new_id").alias("_new"))
        references = references.join(moved, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return references

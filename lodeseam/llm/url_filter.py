"""URL filters over a sorted digest array.

Entries (rules and blocked hosts) are kept as a sorted array of 64-bit xxhash keys beside the entry strings.  Spark sends
the two files to the executors; workers memory-map the keys, probe a batch of candidate strings with one vectorised binary
search, and compare every hit with the stored string, so a collision of keys decides nothing.

A URL yields a candidate for each domain its host belongs to and each prefix length of its path that some entry has; the
longest entry among the hits wins.  The entry list is an argument of the job, checked against ``MAX_ENTRIES``; a list
beyond that goes through ``filter_by_join``, which spreads the same candidates over a shuffle instead.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; hosts keep
ports and user info; a null ``page_id`` is kept; repeated pages are judged alike; a very long URL is probed by its domains
and the entries' prefix lengths only; ties in length cannot be, as entries of a page differ in length or text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_documents, table

#: Entries of a digest array that is sent to every executor: about 100 bytes each.
MAX_ENTRIES = 1_000_000

#: Rules (verdict, host, path): fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Sites that are blocked where no rule speaks.
BLOCKED_SITES = (
    "casino-win.example.com",
    "casino-win.example.net",
    "casino-win.example.org",
    "cheap-pills.example.com",
    "cheap-pills.example.net",
    "cheap-pills.example.org",
    "free-bets.example.com",
    "free-bets.example.net",
    "free-bets.example.org",
    "spam-farm.example.com",
    "spam-farm.example.net",
    "spam-farm.example.org",
)


class DigestArray:
    """Strings with a byte of value each, by sorted 64-bit key.  All four files are memory-mapped: keys, ends of the strings,
    values, and the strings themselves."""

    def __init__(self, folder: str, name: str):
        self.keys, self.ends, self.values = (np.load(f"{folder}/{name}.{x}.npy", mmap_mode="r") for x in ("keys", "ends", "values"))
        self.text = np.memmap(f"{folder}/{name}.text", dtype=np.uint8, mode="r") if os.path.getsize(f"{folder}/{name}.text") else np.empty(0, np.uint8)

    @staticmethod
    def build(entries: dict[str, int], folder: str, name: str) -> list[str]:
        """Write the files; ``entries``: value (0 to 254) of each string."""
        rows = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode(), v) for e, v in entries.items())
        paths = [f"{folder}/{name}.{x}" for x in ("keys.npy", "ends.npy", "values.npy", "text")]
        np.save(paths[0], np.array([k for k, _, _ in rows], dtype=np.uint64))
        np.save(paths[1], np.cumsum([0] + [len(e) for _, e, _ in rows], dtype=np.int64))
        np.save(paths[2], np.array([v for _, _, v in rows], dtype=np.uint8))
        with open(paths[3], "wb") as out:
            out.writelines(e for _, e, _ in rows)
        return paths

    def entry(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]].tobytes()

    def values_of(self, probes: list[bytes]) -> np.ndarray:
        """The value of each probe that is stored, else 255."""
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(probes), 255, dtype=np.uint8)
        for i in np.nonzero(at < len(self.keys))[0]:
            j = at[i]
            while j < len(self.keys) and self.keys[j] == keys[i]:  # strings that share a key stand together
                if self.entry(j) == probes[i]:
                    found[i] = self.values[j]
                    break
                j += 1
        return found


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1).alias("path"))


def domains(host: str, longest: int) -> Iterator[str]:
    """The host and the domains above it, of at most ``longest`` characters: no entry is longer."""
    if len(host) <= longest:
        yield host
        at = host.find(".")
    else:
        at = host.find(".", len(host) - longest - 1)
    while at >= 0:
        yield host[at + 1 :]
        at = host.find(".", at + 1)


def _candidates(host: str, path: str, lengths: list[int], longest: int) -> list[tuple[str, int]]:
    """(entry string, its rank): longer entries first."""
    found = [(d + path[:n], n) for d in domains(host, longest) for n in lengths if n <= len(path)] if host else []
    return sorted(found, key=lambda x: (-len(x[0]), x[0]))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, blocked: tuple[str, ...] = BLOCKED_SITES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict."""
    verdicts = {host + path: int(verdict == "block") for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules})
    longest = max((len(x) for x in (*(host for _, host, _ in rules), *blocked)), default=0)
    if len(verdicts) + len(blocked) > MAX_ENTRIES:
        return filter_by_join(pages, pages.sparkSession.createDataFrame([(h + p, v) for v, h, p in rules], "rule string, verdict string"), lengths, blocked)
    name = f"urls-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="digest-")
    context = pages.sparkSession.sparkContext
    for path in DigestArray.build(verdicts | {f"!{site}": 1 for site in blocked}, folder, name):
        context.addFile(path)  # each executor fetches its own copy, and a replaced one fetches it again

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestArray(SparkFiles.getRootDirectory(), name)
        for f in frames:
            probes: list[bytes] = []
            owner: list[tuple[int, str]] = []
            for i, (host, path) in enumerate(zip(f["host"], f["path"], strict=True)):
                for entry, _ in _candidates(host, path, lengths, longest):
                    probes.append(entry.encode("utf-8", "surrogatepass"))
                    owner.append((i, entry))
                for site in domains(host, longest) if host else ():
                    probes.append(b"!" + site.encode("utf-8", "surrogatepass"))
                    owner.append((i, ""))
            rule: list[str | None] = [None] * len(f)
            verdict = ["allow"] * len(f)
            values = index.values_of(probes)
            for k in np.flatnonzero(values != 255):  # a page's rules come before its sites, longer rules before shorter ones
                i, entry = owner[k]
                if rule[i] is None:
                    rule[i] = entry or None
                    verdict[i] = "block" if values[k] else "allow"
            yield pd.DataFrame({"page_id": f["page_id"], "host": f["host"], "path": f["path"], "rule": rule, "verdict": verdict})

    return map_documents(with_parts(pages), ["host", "path"], batch, "host string, path string, rule string, verdict string", "page_id")


def filter_by_join(pages: DataFrame, rules: DataFrame, lengths: list[int], blocked: Iterable[str] | DataFrame) -> DataFrame:
    """The same verdicts where the entries are too many to send around.  ``rules``: rule, verdict; ``blocked``: site.

    Candidates are hashed with their URL's host already distinct, so a hot host is looked up once for each of its paths'
    prefixes that an entry could have.
    """
    spark = pages.sparkSession
    sites = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(b,) for b in blocked], "site string")
    parts = with_parts(pages)
    cut = F.array(*[F.lit(n) for n in lengths])
    prefixes = F.transform(F.filter(cut, lambda n: n <= F.char_length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    longest = max(x or 0 for x in (rules.agg(F.max(F.char_length("rule"))).first()[0], sites.agg(F.max(F.char_length("site"))).first()[0]))
    # domains longer than any entry are not made: of a longer host, what follows the first dot that leaves few enough characters
    tail = F.when(F.char_length("host") <= longest, F.col("host")).otherwise(F.regexp_extract(F.substring("host", -(longest + 1), longest + 1), r"\.(.*)$", 1))
    labels = F.split(tail, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = parts.select("host", prefixes.alias("prefixes")).where("host <> ''").distinct().withColumn("domain", F.explode(suffixes))
    probe = keys.select("host", "prefixes", "domain", F.explode("prefixes").alias("prefix")).withColumn("rule", F.concat("domain", "prefix"))
    best = probe.join(rules, "rule").groupBy("host", "prefixes").agg(F.min(F.struct((-F.char_length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    spam = keys.select("host", F.col("domain").alias("site")).distinct().join(sites, "site").select("host").distinct().withColumn("spam", F.lit(True))
    judged = parts.withColumn("prefixes", prefixes).join(best, ["host", "prefixes"], "left").join(spam, "host", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("spam"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in RULES)
_SITES = ", ".join(f"('{s}')" for s in BLOCKED_SITES)
OP6_SQL = f"""
WITH rules(verdict, host, path, rule) AS (VALUES {_RULE_ROWS}), sites(site) AS (VALUES {_SITES}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
j AS (SELECT p.page_id, p.host, p.path,
             arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS said
      FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
      GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN EXISTS (
    SELECT 1 FROM sites WHERE j.host = site OR ends_with(j.host, '.' || site)) THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""

"""URL rules by a sorted array of 64-bit digests.

The rules' digests (xxhash of host + path prefix) lie sorted in one file with their full strings behind them, and the hosts'
in another with the lengths of their rules' paths. Executors get the files from Spark, map them into memory, and probe by
vectorised binary search: first each suffix of a URL's host, then, for hosts found, the prefixes of its path that are as long
as a rule of that host. A hit counts only if the stored string is the same, so equal digests of different strings do no harm.
Over MOST_RULES rules the same candidates meet hosts and rules in joins.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import small_batches, table, written

MOST_RULES = 250_000
#: Candidate keys that a task holds at once.
KEYS_HELD = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules (host and path, verdict) of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The verdict where no rule fits.
ELSE = "allow"


def digest(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; of null or without `://` both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


class DigestFile:
    """Strings with a list of numbers each. Layout: how many strings and numbers there are, the sorted digests, ends of the strings, ends of the lists, numbers, strings."""

    @staticmethod
    def write(path: str, values: dict[str, list[int]]) -> None:
        keys = sorted(values, key=lambda k: (digest(k), k))
        blobs = [k.encode() for k in keys]
        lists = [values[k] for k in keys]
        with open(path, "wb") as f:
            np.array([len(keys), sum(map(len, lists))], np.int64).tofile(f)
            np.array([digest(k) for k in keys], np.uint64).tofile(f)
            np.cumsum([len(b) for b in blobs], dtype=np.int64).tofile(f)
            np.cumsum([len(x) for x in lists], dtype=np.int64).tofile(f)
            np.array([n for x in lists for n in x], np.int64).tofile(f)
            f.write(b"".join(blobs))

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m = map(int, data[:16].view(np.int64))
        at = 16 + 8 * np.array([0, n, 2 * n, 3 * n, 3 * n + m])
        self.n, self.strings = n, data[at[4] :]
        self.digests = data[at[0] : at[1]].view(np.uint64)
        self.ends, self.list_ends, self.numbers = (data[x:y].view(np.int64) for x, y in zip(at[1:4], at[2:5], strict=True))

    def find(self, keys: list[str]) -> np.ndarray:
        """For each key its place, or -1."""
        out = np.full(len(keys), -1)
        if not self.n or not keys:
            return out
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        hits = np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == wanted))
        for h in hits:
            key, a = keys[h].encode(), int(at[h])
            while a < self.n and self.digests[a] == wanted[h]:
                start = int(self.ends[a - 1]) if a else 0
                if self.strings[start : int(self.ends[a])].tobytes() == key:
                    out[h] = a
                    break
                a += 1
        return out

    def values(self, place: int) -> list[int]:
        return self.numbers[int(self.list_ends[place - 1]) if place else 0 : int(self.list_ends[place])].tolist()


class Rules:
    """Two digest files: hosts with the lengths of their rules' paths, in order, and whole rules with 1 for block."""

    @staticmethod
    def write(host_path: str, rule_path: str, rules: Iterable[tuple[str, bool]]) -> None:
        """Of rules that occur twice, block wins."""
        verdicts: dict[str, int] = {}
        sizes: dict[str, set[int]] = {}
        for rule, block in rules:
            verdicts[rule] = max(verdicts.get(rule, 0), int(block))
            host, slash, path = rule.partition("/")
            sizes.setdefault(host, set()).add(len(slash + path))
        DigestFile.write(host_path, {h: sorted(n) for h, n in sizes.items()})
        DigestFile.write(rule_path, {r: [v] for r, v in verdicts.items()})

    def __init__(self, host_path: str, rule_path: str):
        self.hosts, self.rules = DigestFile(host_path), DigestFile(rule_path)

    def judge(self, hosts: list[str], paths: list[str]) -> Iterator[tuple[int, str, bool]]:
        """(row, rule, block) of every fitting rule. Hosts are probed first, then rules of the lengths that the host has, KEYS_HELD keys at once."""
        suffixes, owner = [], []
        for i, host in enumerate(hosts):
            labels = host.split(".") if host else []
            suffixes += [".".join(labels[k:]) for k in range(len(labels))]
            owner += [i] * len(labels)
        keys, rows = [], []
        for at, place in enumerate(self.hosts.find(suffixes).tolist()):
            if place >= 0:
                path = paths[owner[at]]
                for n in self.hosts.values(place):
                    if n > len(path):
                        break
                    keys.append(suffixes[at] + path[:n]), rows.append(owner[at])
                    if len(keys) >= KEYS_HELD:
                        yield from self._fitting(keys, rows)
                        keys, rows = [], []
        yield from self._fitting(keys, rows)

    def _fitting(self, keys: list[str], rows: list[int]) -> Iterator[tuple[int, str, bool]]:
        for key, row, place in zip(keys, rows, self.rules.find(keys).tolist(), strict=True):
            if place >= 0:
                yield row, key, bool(self.rules.values(place)[0])


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = ELSE, most_rules: int = MOST_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    rules: (rule, verdict), a rule being a host, `/` and the beginning of a path; it fits the host and its subdomains. The
    longest fitting rule decides, else `otherwise`, with a null rule. A null URL or one without `://` has empty host and path
    and fits no rule. Null rules and those without `/` fit nothing; of equal rules block wins. Long URLs are judged whole,
    repeated rows each; an empty table gives an empty result, and without rules nothing fits. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, path = split_url(pages[url_col])
    urls = pages.select(pages[id_col].alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rules = rules.select("rule", (F.col("verdict") == "block").alias("block")).where("contains(rule, '/') AND block IS NOT NULL")
    id_type = pages.schema[id_col].dataType.simpleString()
    if rules.limit(most_rules + 1).count() > most_rules:
        return _joined(urls, rules, otherwise).withColumnRenamed("id", id_col)
    folder = tempfile.mkdtemp(prefix="spark-")
    names = [f"{kind}-{os.path.basename(folder)}" for kind in ("hosts", "rules")]
    Rules.write(*(os.path.join(folder, n) for n in names), ((r["rule"], r["block"]) for r in rules.toLocalIterator()))
    for n in names:
        spark.sparkContext.addFile(os.path.join(folder, n))

    def judge(batches):
        index = Rules(*map(SparkFiles.get, names))
        for batch in batches:
            rule, verdict = [None] * batch.num_rows, [otherwise] * batch.num_rows
            for i, key, block in index.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if rule[i] is None or len(key) > len(rule[i]):
                    rule[i], verdict[i] = key, "block" if block else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _joined(urls: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """The same by joins of host suffixes with hosts and of candidate keys with rules, for any number of rules. The tables of hosts and rules are written, so that Spark can split a common host's rows over several tasks."""
    one = written(rules.groupBy("rule").agg(F.max("block").alias("block")), "rules")
    hosts = one.select(F.substring_index("rule", "/", 1).alias("suffix"), (F.length("rule") - F.instr("rule", "/") + 1).alias("n"))
    hosts = written(hosts.groupBy("suffix").agg(F.sort_array(F.collect_set("n")).alias("sizes")), "hosts")
    numbered = written(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = numbered.where("host != ''").withColumn("suffix", F.explode(suffixes)).join(hosts, "suffix")
    keys = near.withColumn("n", F.explode("sizes")).where(F.col("n") <= F.length("path")).select("row", F.concat("suffix", F.substr("path", F.lit(1), F.col("n"))).alias("rule"))
    best = keys.join(one, "rule").groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "block")).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(otherwise)).when(F.col("best.block"), "block").otherwise("allow")
    return numbered.join(best, "row", "left").select("id", "host", "path", "best.rule", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP5_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM rules),
e AS (SELECT c.page_id, c.host, c.path, d.rule, d.verdict FROM c LEFT JOIN d
  ON (c.host = d.h OR ends_with(c.host, '.' || d.h)) AND starts_with(c.path, d.p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), '{ELSE}') AS verdict
FROM e GROUP BY page_id, host, path
"""

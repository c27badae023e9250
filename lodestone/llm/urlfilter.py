"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry is a host and the beginning of a path. It fits its host and all hosts
below it, where the URL's path begins with the entry's. Of the entries that fit
a URL the one with the most host labels decides, then the one with the longest
path; where an allow and a block entry are equal, block. A URL that no entry
fits gets ``default``.

The trie's first levels are host labels from the last to the first, so that
one walk over a host meets its own entries and those of all its parents; below
a host stand whole path segments, and at each of these the beginnings of the
next one. The trie is broadcast if the entries' text is at most ``trie_bytes``
long, a bound that is checked. Beyond it the same rule is a join: each URL
meets, for each parent of its host that has entries, the beginnings of its path
that are as long as one of that host's entries. A key meets one entry at most,
so nothing is multiplied by the number of entries.

Nulls and edges: a null URL, or one without ``://``, has an empty host and
path; entries with a null host, or a verdict other than ``allow`` and
``block``, are passed over; an entry's null path is empty and fits every path;
repeated entries count once; with no entries all URLs get ``default``; repeated
rows are judged each; very long URLs are judged whole; an empty table gives an
empty result; columns of ``pages`` stay, but for ``host``, ``path``, ``rule``
and ``verdict``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import materialize

FITTED = "struct<rule:string,verdict:string>"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def url_path(url: Column) -> Column:
    """What stands between the host and the next ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")


class UrlTrie:
    """The entry that decides for a host and path."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for host, path, verdict in sorted(entries):  # block comes after allow and takes its place
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, rest = path.split("/")
            paths = node.setdefault(None, {})  # no label is None
            for segment in segments:
                paths = paths.setdefault(segment, {})
            paths.setdefault(None, {})[rest] = (host + path, verdict)
        self.of_host = lru_cache(1 << 14)(self._of_host)

    def __reduce__(self) -> tuple:
        return _rebuilt, (self.hosts,)

    def _of_host(self, host: str) -> list[dict]:
        """The path tries of a host and its parents, the host's own first."""
        found, node = [], self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found.append(node[None])
        return found[::-1]

    def fit(self, host: str, path: str) -> tuple[str, str] | None:
        for node in self.of_host(host):
            found, segments = None, path.split("/")
            for segment in segments:
                if begun := node.get(None):
                    fits = [x for x in begun if segment.startswith(x)] if len(begun) <= len(segment) else [x for n in range(len(segment) + 1) if (x := segment[:n]) in begun]
                    found = begun[max(fits, key=len)] if fits else found
                node = node.get(segment)  # for the next segment, so that a slash stands between
                if node is None:
                    break
            if found:
                return found
        return None


def _rebuilt(hosts: dict) -> UrlTrie:
    trie = UrlTrie([])
    trie.hosts = hosts
    return trie


def _entries(rules: DataFrame) -> DataFrame:
    """``host, path, verdict``, each host and path once."""
    clean = rules.select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return clean.where("host is not null and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _by_trie(rows: DataFrame, entries: DataFrame) -> DataFrame:
    trie = rows.sparkSession.sparkContext.broadcast(UrlTrie([tuple(r) for r in entries.select("host", "path", "verdict").collect()]))  # within trie_bytes

    @F.arrow_udf(FITTED)
    def fit(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        walk = trie.value.fit
        for hosts, paths in batches:
            found = [walk(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.array([f and {"rule": f[0], "verdict": f[1]} for f in found], pa.struct([("rule", pa.string()), ("verdict", pa.string())]))

    return rows.withColumn("_fit", fit("host", "path"))


def _by_join(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by keys. Equal pairs of host and path are judged once."""
    entries = materialize(entries, "entries")
    lengths = materialize(entries.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")), "lengths")  # lengths of paths, not paths
    pairs = rows.select("host", "path").distinct()
    deepest = entries.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1))).first()[0]
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    above = pairs.select("host", "path", F.explode(parents).alias("parent"))
    met = above.join(lengths.withColumnRenamed("host", "parent"), "parent")
    begun = met.select("host", "path", "parent", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    keyed = begun.withColumn("begin", F.expr("substring(path, 1, n)"))
    named = entries.select(F.col("host").alias("parent"), F.col("path").alias("begin"), "verdict")
    order = F.struct(F.size(F.split("parent", r"\.")).alias("labels"), F.length("begin").alias("n"))
    fit = F.struct(F.concat("parent", "begin").alias("rule"), "verdict")
    best = keyed.join(named, ["parent", "begin"]).groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max_by(fit, order).alias("_fit"))
    best = materialize(best, "fits")
    return rows.join(best, (rows["host"] == best["_h"]) & (rows["path"] == best["_p"]), "left").drop("_h", "_p")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", trie_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the deciding entry, else null) and ``verdict``. rules: ``host, path, verdict``."""
    entries = _entries(rules)
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    kept = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(None).alias("none"))
    rows = pages.select(kept.alias("_row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    size = entries.agg(F.coalesce(F.sum(F.octet_length(F.concat("host", "path"))), F.lit(0))).first()[0]
    fitted = _by_trie(rows, entries) if size <= trie_bytes else _by_join(rows, entries)
    return fitted.select(*([f"_row.`{c}`" for c in own]), "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", **kwargs) -> DataFrame:
    """The rows of ``pages`` whose verdict is ``allow``, as they are."""
    judged = judge(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{url}`").alias("address")), rules, "address", **kwargs)
    return judged.where("verdict = 'allow'").select("page.*")

"""URL filters: rules looked up in Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe. Its first level encodes
the listed keys; the second encodes the first one's false positives among the other keys of the
universe; the third the second one's false positives among the listed keys, and so on until none
are left. The universe is every key that a URL of the corpus can ask for, so no URL gets a wrong
answer, and a lookup is an expression on constants: no join, no shuffle, no Python.

A cascade takes about `1.44 * log2(other / listed) + 4` bits for each listed key, whatever the
corpus holds. Lists above `MAX_RULES` are split by hash into several cascades that are applied one
after the other.

Edge cases: a NULL URL or one without `://` has empty host and path, fits no rule and gets the
default verdict; repeated URLs get equal rows; further columns are kept out of the result. A rule
that is listed twice counts once; listed both as block and as allow, it blocks. Of rules of equal length
the one with the longer host wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from queuelens.llm.common import ascii_lower, unused
from queuelens.session import materialize

#: (host, path, action); a rule fits its host and all subdomains, if the URL's path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Rules of one cascade: its filters stay below about 10 MB as constants of a query.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: str  # the filter's 64-bit words, comma-separated

    def contains(self, key: Column, number: int) -> Column:
        # A foldable expression: the optimizer turns it into one array constant.
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        found = F.lit(True)
        for spot in positions(key, number, self.hashes, self.bits):
            word = F.element_at(words, (F.shiftright(spot, 6) + 1).cast("int"))
            found = found & (F.getbit(word, (spot % 64).cast("int")) == 1)
        return found


def positions(key: Column, number: int, hashes: int, bits: int) -> list[Column]:
    """Bit positions of `key` in level `number`, by double hashing."""
    first, second = (F.pmod(h, F.lit(1 << 31)) for h in (F.xxhash64(F.lit(number), key), F.xxhash64(key, F.lit(number))))
    return [F.pmod(first + j * second, F.lit(bits)) for j in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether `key`, which must be in the universe, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[number - 1].contains(key, number), answer).otherwise(F.lit(number % 2 == 0))
        return answer


def build_cascade(universe: DataFrame, min_bits: int = 1024, later_rate: float = 0.5) -> Cascade:
    """The cascade of a stored table of distinct keys (key, listed).

    Each level costs one pass that counts its keys and one that ors their bits, both combined
    map-side; the driver receives the filter's words, whose number follows the list, not the corpus.
    """
    levels: list[Level] = []
    left = universe
    while True:
        counts = left.agg(F.count_if("listed").alias("yes"), F.count_if(~F.col("listed")).alias("no")).first()
        odd = len(levels) % 2 == 0
        size, others = (counts.yes, counts.no) if odd else (counts.no, counts.yes)
        if size == 0:
            return Cascade(tuple(levels))
        rate = later_rate if levels else min(later_rate, size * math.sqrt(0.5) / max(others, 1))
        bits = max(min_bits, 64 * math.ceil(-size * math.log(rate) / math.log(2) ** 2 / 64))
        hashes = max(1, min(16, round(-math.log2(rate))))
        number = len(levels) + 1
        spots = left.where(F.col("listed") == odd).select(
            F.explode(F.array(*positions(F.col("key"), number, hashes, bits))).alias("spot")
        )
        # An expression shifts a bigint by a column only in SQL.
        found = dict(
            spots.groupBy(F.shiftright("spot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
            .collect()
        )
        level = Level(bits, hashes, ",".join(str(found.get(i, 0)) for i in range(bits // 64)))
        levels.append(level)
        # All keys of this level's own kind stay; of the others, those that it wrongly holds.
        left = left.where(level.contains(F.col("key"), number))
        if others == 0:
            return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    after = F.when(F.contains(url, F.lit("://")), after).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def candidate_keys(host: Column, path: Column, most_labels: int, path_lengths: list[int]) -> Column:
    """Every rule string that could fit: host suffixes times path prefixes of the lengths that rules have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(lengths, lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def longer(a: Column, b: Column) -> Column:
    """Whether rule string `a` goes before `b`."""
    host = lambda rule: F.length(F.substring_index(rule, "/", 1))
    return (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (host(a) > host(b)))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A small rule list as a frame (host, path, action)."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "action")])
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES,
    min_bits: int = 1024, keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """(*keep, host, path, rule, verdict): the longest rule that fits each URL; without one, `default`."""
    listed = materialize(
        rules.where(F.length("host") > 0)
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy(F.concat("host", "path").alias("key"), "host", "path")
        .agg((F.max(F.col("action") == "block")).alias("blocks")),
        "url-rules",
    )
    shape = listed.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    host, path = host_and_path(F.col(url))
    out = pages.select(*keep, host.alias(h := unused(keep, "host")), path.alias(p := unused(keep, "path")))
    if not shape.n:
        return out.withColumns({unused(keep, "rule"): F.lit(None).cast("string"), unused(keep, "verdict"): F.lit(default)})
    keys = candidate_keys(F.col(h), F.col(p), shape.labels, shape.lengths)
    groups = math.ceil(shape.n / max_rules)
    group = lambda key: F.pmod(F.xxhash64(key), F.lit(groups))
    universe = materialize(
        out.select(F.explode(keys).alias("key"), F.lit(False).alias("listed"))
        .union(listed.select("key", F.lit(True)))
        .groupBy("key").agg(F.max("listed").alias("listed")),
        "url-keys",
    )
    actions = listed.select("key", F.col("blocks").alias("listed"))
    best, blocks = unused([*keep, h, p], "rule"), unused([*keep, h, p], "blocks")
    out = out.withColumns({best: F.lit(None).cast("string"), blocks: F.lit(None).cast("boolean")})
    for g in range(groups):
        rule_of = build_cascade(universe.where(group(F.col("key")) == g), min_bits)
        block_of = build_cascade(actions.where(group(F.col("key")) == g), min_bits)
        fits = F.filter(keys, lambda k: (group(k) == g) & rule_of.contains(k))
        longest = F.reduce(fits, F.col(best), lambda a, k: F.when(a.isNull() | longer(k, a), k).otherwise(a))
        out = out.withColumn(best, longest)
        own = F.col(best).isNotNull() & (group(F.col(best)) == g)
        out = out.withColumn(blocks, F.when(own, block_of.contains(F.col(best))).otherwise(F.col(blocks)))
        if groups > 1:
            out = materialize(out, "url-verdicts")  # only one cascade's constants in a query
    verdict = F.when(F.col(blocks), "block").when(~F.col(blocks), "allow").otherwise(default)
    return out.withColumn(unused([*keep, h, p, best], "verdict"), verdict).drop(blocks)

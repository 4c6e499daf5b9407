"""URL filters by a Bloom filter cascade.

Rules name a host and a path prefix; a rule fits its host and every subdomain of it. The keys a url
could match are built from the url alone (host suffixes by path prefixes, only with the label counts
and prefix lengths that rules have). All keys of the corpus form a closed universe, so a cascade of
Bloom filters answers membership without error: level 0 holds the listed keys, level 1 the keys of
the universe that level 0 wrongly accepts, level 2 the listed keys that level 1 wrongly accepts, and
so on until a level accepts nothing wrongly. Urls are judged by bit tests alone; no join is needed.

Everything is DataFrame functions. What reaches the driver are the words of the filters, whose number
follows the rule list (``MAX_RULES`` bounds it; a longer list is an error, since its filters would have to be joined) and not the corpus: the first level's error rate is set from the ratio of listed to other keys, so that later levels hold about as many keys as are listed.

Edge cases: a null url, or one without ``://``, has empty host and path and fits only rules with an
empty host; empty tables give no rows; repeated rows are judged each by itself.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

MAX_RULES = 2_000_000
MAX_LEVELS = 40
WORD = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    words: list[int]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits).cast("long")) for i in range(self.hashes)]

    def accepts(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # one literal, folded into an array once
        found = F.lit(True)
        for at in self.positions(key):
            word = F.element_at(words, (F.floor(at / WORD) + 1).cast("int"))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD)).cast("int"))
            found &= word.bitwiseAND(mask) != 0
        return found


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys under which a rule could list this url: host suffixes by path prefixes."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels
        for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def bloom_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the ``n`` keys in column ``key``; its words are gathered by ``bit_or``."""
    bits = max(WORD, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // WORD) * WORD
    level = Level([], bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1, seed)
    level = Level([], bits, min(level.hashes, 16), seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    words = (
        at.groupBy(F.floor(F.col("at") / WORD).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(WORD)).cast("int"))).alias("bits"))
        .collect()
    )
    filled = [0] * (bits // WORD)
    for row in words:
        filled[row.word] = row.bits
    return Level(filled, bits, level.hashes, seed)


def build_cascade(universe: DataFrame, listed: list[str]) -> list[Level]:
    """Levels that separate the listed keys from every other key in ``universe`` (column ``key``)."""
    if len(listed) > MAX_RULES:
        raise ValueError(f"{len(listed)} listed keys; a cascade takes at most {MAX_RULES}")
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    outside = universe.join(F.broadcast(inside) if len(listed) < 100_000 else inside, "key", "left_anti")
    n_inside, n_outside = len(set(listed)), outside.count()
    levels: list[Level] = []
    adding, others, n_adding, n_others = inside, outside, n_inside, n_outside
    while n_adding and n_others:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not converge")
        rate = min(0.5, max(1e-6, 0.7 * n_inside / n_outside)) if not levels else 0.5
        level = bloom_level(adding, n_adding, rate, seed=len(levels))
        levels.append(level)
        wrong = written(others.filter(level.accepts(F.col("key"))), "cascade")
        n_wrong = wrong.count()
        adding, others, n_adding, n_others = wrong, adding, n_wrong, n_adding
    if not levels and n_inside:
        levels.append(bloom_level(inside, n_inside, 0.5, seed=0))
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether the key is listed; exact for every key of the universe the cascade was built on."""
    verdict = F.lit(bool(levels) and len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        verdict = F.when(levels[i].accepts(key), verdict).otherwise(F.lit(i % 2 == 1))
    return verdict


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (host and path of the longest fitting rule) and verdict to every row.

    Of equally long fitting rules that with the longer host wins; a key listed under both verdicts is blocked.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    shaped = df.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = written(shaped.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    verdicts = sorted({r.verdict for r in rules}, key=lambda v: (v != "block", v))
    cascades = {v: build_cascade(universe, [r.key for r in rules if r.verdict == v]) for v in verdicts}

    def judged(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for v in reversed(verdicts):
            verdict = F.when(in_cascade(key, cascades[v]), F.lit(v)).otherwise(verdict)
        host_part = F.length(F.substring_index(key, "/", 1))
        return F.struct(F.length(key).alias("n"), host_part.alias("h"), key.alias("key"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform(keys, judged), lambda x: x["verdict"].isNotNull()))
    return (
        shaped.withColumn("_best", best)
        .withColumns({"rule": F.col("_best.key"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
        .drop("_best")
    )

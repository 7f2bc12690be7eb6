import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factgrid.llm import sharding
from factgrid.llm.sharding import TIE_BITS, kd_shards
from tests.llm.helpers import ODD, SF, docs


def check(rows, n_rows, shards):
    assert len(rows) == n_rows
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_law_of_bytes(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kd_shards(d, shards=6).collect()
    check(rows, d.count(), 6)
    sizes, texts = Counter(), {r.doc_id: r.text for r in d.collect()}
    for r in rows:
        sizes[r.shard] += r.size
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    mean = sum(sizes.values()) / 6
    assert max(sizes.values()) < 1.25 * mean and min(sizes.values()) > 0.75 * mean


def test_a_group_that_outweighs_a_shard_stays_whole_and_the_rest_is_even(spark):
    rows = kd_shards(docs(spark, [(i, "same " * 200) for i in range(300)] + [(1000 + i, f"text {i} " * 60) for i in range(600)]), shards=8).collect()
    check(rows, 900, 8)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 8 and max(rest) < 1.5 * min(rest)


def brute_shards(groups, first, shards, out):
    """groups: (key, ordinals, tie, weight). The widest dimension is cut where the running weight is nearest to the left shards' part."""
    if shards > 1 and groups:
        ranges = [max(x) - min(x) for x in zip(*(g[1] for g in groups), strict=True)]
        wide = ranges.index(max(ranges))
        place = {g[0]: g[1][wide] << TIE_BITS | g[2] for g in groups}
        total = sum(g[3] for g in groups)
        if len(set(place.values())) > 1:
            target, below = total * (shards // 2) / shards, 0
            for at in sorted(set(place.values())):
                upto = below + sum(g[3] for g in groups if place[g[0]] == at)
                if upto >= target:
                    break
                below = upto
            back = below > 0 and (upto >= total or target - below <= upto - target)
            cut, weight = (at, below) if back else (at + 1, upto)
            left = min(shards - 1, max(1, round(weight / total * shards)))
            brute_shards([g for g in groups if place[g[0]] < cut], first, left, out)
            brute_shards([g for g in groups if place[g[0]] >= cut], first + left, shards - left, out)
            return
    out |= {g[0]: first for g in groups}


def test_cuts_are_those_of_a_tree_built_by_sorting(spark):
    rng = random.Random(6)
    rows = [(i, f"text {rng.randint(0, 250)} " * rng.choice([1, 5, 20, 200]), rng.choice(["en", "de", None]), f"s{rng.randint(0, 30)}") for i in range(500)]
    d = docs(spark, rows)
    size = (F.octet_length("text") + 8).cast("long")
    key = d.select("lang", "source", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.xxhash64("text").alias("hash"))
    grouped = key.groupBy("hash", "crc", "size").agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    ordinals = [sharding._ordinal_of_size(F.col("size")), sharding._ordinal_of_category(F.col("lang")), sharding._ordinal_of_category(F.col("source"))]
    tie = F.pmod(F.xxhash64("hash", "crc"), F.lit(1 << TIE_BITS))
    groups = [((g.size, g.crc), (g.a, g.b, g.c), g.tie, g.size * g.n) for g in grouped.select("size", "crc", "n", tie.alias("tie"), *[o.alias(x) for o, x in zip(ordinals, "abc", strict=True)]).collect()]
    for shards in (2, 5, 7):
        want: dict = {}
        brute_shards(groups, 0, shards, want)
        assert {(r.size, r.text_crc32): r.shard for r in kd_shards(d, shards=shards).collect()} == want


def test_target_bytes_odd_rows_and_empty_table(spark):
    d = docs(spark, [*ODD, *((100 + i, f"{i} some text", "en" if i % 2 else None, f"s{i % 3}") for i in range(40))]).selectExpr("*", "7 AS shard", "'x' AS node")
    total = sum(r.size for r in kd_shards(d, shards=1).collect())
    check(kd_shards(d, target_bytes=total // 3).collect(), len(ODD) + 40, 4)
    check(kd_shards(docs(spark, [(1, "x"), (2, "x")]), shards=24).collect(), 2, 24)
    assert kd_shards(docs(spark, []), shards=24).count() == 0
    with pytest.raises(ValueError, match="either"):
        kd_shards(d)

"""Clip duplicates: exact hash, perceptual hash within a radius, content key."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .tables import Save

#: Bits that may differ, and blocks that must be equal.
RADIUS, SPARE = 6, 3
#: Clips and pairs of a group that is gone through in order.
FOLD = 100_000
VALID = "phash RLIKE '^[0-9a-f]{16}$'"


def halves(c: Column) -> list[Column]:
    """The two 32-bit halves of 16 hex digits, null for anything else."""
    good = c.rlike("^[0-9a-fA-F]{16}$")
    return [F.when(good, F.conv(F.substring(c, at, 8), 16, 10).cast("long")) for at in (1, 9)]


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; 64 if one is missing; of an invalid hash 0 if equal, else 64."""
    (a1, a2), (b1, b2) = halves(a), halves(b)
    bits = F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, 64).when(bits.isNotNull(), bits).when(a == b, 0).otherwise(64)


def content_key(material: Column, description: Column, duration: Column) -> Column:
    text = F.concat_ws("|", F.coalesce(material, F.lit("")), F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " ")), F.format_string("%.1f", duration))
    return F.substring(F.sha2(text, 256), 1, 16)


def by_sha(new: DataFrame, library: DataFrame) -> DataFrame:
    first = library.filter("sha <> ''").groupBy("sha").agg(F.min("clip_id").alias("match_id"))
    return new.join(first, "sha").select("clip_id", "match_id")


def by_content_key(new: DataFrame, library: DataFrame) -> DataFrame:
    """The first library clip with the same content key (``key``)."""
    first = library.filter("key <> ''").groupBy("key").agg(F.min("clip_id").alias("match_id"))
    return new.join(first, "key").select("clip_id", "match_id")


def _masks(blocks: int) -> list[int]:
    """A mask of each block of the 64 bits, as signed numbers."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spread(hashes: DataFrame, own: str, scope: str, radius: int, blocks: int) -> DataFrame:
    """The bits (``own``) of each distinct valid hash of a scope, once per ``set`` of ``blocks - radius`` blocks.

    ``key`` holds the bits of the set's blocks; ``skipped`` marks the blocks before its last
    one that are not in the set.
    """
    high, low = halves(F.col("phash"))
    masks, sets = _masks(blocks), []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        skipped = sum(1 << j for j in range(chosen[-1]) if j not in chosen)
        mask = _signed(sum(masks[j] for j in chosen) % (1 << 64))
        sets.append(F.struct(F.lit(i).alias("set"), F.lit(mask).cast("long").alias("mask"), F.lit(skipped).alias("skipped")))
    values = hashes.filter(VALID).select(scope, F.shiftleft(high, 32).bitwiseOR(low).alias(own)).distinct()
    each = values.select(scope, own, F.explode(F.array(*sets)).alias("s"))
    return each.select(scope, own, "s.set", F.col(own).bitwiseAND(F.col("s.mask")).alias("key"), "s.skipped")


def close_values(mine: DataFrame, theirs: DataFrame, scope: str = "category", radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct valid hashes of a scope within ``radius``, equal ones among them.

    Of ``blocks`` blocks at least ``blocks - radius`` are equal in such a pair, so every set
    of that many blocks is an equi-join key. A pair is taken under the first of its equal
    blocks alone, so it comes once and needs no second shuffle. With three blocks more than
    the radius (the default) a key has about 21 of the 64 bits: 84 keys a hash for radius 6,
    and of n random hashes 84 n / 2^21 are compared with each.
    """
    blocks = blocks or radius + SPARE
    left, right = spread(mine, "_a", scope, radius, blocks), spread(theirs, "_b", scope, radius, blocks).drop("skipped")
    differ = F.col("_a").bitwiseXOR(F.col("_b"))
    pairs = left.join(right, [scope, "set", "key"]).select(scope, "_a", "_b", "skipped", F.bit_count(differ).alias("distance"), differ.alias("x")).filter(F.col("distance") <= radius)
    for t, mask in enumerate(_masks(blocks)):
        pairs = pairs.filter((F.col("skipped").bitwiseAND(1 << t) == 0) | (F.col("x").bitwiseAND(mask) != 0))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return pairs.select(scope, text("_a").alias("a"), text("_b").alias("b"), "distance")


def by_phash(new: DataFrame, library: DataFrame, scope: str = "category", radius: int = RADIUS) -> DataFrame:
    """Distinct hashes of a scope and the first library clip within ``radius``.

    Equal hashes are merged first: clips of one blank frame count as one row.
    """
    theirs = library.filter(VALID).groupBy(scope, "phash").agg(F.min("clip_id").alias("match_id"))
    close = close_values(new, library, scope, radius)
    held = close.join(theirs.withColumnRenamed("phash", "b"), [scope, "b"])
    return held.groupBy(scope, F.col("a").alias("phash")).agg(F.min(F.struct("match_id", "distance")).alias("m")).select(scope, "phash", "m.match_id", "m.distance")


def cascade(new: DataFrame, library: DataFrame, scope: str = "category", with_key: bool = False) -> DataFrame:
    """The first detector that finds a duplicate: exact hash, perceptual hash, then (if asked for) content key."""
    exact = by_sha(new, library).select("clip_id", F.col("match_id").alias("exact_id"))
    near = new.join(by_phash(new, library, scope), [scope, "phash"]).select("clip_id", F.col("match_id").alias("near_id"), "distance")
    joined = new.select("clip_id").join(exact, "clip_id", "left").join(near, "clip_id", "left")
    if with_key:
        joined = joined.join(by_content_key(new, library).select("clip_id", F.col("match_id").alias("key_id")), "clip_id", "left")
    else:
        joined = joined.withColumn("key_id", F.lit(None).cast("long"))
    kind = F.when(F.col("exact_id").isNotNull(), "sha256").when(F.col("near_id").isNotNull(), "phash").when(F.col("key_id").isNotNull(), "content_key")
    found = joined.select("clip_id", kind.alias("detector"), F.coalesce("exact_id", "near_id", "key_id").alias("match_id"), F.when(kind == "phash", F.col("distance")).alias("distance"))
    return found.filter("detector IS NOT NULL")


def in_order(batch: DataFrame, library: DataFrame, save: Save, scope: str = "category", fold: int = FOLD) -> DataFrame:
    """``id, kept``: a clip of the batch goes if it matches the library or an earlier kept clip, in order of ``clip_id``.

    A match is an equal sha or a perceptual hash of the scope within the radius. Clips that
    agree in sha, scope and hash share their matches, so only the first can stay; the others
    are never looked at, and what the library knows goes at once and stops nobody. The rest is
    cut into components of the match graph, found over stars around the first clip of each sha
    and hash. Verdicts of different components do not meet: components of up to ``fold`` clips
    and pairs are dealt to groups of about that size, each gone through once in order; larger
    ones are settled in rounds over all of them at once. ``save(df, name)`` writes a table and reads it.
    """
    columns = ["sha", scope, "phash"]
    marked = (F.col("sha") != "") | F.expr(VALID)
    firsts = batch.filter(marked).groupBy(*columns).agg(F.min("clip_id").alias("id"))
    pairs = save(close_values(batch, batch, scope).filter("a <> b").select(scope, "a", "b"), "pairs")
    sha = by_sha(batch, library).select(F.col("clip_id").alias("id"))
    near = firsts.join(by_phash(batch, library, scope), [scope, "phash"]).select("id")
    nodes = save(firsts.join(sha.union(near).distinct(), "id", "left_anti").select("id", *columns), "nodes")

    of_sha = nodes.filter("sha <> ''").groupBy("sha").agg(F.min("id").alias("a"))
    of_value = save(nodes.filter(VALID).groupBy(scope, "phash").agg(F.min("id").alias("a"), F.count("*").alias("n")), "values")
    other = of_value.select(scope, F.col("phash").alias("b"), F.col("a").alias("id_b"))
    met = save(pairs.join(of_value.select(scope, F.col("phash").alias("a"), F.col("a").alias("id_a")), [scope, "a"]).join(other, [scope, "b"]), "met")
    stars = nodes.join(of_sha, "sha").select("a", F.col("id").alias("b")).union(nodes.join(of_value, [scope, "phash"]).select("a", F.col("id").alias("b")))
    comps = graph.components(stars.union(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), save)
    placed = nodes.join(comps, "id", "left")
    lonely = placed.filter("comp IS NULL").select("id")
    placed = placed.filter("comp IS NOT NULL")
    links = met.join(comps.withColumnsRenamed({"id": "id_a"}), "id_a").select("comp", scope, "a", "b")
    sizes = placed.select("comp", F.lit(1).alias("n")).union(links.select("comp", F.lit(1))).groupBy("comp").agg(F.sum("n").alias("size"))
    total = sizes.filter(F.col("size") <= fold).agg(F.sum("size").alias("n")).first().n or 0
    deal = F.when(F.col("size") <= fold, F.pmod(F.xxhash64("comp"), F.lit(-(-total // max(1, fold)) or 1)))
    sizes = save(sizes.select("comp", deal.alias("deal")), "sizes")
    placed = save(placed.join(sizes, "comp").select("deal", "id", F.nullif("sha", F.lit("")).alias("sha"), F.when(F.expr(VALID), F.concat(scope, F.lit(" "), "phash")).alias("value"), *[F.col(c).alias(f"o_{c}") for c in columns]), "placed")
    value = lambda c: F.concat(scope, F.lit(" "), c).alias(c)
    dealt = links.join(sizes, "comp").filter("deal IS NOT NULL").select("deal", value("a"), value("b"))
    small = placed.filter("deal IS NOT NULL").select("deal", "id", "sha", "value")
    stays = small.groupBy("deal").cogroup(dealt.groupBy("deal")).applyInPandas(_fold, "id long").union(lonely)
    large = placed.filter("deal IS NULL").select("id", *[F.col(f"o_{c}").alias(c) for c in columns])
    if not large.isEmpty():
        stays = stays.union(_rounds(large, pairs, save, scope))
    stays = save(stays, "stays").select(F.col("id").alias("clip_id"), F.lit(True).alias("stays"))
    return batch.join(stays, "clip_id", "left").select(F.col("clip_id").alias("id"), F.when(F.coalesce(marked, F.lit(False)), F.coalesce("stays", F.lit(False))).otherwise(True).alias("kept"))


def _fold(clips: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The clips of whole components that stay, gone through in order of id."""
    near: dict[str, list[str]] = {}
    for a, b in zip(links["a"], links["b"], strict=True):
        near.setdefault(a, []).append(b)
    taken_sha, taken_value, stay = set(), set(), []
    clips = clips.sort_values("id")
    for clip, sha, value in zip(clips["id"], clips["sha"], clips["value"], strict=True):
        if sha in taken_sha or value in taken_value:
            continue
        stay.append(clip)
        if sha is not None:
            taken_sha.add(sha)
        if value is not None:
            taken_value.add(value)
            taken_value.update(near.get(value, ()))
    return pd.DataFrame({"id": pd.Series(stay, dtype="int64")})


def _rounds(nodes: DataFrame, pairs: DataFrame, save: Save, scope: str) -> DataFrame:
    """``id`` of those that stay, settled in rounds: each takes the first kept and the first open clip of each sha and hash."""
    columns = ["sha", scope, "phash"]
    pairs = pairs.union(pairs.select(scope, "a", F.col("a").alias("b")).distinct()).union(nodes.filter(VALID).select(scope, F.col("phash").alias("a"), F.col("phash").alias("b")).distinct()).distinct()
    state, step = save(nodes.select("id", *columns, F.lit(None).cast("boolean").alias("kept")), "round0"), 0
    lowest = [F.min(F.when(F.col("kept"), F.col("id"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("u")]
    while not state.filter("kept IS NULL").isEmpty():
        step += 1
        exact = state.filter("sha <> ''").groupBy("sha").agg(*lowest).withColumnsRenamed({"k": "k1", "u": "u1"})
        value = state.filter(VALID).groupBy(scope, F.col("phash").alias("b")).agg(*lowest)
        around = pairs.join(value, [scope, "b"]).groupBy(scope, F.col("a").alias("phash")).agg(F.min("k").alias("k2"), F.min("u").alias("u2"))
        both = state.join(exact, "sha", "left").join(around, [scope, "phash"], "left")
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.least("k1", "k2") < F.col("id"), False).when(F.least("u1", "u2") >= F.col("id"), True)
        state = save(both.select("id", *columns, verdict.alias("kept")), f"round{step}")
    return state.filter("kept").select("id")

"""Benchmark passages in texts, found through spaced seeds. DataFrame operations only.

A mask such as 1101101 looks at some of the tokens from a position on and ignores the others; two passages that
differ in a token still agree under a mask that ignores it. Test items' masked hashes are joined with those of all
texts; each hit fixes an alignment (text position minus item position), and along it text and item are compared
token by token. A passage is found where enough tokens of a stretch are equal, whatever the others are: the masks are
chosen by the stretch's length such that every way of changing the tokens that may differ leaves one of them a hit.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: The masks of the SQL that checks this operator: 1 is compared, 0 ignored. They miss some passages; the operator takes FAMILIES.
MASKS = ("11011011", "10110111", "11101101")
#: (w, m): masks of which one fits somewhere in any w tokens with m of them changed, so also in more tokens with m changed and in
#: w - k tokens with m - k changed. Found by search and proved by enumeration in the tests.
FAMILIES = {
    (16, 4): ("111011", "1100001011", "111000010001"), (12, 3): ("11101", "10111"), (10, 2): ("11101", "1111"), (8, 2): ("111", "1101"),
    (5, 1): ("111", "1101"), (4, 1): ("111", "1101", "1011"),
}
#: Tokens of a stretch (the whole item if that is shorter), and percent of them that must be equal.
STRETCH, PERCENT = 16, 75
#: A checked bound of broadcasts, in seeds of the test items (five numbers each, some 60 bytes).
BROADCAST_SEEDS = 200_000
#: The same for the alignments found (four numbers each, some 50 bytes), and for the bytes of the items' tokens, which are broadcast once.
BROADCAST_PLACES = 200_000
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def complete_masks(width: int, changed: int) -> tuple[str, ...]:
    """Masks of which one fits somewhere in any `width` tokens with at most `changed` changed ones."""
    if changed == 0 and width <= 5:
        return ("1" * width,)
    for (w, m), masks in FAMILIES.items():
        if changed <= m and width - changed >= w - m or changed == m and width >= w:
            if m - changed <= 1:  # else lighter than they need to be
                return masks
    return ("1" * ceil((width - changed) / (changed + 1)),)  # some run between changes is that long


def _seeds(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """From rows with h (array of tokens): a row for each position and mask, with pos (0-based), seed and the columns kept; seed is null where the mask reaches over the end. h itself is left behind: a long text must not be copied for each of its tokens."""
    offsets = [[k for k, x in enumerate(m) if x == "1"] for m in masks]
    size = F.size("h")
    shifted = [F.slice("h", F.lit(k + 1), F.greatest(size - k, F.lit(0))).alias(f"w{k}") for k in sorted({0}.union(*offsets))]
    at = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    hashes = [F.when(F.col(f"w.w{ks[-1]}").isNotNull(), F.xxhash64(F.lit(m), *(F.col(f"w.w{k}") for k in ks))) for m, ks in zip(masks, offsets, strict=True)]
    return at.select(*keep, "pos", F.explode(F.array(*hashes)).alias("seed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", masks: tuple[str, ...] | None = None, stretch: int = STRETCH, percent: int = PERCENT, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """key, item, n_equal, n_tokens, first_token: one row for each text and item of which a passage was found.

    first_token is where the item's first token falls in the text (negative if the text starts inside the item),
    n_equal how many tokens of the whole item are equal there, of n_tokens. A passage counts if `percent` of `stretch`
    consecutive item tokens (or of all, if the item has fewer) are equal; every one is found, in items of any length,
    unless `masks` names other masks than the complete ones. Of several places, the best is given, the first of equals.
    Null and empty texts and items have no passages. Rows with null keys are left out; repeated rows count once.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    items = benchmark.select(F.col(item_key).alias("item"), tokens(F.col(item_text)).alias("h")).where(F.col("item").isNotNull() & (F.size("h") > 0))
    items = items.withColumn("form", F.xxhash64(F.array_join("h", " "))).dropDuplicates(["item", "form"])  # an id may have several texts
    # Items of one family of masks are those of some widths, at most `stretch` of them.
    width = F.least(F.size("h"), F.lit(stretch))
    families: dict[tuple[str, ...], list[int]] = {}
    for (w,) in items.select(width).distinct().collect():
        families.setdefault(tuple(masks or complete_masks(w, w - ceil(w * percent / 100))), []).append(w)
    families = families or {("1",): []}
    seeds = reduce(DataFrame.unionAll, [_seeds(items.where(width.isin(widths)), family, "item", "form") for family, widths in families.items()])
    seeds = seeds.where("seed is not null").withColumnRenamed("pos", "item_pos")
    masks = tuple(sorted({m for family in families for m in family}))
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("t")).where("_key is not null and t is not null")
    hits = _seeds(texts.select("_key", tokens(F.col("t")).alias("h")), masks, "_key").join(F.broadcast(seeds) if small else seeds, "seed")
    # One row for each alignment that a seed fixes; the many hits of one passage meet in partial aggregates.
    places = kept(hits.select("_key", "item", "form", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    few = places.limit(broadcast_places + 1).count() <= broadcast_places
    known = items.select("item", "form", F.col("h").alias("item_h"))
    light = small and (known.agg(F.sum(F.octet_length(F.array_join("item_h", " ")) + 24 * F.size("item_h") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    # Only texts with an alignment are read as tokens again.
    found_keys = places.select("_key").distinct()
    rows = texts.join(F.broadcast(found_keys) if few else found_keys, "_key", "left_semi").select("_key", tokens(F.col("t")).alias("h"))
    hits = rows.join(F.broadcast(places) if few else places, "_key").join(F.broadcast(known) if light else known, ["item", "form"])
    # The part of the text that lies along the item, null where the text has ended or not begun.
    shift = F.col("shift")
    size = F.size("item_h")
    own = F.slice("h", F.greatest(shift, F.lit(0)) + 1, size + F.least(shift, F.lit(0)))
    own = F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(-shift, F.lit(0))), own)
    equal = F.zip_with("item_h", own, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    hits = hits.select("_key", "item", "shift", size.alias("n"), F.slice(equal, 1, size).alias("eq"))
    wide = F.least(F.col("n"), F.lit(stretch))
    best = F.aggregate(
        F.sequence(F.lit(0), F.col("n") - wide),
        F.struct(F.lit(0).alias("most"), F.aggregate(F.slice("eq", 1, wide), F.lit(0), lambda s, x: s + x).alias("now")),
        lambda s, i: F.struct(F.greatest(s["most"], s["now"]).alias("most"), (s["now"] + F.coalesce(F.get("eq", i + wide), F.lit(0)) - F.coalesce(F.get("eq", i), F.lit(0))).alias("now")),
    )["most"]
    total = F.aggregate("eq", F.lit(0), lambda s, x: s + x)
    found = hits.select("_key", "item", "shift", "n", total.alias("equal"), best.alias("best"), wide.alias("wide")).where(F.col("best") * 100 >= F.col("wide") * percent)
    place = F.max(F.struct("equal", (-F.col("shift")).alias("back"), "n"))
    return found.groupBy("_key", "item").agg(place.alias("p")).select(F.col("_key").alias(key), "item", F.col("p.equal").cast("long").alias("n_equal"), F.col("p.n").cast("long").alias("n_tokens"), (-F.col("p.back")).cast("long").alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the rows in which a passage of the benchmark was found; rows with null keys stay."""
    bad = contaminated(docs, benchmark, text, key, **options).select(key).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)

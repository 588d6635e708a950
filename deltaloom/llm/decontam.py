"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet by a join over the hashes of shared word seeds, so neither passes through the driver. Spark
broadcasts the benchmark's seeds where their table is small enough, so the documents' seeds are not shuffled then, and
shuffles both sides otherwise. Only texts that share enough seeds with an item are tiled with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import hold, keep, ship

#: Words of a seed, which is also the shortest tile.
SEED_WORDS = 5
#: Part of an item's words that tiles must cover.
COVERAGE = 0.8
#: Items that a text is tiled with at once.
ITEMS_AT_ONCE = 1000

WORDS = re.compile(r"\w+").findall
BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def window_hashes(ids, width: int):
    """Karp-Rabin hashes, modulo 2^64, of all windows of `width` numbers."""
    import numpy as np

    if len(ids) < width:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(width - 1, BASE, np.uint64)])[::-1]
    ids = np.asarray(ids).astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out += ids[k : len(ids) - width + 1 + k] * powers[k]
    return out


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, doc position, length), longest first, none overlapping in either text.

    Each round looks for matches of the search length by Karp-Rabin hashes over what is still unmarked, extends and
    verifies them, and marks them longest first. The search length starts at the longest seen and falls to `least`.
    """
    import numpy as np

    it, dc = np.asarray(item), np.asarray(doc)
    free_i, free_d = np.ones(len(it), bool), np.ones(len(dc), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, 1)
    if min(len(it), len(dc)) < length:
        return out
    longest = min(len(it), len(dc))
    search = min(max(4 * length, length), longest)
    while True:
        hi, hd = window_hashes(it, search), window_hashes(dc, search)
        clear = lambda free: np.convolve(free, np.ones(search, int), "valid") == search
        pi, pd = np.flatnonzero(clear(free_i)), np.flatnonzero(clear(free_d))
        at: dict[int, list[int]] = {}
        for p in pi.tolist():
            at.setdefault(int(hi[p]), []).append(p)
        pd = pd[np.isin(hd[pd], hi[pi])]
        found, best = [], 0
        seen: set[tuple[int, int]] = set()
        for d in pd.tolist():
            for p in at.get(int(hd[d]), ()):
                if (p - 1, d - 1) in seen:  # inside a match that began earlier
                    seen.add((p, d))
                    continue
                k = 0
                while p + k < len(it) and d + k < len(dc) and free_i[p + k] and free_d[d + k] and it[p + k] == dc[d + k]:
                    k += 1
                if k >= search:
                    seen.add((p, d))
                    found.append((k, p, d))
                    best = max(best, k)
        if best > 2 * search:
            search = best
            continue
        marked = False
        for k, p, d in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
            if free_i[p : p + k].all() and free_d[d : d + k].all():
                free_i[p : p + k] = free_d[d : d + k] = False
                out.append((p, d, k))
                marked = True
        if search > length:
            search = max(length, search // 2)
        elif not marked:  # what a longer tile took may have left shorter matches beside it, so a round that marked is repeated
            return out


def near_seeds(positions, n: int, reach: int):
    """The parts of a text that lie within `reach` words of a seed, as (begin, end)."""
    out: list[list[int]] = []
    for p in positions:
        a, b = max(0, p - reach), min(n, p + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def seed_hashes(words: list[str], width: int):
    """Karp-Rabin hashes of the windows of `width` words; windows of another width have other hashes."""
    import numpy as np
    import xxhash

    ids = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), width) for w in words], np.uint64)
    return window_hashes(ids, width)


def coverage(own: list[str], text: list[str]) -> float:
    """The part of the item's words that tiles with the text cover; only what lies near a shared seed is tiled."""
    import numpy as np

    number = {}
    item = [number.setdefault(w, len(number)) for w in own]
    ids = np.fromiter((number.get(w, -1) for w in text), np.int64, len(text))
    least = min(SEED_WORDS, len(own))
    at = np.flatnonzero(np.isin(window_hashes(ids, least), window_hashes(item, least)) & (np.convolve(ids >= 0, np.ones(least, int), "valid") == least)) if len(ids) >= least else []
    parts = [-2]
    for n, (a, b) in enumerate(near_seeds(list(at), len(ids), 2 * least)):
        parts += [*ids[a:b].tolist(), -3 - n]  # parts are kept apart by numbers that no item has
    return sum(n for _, _, n in tiles(item, parts, least)) / len(own)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item, h, need, width): the distinct seeds of each item, and how many of them a text shares at least that covers enough of it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("decontam")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                if own := words_of(text):
                    width = min(SEED_WORDS, len(own))
                    h, times = np.unique(seed_hashes(own, width).view(np.int64), return_counts=True)
                    # a tile of n words holds n - width + 1 seeds, so covered words are at most width times the seed places
                    places, need, k = COVERAGE * len(own) / width, 0, np.sort(times)[::-1]
                    while need < len(k) and k[:need].sum() < places - 1e-9:
                        need += 1
                    out[0] += [item] * len(h)
                    out[1] += h.tolist()
                    out[2] += [need] * len(h)
                    out[3] += [width] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "h", "need", "width"])

    return items.select("item", "text").mapInArrow(run, "item long, h long, need long, width long")


def _text_seeds(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(tid, h): the distinct seeds of each text of each width that items have, exploded."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        hold("decontam")
        for batch in batches:
            tids, seeds = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                tids.append(hashlib.md5((text or "").encode()).digest())
                seeds.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(seed_hashes(words, w) for w in widths)])).view(np.int64))
            if tids:
                cuts = pa.array(np.cumsum([0, *map(len, seeds)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(seeds)))], ["tid", "hs"])

    return docs.select("text").mapInArrow(run, "tid binary, hs array<long>").select("tid", F.explode("hs").alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with item_ids (sorted; empty for clean documents), coverage (the largest; 0.0) and contaminated.

    Words are lower-cased runs of word characters, so layout and punctuation don't matter. A document and an item meet
    over seeds of SEED_WORDS shared words; greedy string tiling then marks the longest matches first, in any order, and the
    item counts as contained if tiles cover COVERAGE of its words. An item with fewer words than a seed is a seed whole.
    Null or empty texts and items match nothing; items with a null item_id match but carry no id. All columns of docs are
    kept; where one has the name of a new column, the new one replaces it. Repeated rows each get their result; an equal
    text is tiled once. An empty table gives no rows, an empty benchmark no matches.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c.lower() not in {"item_ids", "coverage", "contaminated", "tid__"}]
    tid = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    items, _ = keep(spark, benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items")
    seeds, _ = keep(spark, _item_seeds(items), "seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # SEED_WORDS numbers at most
    pairs = _text_seeds(docs, widths).join(seeds, "h").groupBy("tid", "item").agg(F.count_distinct("h").alias("n"), F.max("need").alias("need")).where("n >= need")
    pairs, _ = keep(spark, pairs.select("tid", "item"), "pairs")
    some = pairs.join(items, "item").groupBy("tid", F.floor(F.col("item") % 1_000_003 / ITEMS_AT_ONCE).alias("block")).agg(F.collect_list(F.struct("item_id", F.col("text").alias("own"))).alias("items"))
    texts = docs.where("text is not null").select(tid.alias("tid"), "text").join(pairs.select("tid").distinct(), "tid").dropDuplicates(["tid"])

    def run(batches):
        import pyarrow as pa

        hold("decontam")
        for batch in batches:
            tids, ids, covers = [], [], []
            for i in range(batch.num_rows):
                text = words_of(batch.column("text")[i].as_py())
                for x in batch.column("items")[i].as_py():
                    own = words_of(x["own"])
                    part = coverage(own, text)
                    if part * len(own) >= COVERAGE * len(own) - 1e-9:
                        tids.append(batch.column("tid")[i].as_py())
                        ids.append(x["item_id"])
                        covers.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(ids, pa.int64()), pa.array(covers, pa.float64())], ["tid__", "item_id", "part"])

    hits = texts.join(some, "tid").select("tid", "text", "items").mapInArrow(run, "tid__ binary, item_id long, part double")
    hits, _ = keep(spark, hits.groupBy("tid__").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("part").alias("coverage")), "hits")
    out = docs.select(*kept, tid.alias("tid__")).join(hits, "tid__", "left")
    return out.select(*kept, F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("coverage").isNotNull().alias("contaminated"))

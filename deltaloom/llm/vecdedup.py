"""Embedding near-duplicates: randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import dealt, keep, ship, whole_keys
from deltaloom.llm.components import components
from deltaloom.llm.simhash import labels_of

#: Bits of a code; vectors are padded with zeros to so many dimensions before the rotation (shorter bounds for more bits).
CODE_BITS = 256
#: The index: bands of code bits that are chosen by chance; a pair is estimated if one band agrees. Bits of a band at least,
#: vectors of a label in a bucket on average, at most about, and the probability that a pair at the threshold shares no band.
BAND_BITS, IN_BUCKET, MISSED = 12, 64, 2e-4
#: Width of the confidence bound, in standard errors.
CONFIDENCE = 4.0
#: A bucket with more vectors is compared in blocks of this size, block pair by block pair.
BLOCK = 4096
TILE = 512
#: Buckets of up to so many vectors are estimated many at a time.
SMALL = 48
SEED = 20240607


def rotation(dim: int):
    """The first `dim` rows of a random orthogonal matrix of the padded size, fixed by SEED."""
    import numpy as np

    size = max(dim, CODE_BITS)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(unit, turn):
    """Codes (+-1), and the stored factor <code, vector> of each unit vector: its rotated absolute values' sum over sqrt(bits)."""
    import numpy as np

    turned = unit @ turn
    signs = np.where(turned >= 0, np.float32(1), np.float32(-1))
    return signs, np.abs(turned).sum(1) / np.sqrt(turned.shape[1]), turned


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands) for so many vectors: a code bit differs with probability acos(threshold) / pi."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = max(BAND_BITS, math.ceil(math.log2(max(1, rows / IN_BUCKET))))
    n, bands = CODE_BITS, 1
    chance = [math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n - bits + 1)]
    meet = [math.comb(n - m, bits) / math.comb(n, bits) for m in range(n - bits + 1)]
    while sum(c * (1 - x) ** bands for c, x in zip(chance, meet)) > MISSED and bands < 4096:
        bands += 1
    return bits, bands


def bands_of(signs, bits: int, bands: int):
    """The bands' values, and another number for each band; no bits: one band that always agrees."""
    import numpy as np

    r = np.random.default_rng(SEED + 1)
    chosen = np.stack([r.permutation(CODE_BITS)[:bits] for _ in range(bands)])
    return ((signs[:, chosen] > 0).astype(np.int64) << np.arange(bits)).sum(2) * 4096 + np.arange(bands)


def bounds(factor, size: int):
    """How far an estimate may lie off: sqrt((1 - f^2) / f^2) * CONFIDENCE / sqrt(bits - 1) for a stored factor f.

    A factor of 0 stands for no estimate: whatever the code says, the pair is computed exactly.
    """
    import numpy as np

    with np.errstate(divide="ignore"):
        return np.sqrt(np.maximum(0, 1 - factor**2)) / factor * CONFIDENCE / np.sqrt(size - 1)


def exact_links(unit, i, j, threshold: float):
    """The pairs whose cosine, in double precision, reaches the threshold."""
    import numpy as np

    keep = [np.einsum("nd,nd->n", unit[i[k : k + (1 << 16)]], unit[j[k : k + (1 << 16)]]) >= threshold for k in range(0, len(i), 1 << 16)]
    hit = np.concatenate([np.zeros(0, bool), *keep])
    return i[hit], j[hit]


def listed_pairs(unit, code, i, j, threshold: float):
    """Links among the pairs (i, j): see tiled_pairs."""
    import numpy as np

    signs, factor, turned = code
    size = turned.shape[1]
    error, maybe = bounds(factor, size), [np.zeros(0, bool)]
    for k in range(0, len(i), 1 << 13):
        p, q = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
        with np.errstate(divide="ignore", invalid="ignore"):
            estimate = np.einsum("nd,nd->n", signs[p], turned[q]) / (np.sqrt(size) * factor[p])
            maybe.append((estimate + error[p] >= threshold) | np.isinf(error[p]))
    maybe = np.concatenate(maybe)
    return exact_links(unit, i[maybe], j[maybe], threshold)


def tiled_pairs(unit, code, left, right, threshold: float):
    """Links (i, j) over index arrays left x right, each pair once where they are the same.

    <code_i, turned_j> / factor_i is an unbiased estimate of the inner product. Only pairs whose estimate plus its bound
    reaches the threshold are computed exactly; the others are left out.
    """
    import numpy as np

    signs, factor, turned = code
    size = turned.shape[1]
    error = bounds(factor, size)
    same, found = left is right, [(np.zeros(0, np.int64),) * 2]
    for p in range(0, len(left), TILE):
        a = left[p : p + TILE]
        for q in range(p if same else 0, len(right), TILE):
            b = right[q : q + TILE]
            with np.errstate(divide="ignore", invalid="ignore"):
                estimate = (signs[a] @ turned[b].T) / (np.sqrt(size) * factor[a])[:, None]
                maybe = (estimate + error[a][:, None] >= threshold) | np.isinf(error[a])[:, None]
            if same and p == q:
                maybe &= np.triu(np.ones(maybe.shape, bool), 1)
            i, j = np.nonzero(maybe)
            found.append(exact_links(unit, a[i], b[j], threshold))
    return tuple(map(np.concatenate, zip(*found)))


def bucket_pairs(unit, code, groups, threshold: float):
    """Links within groups (index arrays of two members or more): those of one small size are taken together."""
    import numpy as np

    found, small = [(np.zeros(0, np.int64),) * 2], {}
    for g in groups:
        if len(g) <= SMALL:
            small.setdefault(len(g), []).append(g)
        else:
            found.append(tiled_pairs(unit, code, g, g, threshold))
    for n, gs in small.items():
        rows, (a, b) = np.stack(gs), np.triu_indices(n, 1)
        step = max(1, (1 << 20) // len(a))
        for k in range(0, len(rows), step):
            found.append(listed_pairs(unit, code, rows[k : k + step, a].ravel(), rows[k : k + step, b].ravel(), threshold))
    return tuple(map(np.concatenate, zip(*found)))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and their cosine, in double precision, reaches the threshold.
    Rows with equal label and embedding are one class, so copies are never paired: a class links with classes, weighted
    by their sizes. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
    another length. Null vec_ids count as links of others but have a null component. A vec_id that repeats gives one row
    per row. An empty table gives no rows. Other columns are ignored.

    Every class is indexed under each of its code's bands; bands have more bits the more classes there are, and are as many
    as a pair at the threshold needs to share one with probability 1 - MISSED. exact: no index and no estimates instead, each
    label's classes are all compared. Buckets over BLOCK classes are dealt out as pairs of blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("long").alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    cid = F.when(F.coalesce(good, F.lit(False)), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.concat_ws(",", F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")))), 256))
    rows, _ = keep(spark, rows.withColumn("cid", cid), "vectors")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    # a class without any vec_id still is a link of others; it takes a negative number of its own
    classes = classes.withColumn("rep", F.coalesce("rep", -F.abs(F.xxhash64("cid") / 2).cast("long") - 1))
    classes, _ = keep(spark, classes, "classes")
    found, _ = keep(spark, _bucket_links(spark, classes, threshold, exact), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("near"))
    comp = components(spark, found.where("b is not null"), "a", "b")
    # a class whose smallest member is not a document's takes the component's smallest vec_id
    named = comp.groupBy("component").agg(F.min(F.when(F.col("node") >= 0, F.col("node"))).alias("named"))
    comp = comp.join(named, "component").select("node", F.coalesce("named", "component").alias("component"))
    of = classes.select("cid", "rep", "size").join(links, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = of.select("cid", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(of, "cid", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def unit_vectors(v, at):
    """Rows `at` of an Arrow list column, of one length, in double precision and divided by their norms."""
    import numpy as np

    x = np.stack([v[i].values.to_numpy() for i in at.tolist()]).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_links(spark: SparkSession, classes: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """(a, null, n): n more links of class a; (a, b, null): a and b are connected."""
    bits, bands = (0, 1) if exact else plan(classes.count(), threshold)

    def code(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict[int, object] = {}
        for batch in batches:
            v = batch.column("v")
            size, values = np.diff(v.offsets.to_numpy()), [None] * batch.num_rows
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                signs = encode(unit_vectors(v, at), turns.setdefault(dim, rotation(dim)))[0]
                for i, b in zip(at.tolist(), bands_of(signs, bits, bands).tolist()):
                    values[i] = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(values, pa.list_(pa.int64()))], [*batch.schema.names, "dim", "bands"])

    kind = f"rep long, size long, label long, v {dict(classes.dtypes)['v']}, dim int, bands array<long>"
    coded, _ = keep(spark, classes.select("rep", "size", "label", "v").mapInArrow(code, kind), "codes")
    met = coded.select("label", "dim", F.explode("bands").alias("band"), "rep", "size", "v")
    dealt_ = dealt(spark, met, ["label", "dim", "band"], "rep", BLOCK)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict[int, object] = {}
        for t in whole_keys(batches):
            t = t.combine_chunks()
            key, lo, hi, mine, label, dim, band, rep, size = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "mine", "label", "dim", "band", "rep", "size"))
            tell_a, tell_b, tell_n = [], [], []
            # 64-bit keys of two buckets may be equal: what a bucket stands for is compared too
            order = np.lexsort((hi, lo, band, dim, label, key))
            parts = np.stack([x[order] for x in (key, label, dim, band, lo, hi)], 1)
            begin = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]).any(1)])
            end = np.r_[begin[1:], len(order)]
            big = end - begin > 1
            if not big.any():
                continue
            v = t.column("v").chunk(0)
            for d in np.unique(dim).tolist():
                rows_d = np.flatnonzero(dim == d)
                x = unit_vectors(v, rows_d)
                signs, factor, turned = encode(x, turns.setdefault(d, rotation(d)))
                values = bands_of(signs, bits, bands)
                code = signs, np.zeros_like(factor) if exact else factor, turned.astype(np.float32)
                place = np.full(len(dim), -1)
                place[rows_d] = np.arange(len(rows_d))
                groups, found = [], []
                for s, e in zip(begin[big].tolist(), end[big].tolist()):
                    at = order[s:e]
                    if dim[at[0]] != d:
                        continue
                    if lo[at[0]] == hi[at[0]]:
                        groups.append(place[at])
                    else:
                        found.append(tiled_pairs(x, code, place[at[mine[at] == lo[at]]], place[at[mine[at] == hi[at]]], threshold))
                i, j = map(np.concatenate, zip(bucket_pairs(x, code, groups, threshold), *found))
                first = (values[i] == values[j]).argmax(1) == band[rows_d[i]] % 4096 if len(i) else np.zeros(0, bool)
                i, j = i[first], j[first]  # a pair counts where its first common band has it
                near = np.bincount(i, size[rows_d[j]], len(x)) + np.bincount(j, size[rows_d[i]], len(x))
                has = np.flatnonzero(near)
                lab = labels_of(len(x), i, j)
                star = np.flatnonzero(lab != np.arange(len(x)))
                tell_a += [rep[rows_d[has]], rep[rows_d[star]]]
                tell_b += [np.full(len(has), -1), rep[rows_d[lab[star]]]]
                tell_n += [near[has].astype(np.int64), np.full(len(star), -1)]
            if tell_a:
                a, b, c = map(np.concatenate, (tell_a, tell_b, tell_n))
                counts = c >= 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counts), pa.array(c, mask=~counts)], ["a", "b", "n"])

    return dealt_.mapInArrow(run, "a long, b long, n long")

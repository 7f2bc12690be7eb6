"""Near-duplicate embeddings: Euclidean p-stable hashing finds candidates, exact cosines decide."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.plans.ship import ship_package

from .common import arrow_schema, materialize
from .components import connected_components, in_blocks, whole_groups
from .hot_keys import join_counted
from .simhash import near_pairs

#: Width of a quantisation step of a projection of unit vectors.
WIDTH = 1.2
#: Chance that a pair at exactly the threshold shares no bucket; and that its signatures are too far apart.
MISS, SIGN_MISS = 1e-5, 1e-7
#: Unrelated vectors that may share a bucket with one, on the average: signatures tell them apart for little.
STRANGERS = 512
#: Words of 64 bits of a signature, which holds the signs of as many projections.
SIGN_WORDS = 2
#: Rows of a bucket that are compared in one block; larger buckets are dealt into such parts.
BLOCK_ROWS = 4096


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a distance share a quantised projection on a normal vector."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """(hashes in a table, tables) for n vectors: more hashes for more vectors, and tables for MISS."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    hashes = max(2, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return hashes, math.ceil(math.log(MISS) / math.log(1 - near**hashes))


def sign_radius(cosine: float) -> int:
    """Differing bits that signatures of a pair at the threshold exceed with a chance of SIGN_MISS at most."""
    bits, p = 64 * SIGN_WORDS, math.acos(cosine) / math.pi
    beyond, radius = 0.0, bits
    while radius > 0 and (beyond := beyond + math.comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)) <= SIGN_MISS:
        radius -= 1
    return radius


def units(rows: np.ndarray) -> np.ndarray:
    """Rows as doubles at length 1; none is zero."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _valid(v: Column) -> Column:
    """Vectors that can link: not null, empty or zero, without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _hashed(schema: pa.Schema, hashes: int, tables: int, seed: int):
    """Adds codes (a bucket for each table, of label and length too) and a signature to (label, h1, h2, cls, n, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("vec")
            dims = vec.value_lengths().to_numpy(zero_copy_only=False)
            labels = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in batch.column("label").to_pylist()], dtype=np.int64)
            codes = np.empty((batch.num_rows, tables), dtype=np.int32)
            signs = np.empty((batch.num_rows, SIGN_WORDS), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    shift = rng.random(hashes * tables) * WIDTH
                    planes[dim] = rng.standard_normal((dim, hashes * tables)), shift, rng.integers(1, 1 << 62, hashes) * 2 + 1, rng.standard_normal((dim, 64 * SIGN_WORDS))
                at = np.nonzero(dims == dim)[0]
                x = units(vec.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim))
                a, b, mix, c = planes[dim]
                steps = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(at), tables, hashes)
                with np.errstate(over="ignore"):
                    mixed = (steps * mix).sum(axis=2) + (labels[at] * 1_000_003 + dim)[:, None]
                    codes[at] = (mixed * np.int64(-7046029254386353131) >> np.int64(32)).astype(np.int32)
                signs[at] = np.packbits(x @ c > 0, axis=1, bitorder="little").view("<i8")
            arrays = [*batch.columns, pa.array(dims.astype(np.int32)), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * tables, codes.ravel())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays + [pa.array(signs[:, k]) for k in range(SIGN_WORDS)], schema, strict=True)], schema=schema)

    return run


def _counted_here(own: np.ndarray, parts: tuple[int, int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs (i, j) that this block of a bucket counts: rows of one part meet in each block of that part, the one with the first other part counts them."""
    a, b = parts
    return np.ones(len(i), dtype=bool) if a == b else (own[i] != own[j]) | ((own[i] == a) & (b == (0 if a else 1))) | ((own[i] == b) & (a == 0))


def _fresh(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that no earlier table puts in one bucket; codes: those of the earlier tables."""
    fresh = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        fresh[part] = ~(codes[i[part]] == codes[j[part]]).any(axis=1)
    return fresh


def _candidates(radius: int):
    """Of whole buckets of signatures, the rows of pairs within radius that no earlier table has."""
    names = ["t", "code", "part_a", "part_b", "own", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 4, 50_000):
            get = lambda name: table.column(name).combine_chunks()
            t, own, part_a, part_b = (get(c).to_numpy(zero_copy_only=False) for c in ("t", "own", "part_a", "part_b"))
            signs = np.column_stack([get(f"s{k}").to_numpy() for k in range(SIGN_WORDS)]).view(np.uint64)
            earlier, each = get("codes"), np.arange(table.num_rows)
            wanted = np.zeros(table.num_rows, dtype=bool)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                codes = earlier[lo:hi].flatten().to_numpy().reshape(hi - lo, int(t[lo]))
                for i, j in near_pairs(signs[lo:hi], each[lo:hi], radius):
                    here = _counted_here(own[lo:hi], (int(part_a[lo]), int(part_b[lo])), i, j)
                    i, j = i[here], j[here]
                    fresh = _fresh(codes, i, j)
                    wanted[lo + i[fresh]] = wanted[lo + j[fresh]] = True
            yield pa.RecordBatch.from_arrays([get(c).filter(pa.array(wanted)) for c in names], names=names)

    return run


def _linked(cosine: float):
    schema = pa.schema([("row", pa.int64()), ("cls", pa.int64()), ("add", pa.int64()), ("root", pa.int64())])

    def group(t: int, own: np.ndarray, parts: tuple[int, int], n: np.ndarray, codes: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each row's linked classes weigh, and a root for each row, over the links that this block counts."""
        add, root = np.zeros(len(n), dtype=np.int64), np.arange(len(n))
        for s in range(0, len(n), 256):
            i, j = np.nonzero(vec[s : s + 256] @ vec[s:].T >= cosine)
            i, j = i + s, j + s
            keep = (i < j) & _counted_here(own, parts, i, j)
            i, j = i[keep], j[keep]
            fresh = _fresh(codes[:, :t], i, j)
            i, j = i[fresh], j[fresh]
            np.add.at(add, i, n[j])
            np.add.at(add, j, n[i])
            for x in np.unique(i):
                roots = np.unique(np.append(root[j[i == x]], root[x]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        return add, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 6, 20_000):
            get = lambda name: table.column(name).combine_chunks()
            t, own, part_a, part_b, row, cls, n, dims = (get(c).to_numpy(zero_copy_only=False) for c in ("t", "own", "part_a", "part_b", "row", "cls", "n", "dim"))
            codes = get("codes").flatten().to_numpy().reshape(table.num_rows, -1)
            vec = get("vec")
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x = units(vec[lo:hi].flatten().to_numpy().reshape(hi - lo, int(dims[lo])))
                add, root = group(int(t[lo]), own[lo:hi], (int(part_a[lo]), int(part_b[lo])), n[lo:hi], codes[lo:hi], x)
                hit = np.nonzero(add)[0]
                out.append((row[lo:hi][hit], cls[lo:hi][hit], add[hit], cls[lo:hi][root[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return run


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, seed: int = 42
) -> DataFrame:
    """Links of vectors with cosine >= `cosine` (doubles) of one label: id_col, n_links, component_id, kept.

    n_links counts other rows linked directly; component_id is the smallest id reachable. Buckets exchange
    signatures; a pair that shares a bucket of any table goes on to the exact comparison, once, unless its signatures
    are further apart than pairs at the threshold ever are but for SIGN_MISS. So no link is below the threshold; a pair
    right at it is missed with a chance of MISS + SIGN_MISS, a closer one with less. Equal vectors are one class
    and weigh as many rows. Buckets send out only sums and a root for each row, never their pairs.
    Larger buckets are dealt into blocks.

    Null, empty and zero vectors, those with null or non-finite components, and rows with a null
    label or id link with nothing; a row of a null id has a null component and isn't kept. Vectors of
    different lengths don't link. Rows of equal id and vector count as rows of one class; other
    rows of equal ids are one node. label_col None compares all rows. Ids are integers. An empty table gives
    an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    label = F.lit("") if label_col is None else vectors[label_col].cast("string")
    # Vectors travel as they are stored; floats are half as wide as doubles.
    stored = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.alias("label"), vectors[vector_col].cast(f"array<{stored}>").alias("v"))
    linkable = F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("v"))
    same = ["label", "h1", "h2"]
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(stored))  # zero has one sign
    base = rows.select("id", "label", F.when(linkable, F.xxhash64(plain)).alias("h1"), F.when(linkable, F.xxhash64(F.lit(11), plain)).alias("h2"), "v")

    hashes, tables = tables_for(vectors.count(), cosine)
    classes = base.filter("h1 IS NOT NULL").groupBy(*same).agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.first("v").alias("vec"))
    signs = [f"s{k}" for k in range(SIGN_WORDS)]
    schema = f"label string, h1 long, h2 long, cls long, n long, vec array<{stored}>, dim int, codes array<int>, " + ", ".join(f"{s} long" for s in signs)
    classes = materialize(classes.mapInArrow(_hashed(arrow_schema(schema), hashes, tables, seed), schema).withColumn("row", F.monotonically_increasing_id()))

    keys = ["t", "code", "part_a", "part_b"]
    coded = classes.select("row", *signs, F.posexplode("codes").alias("t", "code"), "codes")
    coded = coded.select("row", *signs, "t", "code", F.slice("codes", F.lit(1), F.col("t")).alias("codes"))
    blocks = in_blocks(coded, ["t", "code"], "row", BLOCK_ROWS, alone_too=True).select(*keys, "own", "row", *signs, "codes")
    wanted = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_candidates(sign_radius(cosine)), "t int, code int, part_a int, part_b int, own int, row long")
    full = materialize(wanted).join(classes.select("row", "label", "dim", "cls", "n", "codes", "vec"), "row")
    keys += ["dim", "label"]
    full = full.select(*keys, "own", "row", "cls", "n", "codes", "vec").repartition(*keys).sortWithinPartitions(*keys)
    links = materialize(full.mapInArrow(_linked(cosine), "row long, cls long, add long, root long"))

    weights = links.groupBy("row").agg(F.sum("add").alias("linked"))
    components = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = classes.select(*same, "row", "cls", "n").join(weights, "row", "left").join(components.withColumnRenamed("node", "cls"), "cls", "left")
    known = materialize(known.select(*same, "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return join_counted(base.select("id", *same), known, same, "n", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )

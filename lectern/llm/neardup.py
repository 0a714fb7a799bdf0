"""Near duplicates by MinHash and odd sketches (operator 4).

1. Each document's set of word shingles gets a fingerprint, MinHash samples in bands, and an odd sketch: samples flip bits
   of a bitmap, so the XOR of two bitmaps has about as many ones as the samples that differ.
2. Documents with equal sets form a class; from here on its smallest id stands for it.
3. Representatives that share a band meet in a bucket.  A bucket is searched breadth first by sketches: one bitmap is
   compared with all not yet reached, which gives a spanning forest and never the list of all pairs.
4. The forests' components are candidates.  Within a component full sets are compared, again breadth first: one
   set against all not yet reached.  What is reached is linked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textnum
from lectern.llm.common import buckets_for, checkpointed, connected_components, in_small_batches

#: At similarity 0.8 a pair misses all bands with probability (1 - 0.8**6)**48 < 5e-7.
BANDS, ROWS = 48, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Bitmaps that differ in more bits aren't compared further.  At similarity 0.8 about 93 differ, with a deviation of 12.
MOST_DIFFERENT = 155
#: Members of a bucket in one task, and shingles of a component in one task; larger ones are split into pairs of parts.
BUCKET_PART, CELL_SHINGLES = 20_000, 3_000_000

_rng = np.random.default_rng(88172645)
_MULTIPLY = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_KEY = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BIT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's set of shingles as sorted distinct numbers: runs of ``k`` lower-cased words, or all words if fewer."""
    numbers, bounds = textnum.words([(t or "").encode("utf-8", "surrogatepass").translate(textnum.LOWER) for t in texts])
    runs = textnum.windows(numbers, k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif n:
            out.append(textnum.windows(numbers[a:b], int(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _samples(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 4096):  # bounded memory for any length
        part = low[at : at + 4096]
        np.minimum(least, (_MULTIPLY[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=least)
    return least


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                sets = shingle_sets(batch.column(1).to_pylist(), k)
                samples = np.stack([_samples(s) for s in sets]).astype(np.uint64)
                keys = textnum.mixed((samples.reshape(-1, BANDS, ROWS) * _KEY).sum(axis=2, dtype=np.uint64) + _BAND)
                bits = textnum.mixed(samples * _BIT + _BIT) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
                flips = np.bincount((np.arange(len(sets))[:, None] * SKETCH_BITS + bits.astype(np.int64)).ravel(), minlength=len(sets) * SKETCH_BITS)
                sketches = np.packbits((flips & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1)
                prints = [_fingerprint(s) for s in sets]
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p if ok else None for p, ok in zip(prints, some)], pa.binary()),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(sketches, some)], pa.binary()),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(keys, some)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "print", "sketch", "bands"],
                )

    return run


def _fingerprint(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _slices(batch: pa.RecordBatch, size: int = 1_900_000) -> Iterator[pa.RecordBatch]:
    """Rows of about ``size`` bytes of the second column, or one longer row."""
    import pyarrow.compute as pc

    sizes, at = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0
    while at < batch.num_rows:
        end, total = at + 1, sizes[at]
        while end < batch.num_rows and total + sizes[end] <= size:
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _deal(parts: int):
    """Band keys and ids of a batch, packed by the partition they go to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            ids = np.repeat(batch.column(0).to_numpy().astype(np.int64), BANDS)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            to = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ids, keys = ids[order], keys[order]
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
                    pa.array([ids[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
                ],
                names=["part", "keys", "ids"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of buckets of two or more, with the bucket's size."""
    keys, ids = [], []
    for batch in batches:
        keys += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        ids += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    if not keys:
        return
    key, member = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key, kind="stable")
    key, member = key[order], member[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    sizes = np.diff(np.append(np.flatnonzero(first), len(key)))
    size = np.repeat(sizes, sizes)
    for at in range(0, len(key), 50_000):
        s = slice(at, at + 50_000)
        many = size[s] > 1
        yield pa.RecordBatch.from_arrays([pa.array(key[s][many].view(np.int64)), pa.array(member[s][many]), pa.array(size[s][many].astype(np.int64))], names=["key", "id", "size"])


def _in_parts(rows: DataFrame, cell: str, key: str, parts) -> DataFrame:
    """Rows dealt to one cell for each pair of parts that includes their own part; one part: one cell."""
    return (
        rows.withColumn("__parts", parts.cast("int"))
        .withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        .where("__parts = 1 or __other <> __own")  # with two parts or more, every pair of parts has both parts whole
        .withColumn(cell, F.struct(F.col(key), F.least("__own", "__other").alias("a"), F.greatest("__own", "__other").alias("b")))
        .drop("__parts", "__own", "__other")
    )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of buckets under sketches; each partition's edges form one forest."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.concat_tables(tables)
    cell, ids = t.column("cell").to_numpy(), t.column("id").to_numpy()
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(ids), SKETCH_BITS // 64)
    order = np.lexsort((ids, cell))
    cell, ids, sketches = cell[order], ids[order], sketches[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    edges = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        left = np.arange(a, b)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(sketches[left] ^ sketches[x]).sum(axis=1) <= MOST_DIFFERENT
                for y in left[near].tolist():
                    u, v = root(int(ids[x])), root(int(ids[y]))
                    if u != v:
                        top[max(u, v)] = min(u, v)
                        edges.append((max(u, v), min(u, v)))
                queue += left[near].tolist()
                left = left[~near]
    for at in range(0, len(edges), 50_000):
        part = np.array(edges[at : at + 50_000], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def linked_groups(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Groups connected by links ``100 * both >= percent * either``, by places in ``ids``."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [[0, 1]] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else [[0], [1]]
    sizes = np.array([len(s) for s in sets])
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), bool)
    left, flat, cuts = np.arange(len(sets)), places, starts[:-1]
    groups = []
    while len(left):
        group, queue = [], [int(left[0])]
        keep = np.ones(len(left), bool)
        keep[0] = False
        while True:
            if not keep.all():  # drop what has been reached
                held = np.repeat(keep, sizes[left])
                left, flat = left[keep], flat[held]
                cuts = np.concatenate([[0], np.cumsum(sizes[left])])[:-1].astype(np.int64)
            if not queue:
                break
            x = queue.pop()
            group.append(x)
            if not len(left):
                keep = np.ones(0, bool)
                continue
            own = places[starts[x] : starts[x + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], cuts, dtype=np.int64)
            mark[own] = False
            near = 100 * both >= percent * (sizes[x] + sizes[left] - both)
            queue += left[near].tolist()
            keep = ~near
        groups.append(group)
    return groups


def _verified(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component", sort=False):
            ids = part["id"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part["set"]]
            for group in linked_groups(ids, sets, percent):
                least = min(int(ids[i]) for i in group)
                out += [(int(ids[i]), least) for i in group if ids[i] != least]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                sets = shingle_sets(batch.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *batch.columns[2:]], names=["id", "set", *batch.schema.names[2:]])

    return run


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` of every document.

    The set of a document are its distinct runs of ``words`` words with A-Z lower-cased; fewer words are one run.  Documents are
    linked if ``100 * intersection >= percent * union``, decided on full sets; a component is what links connect, named by its
    smallest key, and that document is kept.  Null texts and texts without words have empty sets and are
    linked with nothing.  Texts are used whole, however long.  Equal rows fall into one class; repeated keys keep a row each, and different
    texts under one key count as linked with each other.  Of equally good names the smallest key wins.  Empty tables give empty results; extra columns
    are ignored, whatever their names.

    ``percent`` may be 80 or more: the number of bands and the sketch's tolerance are chosen for 80.
    """
    if percent < 80:
        raise ValueError("bands are chosen for a similarity of 0.8 or more")
    parts = buckets_for(docs)
    slim = in_small_batches(docs).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = checkpointed(slim.mapInArrow(_signatures(words), "id bigint, n_shingles bigint, print binary, sketch binary, bands binary"))
    some = signed.where("print is not null")
    classes = some.groupBy("print").agg(F.min("id").alias("rep"))
    # one signature for each class; repeated keys of one text would otherwise give two
    reps = some.join(classes.select(F.col("rep").alias("id"), "print"), ["id", "print"], "left_semi").select("id", "sketch", "bands")
    dealt = reps.select("id", "bands").mapInArrow(_deal(parts), "part int, keys binary, ids binary").repartitionById(parts, F.col("part"))
    members = dealt.mapInArrow(_shared, "key bigint, id bigint, size bigint").distinct()
    members = members.join(reps.select("id", "sketch").repartition("id").dropDuplicates(["id", "sketch"]), "id")
    cells = _in_parts(members, "cell", "key", F.ceil(F.col("size") / BUCKET_PART)).select(F.xxhash64("cell").alias("cell"), "id", "sketch")
    edges = cells.repartition(parts, "cell").mapInArrow(_forest, "a bigint, b bigint")
    candidates = connected_components(edges).withColumnRenamed("id", "member")
    sized = some.select("id", "n_shingles").join(candidates, F.col("id") == F.col("member"), "inner").dropDuplicates(["id"])
    loads = sized.groupBy("component").agg(F.sum("n_shingles").alias("load"))
    placed = checkpointed(sized.select("id", "component").join(loads, "component").select("id", "component", F.ceil(F.col("load") / CELL_SHINGLES).cast("int").alias("parts")))
    full = slim.join(placed, "id").select("id", "text", "component", "parts").mapInArrow(_sets(words), "id bigint, set binary, component bigint, parts int")
    whole = full.where("parts <= 1").withColumn("cell", F.pmod(F.xxhash64("component"), F.lit(parts * 4)))
    links = whole.groupBy("cell").applyInPandas(_verified(percent), "a bigint, b bigint")
    labels = links.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    if placed.where("parts > 1").limit(1).count():
        split = _in_parts(full.where("parts > 1").withColumnRenamed("parts", "p"), "cell", "component", F.greatest(F.lit(2), F.col("p")))
        more = split.withColumn("cell", F.xxhash64("cell")).select("cell", "id", "set", "component").groupBy("cell").applyInPandas(_verified(percent), "a bigint, b bigint")
        labels = connected_components(links.unionAll(more)).select(F.col("id").alias("rep"), "component")
    labels = labels.groupBy("rep").agg(F.min("component").alias("component"))
    # kept, so that both sides of the join are plain exchanges and very many copies of one text can be split over tasks
    named = checkpointed(classes.join(labels, "rep", "left").select("print", F.coalesce("component", "rep").alias("component")))
    alone = signed.where("print is null").select("id", "n_shingles", F.col("id").alias("component"))
    out = some.select("id", "n_shingles", "print").join(named, "print").select("id", "n_shingles", "component").unionAll(alone)
    component = F.col("component")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))

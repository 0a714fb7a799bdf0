"""Exact substring deduplication by fixed-block anchors (operator 1).

A repeat of ``window`` words contains a whole block of its other occurrence's document, if documents are cut into blocks of
``(window + 1) // 2`` words from their start.  So the blocks are an index of the corpus, and every rolling run of a block's length probes it.
Around hits, the windows of full length that contain a hit are compared by a 96-bit number; consecutive equal
windows are the maximal exact repeats, and the words they cover are removed.

Documents travel once, packed in chunks to the partition where they stay; probes and answers travel as packed
arrays.  A run that occurs often within a chunk probes once for all, so frequent passages cost one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import textnum
from lectern.llm.common import in_small_batches, shuffle_partitions

#: Bytes of text for each partition on executors with up to 900 MB of heap a core; it grows with their memory, as one task holds a partition's entries.
PARTITION = 8 << 20
#: Heap of a core for each byte of a partition.
HEAP_SHARE = 112
#: A chunk is half a partition of text but no less than this; a longer document is a chunk of its own, and a row counts ``ROW`` bytes more than its text.
SMALL_CHUNK, ROW = 1 << 18, 16
GOLDEN = 0.6180339887498949
#: Flags of an entry: the run is a block, or it occurs more than once within its chunk.
BLOCK, AGAIN = 1, 2


def _same(k: int) -> int:
    """A partition number is its own partition."""
    return k


@lru_cache(maxsize=1)
def _codec():
    import zstandard as zs

    return zs.ZstdCompressor(level=1), zs.ZstdDecompressor()


def _squeeze(steps: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: the steps between places compressed, split into planes of their bytes; hashed numbers don't compress."""
    planes = _codec()[0].compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), 4).T).tobytes())
    head = np.array([len(steps), len(planes)], np.uint32).tobytes()
    return b"".join([head, bytes([len(arrays), *(a.itemsize for a in arrays)]), planes, *(a.tobytes() for a in arrays)])


def _expand(data: bytes) -> list[np.ndarray]:
    """Places and the other arrays of ``_squeeze``."""
    n, length = np.frombuffer(data, np.uint32, 2).tolist()
    sizes = data[9 : 9 + data[8]]
    at = 9 + len(sizes)
    planes = np.frombuffer(_codec()[1].decompress(data[at : at + length], max_output_size=4 * n), np.uint8).reshape(4, n)
    out = [np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32), dtype=np.uint32)]
    at += length
    for size in sizes:
        out.append(np.frombuffer(data, np.dtype(f"u{size}"), n, at))
        at += n * size
    return out


def _steps(places: np.ndarray) -> np.ndarray:
    """Places as their differences, the first one from 0."""
    return np.diff(places.astype(np.uint32), prepend=np.uint32(0))


def _pack(parts: int, size: int):
    """Rows as chunks of about ``size`` bytes: (partition it stays in, its name, compressed rows).

    A task's chunks go to neighbouring partitions, and multiples of the golden ratio spread the tasks evenly, however many there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        begin = int(task * GOLDEN % 1 * parts)

        def chunk(slices: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, slices[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for s in slices:
                    w.write_batch(s)
            to, name = (begin + seq) % parts, (task << 24) + seq
            return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "name", "body"])

        slices, total, seq = [], 0, 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.add(pc.fill_null(pc.binary_length(batch.column(1)), 0), ROW).to_pylist()):
                if total and total + n > size:
                    if i > start:
                        slices.append(batch.slice(start, i - start))
                    yield chunk(slices, seq)
                    slices, total, seq, start = [], 0, seq + 1, i
                total += n
            if batch.num_rows > start:
                slices.append(batch.slice(start))
        if slices:
            yield chunk(slices, seq)

    return run


class _Chunk:
    """The documents of a chunk with their words as numbers."""

    def __init__(self, body: bytes):
        self.batch = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in self.batch.column(1).to_pylist()]
        self.numbers, self.bounds = textnum.words(self.texts)
        self.document = np.repeat(np.arange(len(self.texts)), np.diff(self.bounds))

    def runs(self, length: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and places of all runs of ``length`` words inside one document, or of those that ``of`` marks."""
        n = len(self.numbers) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = self.document[:n] == self.document[length - 1 :]
        places = np.flatnonzero(inside if of is None else inside & of[:n])
        return textnum.windows(self.numbers, length)[places], places


def _grouped(numbers: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal numbers as groups: an order, where groups start in it, and each group's flags; ``AGAIN`` if it has two members."""
    order = np.argsort(numbers, kind="stable")
    n = numbers[order]
    starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, np.int64)
    if not len(n):
        return order, starts, np.empty(0, np.uint8)
    both = np.bitwise_or.reduceat(flags[order], starts)
    both[np.diff(np.append(starts, len(n))) > 1] |= AGAIN
    return order, starts, both


def _send(numbers, second, places, flags, parts: int, sender: tuple[int, int], wide: bool):
    """One entry for each distinct run of the chunk, packed by the partition that its number belongs to."""
    order, starts, both = _grouped(numbers, flags)
    if not len(starts):
        return
    first = order[starts]
    upper = numbers[first] >> np.uint64(32)
    to = (upper % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((places[first], to))
    first, both, to = first[by], both[by].astype(np.uint8), to[by]
    # the partition holds the rest of the upper half
    short, rest = (numbers[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (upper[by] // np.uint64(parts)).astype(np.uint32)
    body = [both, short, rest, second[first]] if wide else [both, short, rest.astype(np.uint8)]
    steps = _steps(places[first])
    cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
    steps[cuts[:-1]] = places[first[cuts[:-1]]]
    for p, a, b in zip(to[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        yield p, (*sender, _squeeze(steps[a:b], *(x[a:b] for x in body)))


def _probe(block: int, parts: int):
    def run(part: int, chunks: Iterator) -> Iterator:
        for _, (name, body) in chunks:
            c = _Chunk(body)
            numbers, places = c.runs(block)
            own = places - c.bounds[c.document[places]]
            flags = np.where(own % block == 0, BLOCK, 0).astype(np.uint8)
            yield from _send(numbers, None, places, flags, parts, (part, name), False)

    return run


def _answer(needs_block: bool):
    """For the entries of a partition: the places whose run occurs elsewhere, sent back to their chunks."""
    def run(entries: Iterator) -> Iterator:
        senders, firsts, keys, flags, places = [], [0], [], [], []
        for _, (part, name, data) in entries:
            at, flag, short, *rest = _expand(data)
            senders.append((part, name))
            firsts.append(firsts[-1] + len(at))
            places.append(at)
            flags.append(flag)
            key = short.astype(np.uint64) | rest[0].astype(np.uint64) << np.uint64(32)
            keys.append(key if len(rest) == 1 else np.rec.fromarrays([key, rest[1]]))
        if not senders:
            return
        flag = np.concatenate(flags)
        if needs_block:
            order, starts, both = _grouped(np.concatenate(keys), flag)
        else:
            first, second = (np.concatenate([k[f] for k in keys]) for f in ("f0", "f1"))
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            both = np.bitwise_or.reduceat(flag[order], starts)
            both[np.diff(np.append(starts, len(order))) > 1] |= AGAIN
        good = (both & AGAIN).astype(bool) & ((both & BLOCK).astype(bool) | (not needs_block))
        hit = np.zeros(len(flag), bool)
        hit[order] = np.repeat(good, np.diff(np.append(starts, len(order))))
        for (part, name), a, b, at in zip(senders, firsts[:-1], firsts[1:], places):
            found = at[hit[a:b]]
            if len(found):
                yield part, (name, _squeeze(_steps(found)))

    return run


def _told(rows: Iterator) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Each chunk of a partition with the places it was told, which arrive with it."""
    bodies, told = {}, {}
    for _, (name, *data) in rows:
        if len(data) == 2:
            bodies[name] = data[0]
        else:
            told.setdefault(name, []).append(_expand(data[0])[0])
    for name, body in bodies.items():
        yield name, body, np.concatenate(told[name]).astype(np.int64) if name in told else np.empty(0, np.int64)


def _spread(numbers: np.ndarray, places: np.ndarray, told: np.ndarray, size: int) -> np.ndarray:
    """Marks every place whose run equals one that was told."""
    mark = np.zeros(size, bool)
    if len(told):
        mark[told] = True
        mark[places[np.isin(numbers, numbers[mark[places]])]] = True
    return mark


def _extend(block: int, window: int, parts: int):
    def run(part: int, rows: Iterator) -> Iterator:
        for name, body, told in _told(rows):
            if not len(told):
                continue
            c = _Chunk(body)
            numbers, places = c.runs(block)
            hits = np.concatenate([[0], np.cumsum(_spread(numbers, places, told, len(c.numbers)))])
            span = window - block + 1
            ends = np.minimum(np.arange(len(c.numbers)) + span, len(c.numbers))
            numbers, places = c.runs(window, hits[ends] > hits[:-1])
            second = textnum.windows(c.numbers, window, 0x2545F4914F6CDD1D)[places].astype(np.uint32)
            yield from _send(numbers, second, places, np.zeros(len(places), np.uint8), parts, (part, name), True)

    return run


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, told in zip(batch.column(0), batch.column(1)):
                c = _Chunk(body.as_py())
                told = np.frombuffer(told.as_py(), np.int64)
                covered = np.zeros(len(c.numbers), bool)
                if len(told):
                    numbers, places = c.runs(window)
                    starts = np.flatnonzero(_spread(numbers, places, told, len(c.numbers)))
                    change = np.zeros(len(c.numbers) + 1, np.int32)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                    covered = np.cumsum(change[:-1]) > 0
                removed = np.add.reduceat(np.append(covered, False).astype(np.int64), c.bounds[:-1]) if len(c.texts) else np.empty(0, np.int64)
                removed[np.diff(c.bounds) == 0] = 0
                kept = []
                for text, a, b, n in zip(c.texts, c.bounds[:-1], c.bounds[1:], removed):
                    words = text.split()
                    kept.append(b" ".join(compress(words, ~covered[a:b]) if n else words))
                yield pa.RecordBatch.from_arrays(
                    [c.batch.column(0), pa.array(np.diff(c.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["key", "n_words", "n_removed", "kept"],
                )

    return run


def partition_bytes(spark: SparkSession) -> int:
    """Bytes of text for each partition: ``PARTITION``, or a ``HEAP_SHARE``-th of an executor core's heap, if the session names both and that is more."""
    conf = spark.sparkContext.getConf()
    heap, cores = conf.get("spark.executor.memory"), conf.get("spark.executor.cores")
    if not heap or not cores:
        return PARTITION
    return max(PARTITION, (spark._jvm.org.apache.spark.util.Utils.memoryStringToMb(heap) << 20) // int(cores) // HEAP_SHARE)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``(key, n_words, n_removed, kept)``: each document without the words that an exact repeat covers.

    Words are runs other than ASCII white space, unchanged.  A word goes if a run of ``window`` words of its document that covers
    it starts anywhere else too, in another document or the same one, overlapping or not.  All runs
    are judged on the input, so of two equal passages both go.  ``kept`` joins what is left by single spaces.

    Null, empty and short texts have nothing removed.  Whole texts are used, however long.  Equal rows repeat each
    other.  Keys may be of any type and need not be distinct; extra columns are ignored; an empty table gives no rows.
    Partitions hold about ``partition_bytes`` of text, so their number grows with the table.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    slim = in_small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // partition_bytes(spark)))
    packed = slim.mapInArrow(_pack(parts, max(SMALL_CHUNK, size // parts // 2)), "part int, name bigint, body binary").rdd
    chunks = packed.map(lambda r: (r[0], (r[1], bytes(r[2])))).partitionBy(parts, _same)
    # a union of equally partitioned sets stays where it is: from here on only probes and answers move
    numbered = lambda rdd, f: rdd.mapPartitionsWithIndex(f)
    with_none = chunks.map(lambda r: (r[0], (r[1][0], r[1][1], None)), preservesPartitioning=True)
    hits = numbered(chunks, _probe(block, parts)).partitionBy(parts, _same).mapPartitions(_answer(True)).partitionBy(parts, _same)
    wide = numbered(with_none.union(hits), _extend(block, window, parts)).partitionBy(parts, _same)
    repeats = wide.mapPartitions(_answer(False)).partitionBy(parts, _same)
    settled = with_none.union(repeats).mapPartitions(lambda rows: ((bytearray(body), bytearray(told.tobytes())) for _, body, told in _told(rows)))
    kind = slim.schema["key"].dataType.simpleString()
    return spark.createDataFrame(settled, "body binary, told binary").mapInArrow(_finish(window), f"key {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("key", key)

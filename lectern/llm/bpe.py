"""Byte-level BPE by prefix-sharing traversal of a trie of words (operator 3), and lengths for operator 7.

The last token of the encoding of a prefix determines how the prefix ends; the rest is the encoding of a shorter
prefix.  Walking the distinct words depth first therefore needs one such state per trie node, and
words that share a prefix share its states.  Sorting the words visits the trie in depth-first order: the
states of the common prefix with the previous word are kept, those below are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_small_batches

#: Chunks of text remembered by a worker, and pairs of tokens; both are only caches.
CACHE_CHUNKS, CACHE_PAIRS = 150_000, 200_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _latin_pattern() -> str:
    """The byte-level split pattern for characters below U+0250, whose classes no Unicode version has changed since."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, white = of("L"), of("N"), r"\t-\r \x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+"


class TrieBpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], _byte_symbols()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer is needed")
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            left, right = to_bytes(a), to_bytes(b)
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.latin = re.compile("[\u0000-\u024f]*").fullmatch
        self.latin_split = re.compile(_latin_pattern()).findall
        self.white = [chr(c) for c in range(0x10000) if chr(c).isspace() or unicodedata.category(chr(c)) == "Zs"]
        self.at_spaces = re.compile(r"(?<=\S) (?=\S)").split
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        common = sorted(set.intersection(*map(set, self.special))) if self.special else []
        self.hint = common[0] if common else ""  # a text without it has no special token
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, token) in self.merges.items():
            if token not in self.halves or rank < self.halves[token][0]:
                self.halves[token] = (rank, a, b)
        self.sizes = {i: len(b) for i, b in self.pieces.items()}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._exact = None

    def merged(self, data: bytes) -> list[int]:
        """The encoding by repeated merging; used to tell which tokens merging can yield."""
        seq = [self.single[b] for b in data]
        while len(seq) > 1:
            best = min((self.merges[p] for p in zip(seq, seq[1:]) if p in self.merges), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(seq):
                if i + 1 < len(seq) and self.merges.get((seq[i], seq[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return seq

    def _first(self, token: int) -> bool:
        """Whether merging yields this token from its own bytes."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.pieces[token]) == [token]
        return known

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one end of ``token`` while it is being merged, each with the rank that ends it."""
        known = self.edges.get((token, right))
        if known is None:
            known, ends = [], float("inf")
            while token is not None:
                known.append((token, ends))
                rank, a, b = self.halves.get(token, (0, None, None))
                token, ends = (b if right else a), rank
            self.edges[known[0][0], right] = known
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side.

        It does unless two tokens that meet at the border at some time have a merge of their own that comes
        first; of equal ranks the one further left comes first.
        """
        merges = self.merges
        for x, x_ends in self._edge(left, True):
            for y, y_ends in self._edge(right, False):
                rank = merges.get((x, y))
                if rank is not None and rank[0] < x_ends and rank[0] <= y_ends:
                    return False
        return True

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The encodings of distinct words, found in one depth-first pass over their trie."""
        codes: dict[str, bytes] = {}
        ids, longest, pairs, size = self.ids.get, self.longest, self.pairs, self.sizes
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        before, last = b"", [-1]
        for data, word in sorted([(w.encode("utf-8", "surrogatepass"), w) for w in words]):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                # exactly one token can end here, so the order of trying is free; short ones are most often right
                for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                    token = ids(data[start:end])
                    if token is None:
                        continue
                    if not start:
                        if self._first(token):
                            break
                        continue
                    pair = last[start] << 32 | token
                    if (fits := pairs.get(pair)) is None:
                        fits = pairs[pair] = self._follows(last[start], token)
                    if fits:
                        break
                else:
                    raise ValueError("no token ends here")
                last.append(token)
            out, end = [], len(data)
            while end:
                out.append(last[end])
                end -= size[last[end]]
            codes[word] = array("I", reversed(out)).tobytes()
            before = data
        return codes

    def _split(self, text: str) -> list[str]:
        if self.latin(text):
            return self.latin_split(text)
        if self._exact is None:  # scripts whose character classes differ between Unicode versions: the library's own split
            from tokenizers import pre_tokenizers

            self._exact = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        return [text[a:b] for _, (a, b) in self._exact(text)]

    def _parts(self, text: str) -> list[str]:
        """Text and special tokens in turn; the special ones have odd places."""
        return self.parts(text) if self.parts and self.hint in text and any(s in text for s in self.special) else [text]

    def _chunks(self, part: str) -> list[str]:
        """Cut before every space with other than white space on both sides: no word of the pattern crosses it."""
        if any(c in part and (c + " " in part or " " + c in part) for c in (self.white if not part.isascii() else self.white[:10])) or part[:1] == " " or part[-1:] == " ":
            return self.at_spaces(part)
        return part.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Chunks repeat: those not remembered are split into words once a batch, and the distinct words encoded together.
        The first chunk of a part stands without its space and is not remembered.
        """
        heads, rest = set(), set()
        for text in texts:
            for part in self._parts(text)[::2]:
                chunks = self._chunks(part)
                heads.add(chunks[0])
                rest.update(chunks[1:])
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks, self.older = {}, self.chunks
        found, older = self.chunks, self.older
        new = rest - found.keys()
        if older:
            found.update((c, older[c]) for c in new & older.keys())
            new -= found.keys()
        first = {c: self._split(c) for c in heads}
        split = {c: self._split(" " + c) for c in new}
        code = self.encode_words({w for part in (first, split) for ws in part.values() for w in ws}).__getitem__
        whole = {c: b"".join(map(code, ws)) for c, ws in first.items()}
        found.update((c, code(ws[0]) if len(ws) == 1 else b"".join(map(code, ws))) for c, ws in split.items())
        get, out = found.__getitem__, []
        for text in texts:
            pieces = []
            for i, part in enumerate(self._parts(text)):
                if i % 2:
                    pieces.append(self.special[part].to_bytes(4, "little"))
                else:
                    chunks = self._chunks(part)
                    pieces.append(whole[chunks[0]])
                    pieces.extend(map(get, chunks[1:]))
            out.append(b"".join(pieces))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I") if len(ids) else ())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBpe:
    """The tokenizer of a file, kept by each worker."""
    return TrieBpe(path)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``size`` bytes of the last column, or of one longer row."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
        while at < batch.num_rows:
            end, total = at + 1, sizes[at]
            while end < batch.num_rows and end - at < rows and total + sizes[end] <= size:
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def _mapped(docs: DataFrame, text: str, keep: list[str], added: list[tuple[str, str, pa.DataType]], path: str | None, make: Callable) -> DataFrame:
    names = [c for c in keep if c not in {a for a, _, _ in added}]
    chosen = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("__text"))
    schema = type(chosen.schema)(chosen.schema.fields[:-1])
    for name, kind, _ in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))
        try:
            for batch in _slices(batches):
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                columns = make(bpe, texts)
                arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*names, *(a for a, _, _ in added)])
        finally:  # a worker that goes on to other work holds no words
            bpe.chunks, bpe.older, bpe.pairs = {}, {}, {}

    return in_small_batches(chosen).mapInArrow(run, schema)


def encode(docs: DataFrame, *, text: str = "text", keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` of every whole text.

    Null texts encode as empty ones: no ids.  Strings of special tokens inside a text become those tokens, as the
    library does.  Each row stands alone, however long its text, and repeated rows give repeated results; an empty table gives no rows.
    Columns in ``keep`` pass through, those named like an output column are replaced.
    """
    def make(bpe: TrieBpe, texts: list[str]):
        ids = bpe.encode_batch(texts)
        return ids, [len(x) // 4 for x in ids]

    return _mapped(docs, text, keep, [("ids", "binary", pa.binary()), ("n_tokens", "long", pa.int64())], path, make)


def decode(encoded: DataFrame, *, ids: str = "ids", keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with ``decoded``, the text of each row's ids; null ids give an empty text, an empty table no rows."""
    names = [c for c in keep if c != "decoded"]
    chosen = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(ids).alias("__ids"))
    schema = type(chosen.schema)(chosen.schema.fields[:-1]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            texts = [bpe.decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "decoded"])

    return in_small_batches(chosen).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, *, text: str = "text", keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with ``ids``, ``n_tokens`` and ``exact``: whether decoding the ids gives the text back; encodes and decodes in one worker.

    Nulls, empty and long texts, repeated rows, empty tables and clashing names are treated as by ``encode``.
    """
    def make(bpe: TrieBpe, texts: list[str]):
        ids = bpe.encode_batch(texts)
        return ids, [len(x) // 4 for x in ids], [bpe.decode(x) == t for x, t in zip(ids, texts)]

    return _mapped(docs, text, keep, [("ids", "binary", pa.binary()), ("n_tokens", "long", pa.int64()), ("exact", "boolean", pa.bool_())], path, make)


def encode_digest(docs: DataFrame, *, text: str = "text", keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encodes and decodes without moving the ids.

    Nulls, empty and long texts, repeated rows, empty tables and clashing names are treated as by ``encode``.
    """
    def make(bpe: TrieBpe, texts: list[str]):
        ids = bpe.encode_batch(texts)
        return (
            [len(x) // 4 for x in ids],
            [hashlib.sha256(x).hexdigest() for x in ids],
            [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        )

    added = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, text, keep, added, path, make)


def lengths(docs: DataFrame, *, text: str = "text", keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` with ``n_tokens``, the encoded length of every whole text (null: 0)."""
    return _mapped(docs, text, keep, [("n_tokens", "long", pa.int64())], path, lambda bpe, texts: ([len(x) // 4 for x in bpe.encode_batch(texts)],))

"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

A rank file's merges decide which token may follow which: two tokens are neighbours in an
encoding exactly if the merges leave their joined bytes as these two. The last token of the
encoding of any prefix is therefore the longest one that ends there and fits behind the
last token of what precedes it. A state of the transducer holds the bytes whose token is
still open, with the last token at each place where a longer token may yet begin; no such
place lies further back than the longest token, which bounds the lookahead. States and
their transitions are made when first met. Where the open places agree on their first
token, the transition emits it.
"""

from __future__ import annotations

import base64
import codecs
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.llm.common import no_clash, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
_CACHE = 500_000
_STATES = 240_000
_NEVER = 1 << 60
_END = -2
_ESCAPED = re.compile("[\udc80-\udcff]")
_NO_TOKEN, _NO_CONTEXT = (1 << 32) - 1, (1 << 32) - 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Of one vocabulary. encode(piece) gives the ids of one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int], states: int | None = None) -> None:
        self.ranks = ranks
        self.most = states or _STATES
        self.longest = max(map(len, ranks), default=1)
        if self.longest > 255:
            raise ValueError("tokens of more than 255 bytes")
        self.tokens = {rank: t for t, rank in ranks.items()}
        self.heads = {t[:n] for t in ranks for n in range(1, len(t))}  # proper beginnings
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]] | None] = {}
        move, rest = self.move, self.rest

        class Node(dict):
            """Transitions by byte, made when first asked for."""

            __slots__ = ()

            def __missing__(node, byte):  # noqa: N805
                return rest(node) if byte == _END else move(node, byte)

        self.new_node = Node
        self.reset()

    def reset(self) -> None:
        self.nodes: dict[bytes, dict] = {}
        self.start = self.node(b"", [b""])

    def node(self, data: bytes, last: list[bytes | None]) -> dict:
        """A state's transitions by byte; its own description stands under -1: the token
        before the open bytes, the length of the token that ends at each place, the bytes."""
        left = _NO_TOKEN if last[0] is None else _NO_CONTEXT if not last[0] else self.ranks[last[0]]
        state = left.to_bytes(4) + bytes([len(t) if t else 0 for t in last[1:]]) + data
        if state not in self.nodes:
            node = self.nodes[state] = self.new_node()
            node[-1] = state
        return self.nodes[state]

    def described(self, node: dict) -> tuple[bytes, list[bytes | None]]:
        state = node[-1]
        n = (len(state) - 4) // 2
        left, data = int.from_bytes(state[:4]), state[4 + n :]
        first = None if left == _NO_TOKEN else b"" if left == _NO_CONTEXT else self.tokens[left]
        return data, [first, *[data[i - size : i] if size else None for i, size in enumerate(state[4 : 4 + n], 1)]]

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """The merges of rank under below in order of rank, leftmost first: the definition,
        used on single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def grown(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at a token's left (0) or right (-1) edge while merges build it, each
        with the rank of the merge that takes it up; None if the merges never build it."""
        if (token, side) not in self.edges:
            out, part, rank = [(token, _NEVER)], token, self.ranks[token]
            while len(part) > 1:
                halves = self.merged(part, rank)
                if len(halves) != 2:
                    out = None
                    break
                part = halves[side]
                out.append((part, rank))
                rank = self.ranks.get(part, _NEVER)
            self.edges[token, side] = out and out[::-1]
        return self.edges[token, side]

    def joined(self, left: bytes, right: bytes) -> bool:
        """Whether a merge joins what stands on the two sides of the border at some time. Of
        merges of equal rank the leftmost comes first."""
        a, b = self.grown(left, -1), self.grown(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.ranks.get(x + y, _NEVER)
            if rank < x_until and rank <= y_until and rank < _NEVER:
                return True
            if x_until == y_until == _NEVER:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def follows(self, left: bytes, right: bytes) -> bool:
        if self.grown(right, 0) is None:
            return False
        if not left:
            return True
        return not self.joined(left, right)

    def move(self, node: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """A place of a state has the last token before it, or None if none may begin there."""
        data, last = self.described(node)
        data += bytes((byte,))
        n = len(data)
        for i in range(n):
            if last[i] is not None and data[i:] in self.ranks and self.follows(last[i], data[i:]):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last.append(data[i:])
        # a place stays open if a token may begin there and reach beyond the end
        begins = [i for i in range(n) if last[i] is not None and data[i:] in self.heads]
        begins.append(n)
        # the places that the open ones come from, back to the last that all share
        open_, needed = set(begins), set(begins)
        while len(open_) > 1:
            i = max(open_)
            open_.remove(i)
            i -= len(last[i])
            open_.add(i)
            needed.add(i)
        (cut,) = open_
        ids, i = [], cut
        while i:
            ids.append(self.ranks[last[i]])
            i -= len(last[i])
        kept = [last[i] if i in needed else None for i in range(cut, n + 1)]
        if cut not in begins:
            kept[0] = None
        result = node[byte] = self.node(data[cut:], kept), tuple(ids[::-1])
        return result

    def rest(self, node: dict) -> tuple[int, ...]:
        """The ids that a state still owes where the piece ends."""
        data, last = self.described(node)
        ids, i = [], len(data)
        while i:
            ids.append(self.ranks[last[i]])
            i -= len(last[i])
        node[_END] = tuple(ids[::-1])
        return node[_END]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.nodes) > self.most:
            self.reset()
        node, out = self.start, []
        for byte in piece:
            node, ids = node[byte]
            if ids:
                out += ids
        out += node[_END]
        return out


class Recent(dict):
    """What make gave lately. Once it holds half of a number of keys it begins anew, and
    what is asked for again comes over from what it held before: frequent keys stay."""

    __slots__ = ("make", "half", "before")

    def __init__(self, make, most: int) -> None:
        self.make, self.half, self.before = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(key) < 40:
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[key] = got
        return got


class Tokenizer:
    """Texts to ids. Most runs of text between single spaces repeat: their ids are kept, as
    packed numbers, in a table of bounded size. A run may be taken by itself only if no
    white space stands beside the space before it; other texts are matched whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int | None = None, states: int | None = None) -> None:
        words = words or _CACHE
        self.transducer = Transducer(ranks, states)
        self.pattern = regex.compile(pattern)
        self.together = regex.compile(r"^ | $|[\s\x00-\x1f\x7f-\xa0] | [\s\x00-\x1f\x7f-\xa0]")
        self.plain = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")  # one match of any usual pattern
        self.pieces = Recent(self.piece, words // 3)
        self.runs = Recent(self.run, words)
        self.one_match = [len(self.pattern.findall(x)) for x in (" aZ\xc0\xff", " \xd6\xd8\xf6\xf8m")] == [1, 1]

    def piece(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def matched(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def run(self, run: str) -> bytes:
        if self.one_match and self.plain.fullmatch(run):
            return array("i", self.transducer.encode(b" " + run.encode())).tobytes()
        return self.matched(" " + run)

    def packed(self, text: str) -> bytes:
        if not text or self.together.search(text):
            return self.matched(text)
        first, *rest = text.split(" ")
        return self.matched(first) + b"".join(map(self.runs.__getitem__, rest))


class Utf8Stream:
    """Bytes in pieces of any length to text: an incremental UTF-8 state machine holds the
    bytes of a code point that has not ended. Malformed bytes become U+FFFD, or with the
    errors surrogateescape lone surrogates that encode to the same bytes again."""

    def __init__(self, errors: str = "replace") -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


def decode_stream(ids: list[int], tokens: list[bytes], step: int = 4096, errors: str = "replace") -> Iterator[str]:
    """The text of ids as it becomes known."""
    stream = Utf8Stream(errors)
    for at in range(0, len(ids), step):
        yield stream.feed(b"".join([tokens[i] for i in ids[at : at + step]]))
    yield stream.close()


def _vocabulary(spark: SparkSession, path: str) -> str:
    """Ship the rank file to the executors; gives the name that they find it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


_LOADED: dict[tuple, object] = {}


def _once(kind: str, name: str, make):
    if (kind, name) not in _LOADED:
        _LOADED[kind, name] = make(read_ranks(SparkFiles.get(name)))
    return _LOADED[kind, name]


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    return [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]


def _ids(tokenizer: Tokenizer, texts: pa.Array) -> pa.Array:
    packed = [tokenizer.packed(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(tokens: list[bytes], ids: pa.Array) -> list[pa.Array]:
    """The bytes of each row's ids, and whether they are whole UTF-8: a decoded stream's
    text as bytes again."""
    data, valid = [], []
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    for at, end in zip(ends, ends[1:]):
        text = "".join(decode_stream(values[at:end].tolist(), tokens, errors="surrogateescape"))
        data.append(text.encode("utf-8", "surrogateescape"))
        valid.append(text.isascii() or not _ESCAPED.search(text))
    return [pa.array(data, pa.binary()), pa.array(valid, pa.bool_())]


def _with_parts(docs: DataFrame, parts: Column) -> DataFrame:
    """Adds the fields of a struct, under a name in between that no column has."""
    name = "_" + "_".join(docs.columns)
    return docs.select("*", parts.alias(name)).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{name}`.*"))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Adds ids array<int> for the column text: each match of pattern by itself, without
    special tokens. Null and empty texts have no ids. Repeated rows stay; an input column
    ids is replaced; other columns pass unread."""
    name = _vocabulary(docs.sparkSession, vocabulary)
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(parts: pa.Array) -> pa.Array:
        return _ids(_once("encode", name, lambda ranks: Tokenizer(ranks, pattern)), parts)

    return no_clash(docs, "ids").withColumn("ids", ids(F.col("text").cast("string")))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded (the bytes of ids) and valid_utf8. Null ids count as none."""
    name = _vocabulary(encoded.sparkSession, vocabulary)

    @F.arrow_udf("struct<decoded: binary, valid_utf8: boolean>")
    def texts(parts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_decoded(_once("decode", name, _by_id), parts), names=["decoded", "valid_utf8"])

    return _with_parts(no_clash(encoded, "decoded", "valid_utf8"), texts("ids"))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task, and ids cross to Python never:
    adds ids, decoded and valid_utf8."""
    name = _vocabulary(docs.sparkSession, vocabulary)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary, valid_utf8: boolean>")
    def both(parts: pa.Array) -> pa.Array:
        ids = _ids(_once("encode", name, lambda ranks: Tokenizer(ranks, pattern)), parts)
        return pa.StructArray.from_arrays([ids, *_decoded(_once("decode", name, _by_id), ids)], names=["ids", "decoded", "valid_utf8"])

    return _with_parts(no_clash(docs, "ids", "decoded", "valid_utf8"), both(F.col("text").cast("string")))


def encode_checked(docs: DataFrame, vocabulary: str, pattern: str, words: int = 100_000, states: int = 100_000) -> DataFrame:
    """Adds ids, and round_trip: whether they decode to the text's bytes. As round_trip(),
    but for jobs whose other steps hold memory: decoded bytes stay in the worker, which
    keeps fewer words and states (that changes no ids) and none beyond a task."""
    name = _vocabulary(docs.sparkSession, vocabulary)
    small_batches(docs.sparkSession)
    docs = no_clash(docs, "ids", "round_trip").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(SparkFiles.get(name))
        tokenizer, tokens = Tokenizer(ranks, pattern, words, states), _by_id(ranks)
        for b in batches:
            texts = b.column("text")
            ids = _ids(tokenizer, texts)
            same = [d.as_py() == (t.as_py() or "").encode("utf-8", "surrogatepass") for d, t in zip(_decoded(tokens, ids)[0], texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(same, pa.bool_())], names=[*b.schema.names, "ids", "round_trip"])
        del tokenizer
        gc.collect()  # states refer to each other

    return docs.mapInArrow(both, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}

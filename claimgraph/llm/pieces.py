"""SentencePiece encoding with merge-type vocabularies, and decoding.

A text becomes symbols of one character. An agenda holds the adjacent pairs of symbols that make a
piece: the pair of the highest score merges next, the leftmost first where scores are equal, and
its new neighbours join the agenda. What no piece spells becomes byte pieces.

No merge crosses two neighbours that stand together in no piece, as a letter and the space behind
it: words, marks between them and line breaks merge by themselves where no piece joins them, and
frequent ones are kept. In each Arrow batch the sentencepiece library encodes all segments that
were merged in it, and a difference ends the job."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.bpe import _vocabulary, _with_parts
from claimgraph.llm.common import no_clash, small_batches, table

MODEL = "piece_bpe_32k.model"
_CACHE = 800_000
_SHORT, _ROWS, _CHECKED = 48, 4096, 32
_LAST = np.iinfo(np.int32).max
SPACE = "▁"
# Numbers of the model file's fields, kinds of pieces, the kind of a merge-type model.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_MODEL_TYPE, _SUFFIX, _BYTES, _UNKNOWN_TEXT, _EOS = 3, 24, 35, 44, 47
_CHARSMAP, _DUMMY, _SQUEEZE, _ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> list[tuple[int, object]]:
    """(number, value) of a protocol buffer message; texts and messages stay bytes."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


def _per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("claimgraph-each-byte", _per_byte)


class Vocabulary:
    """A merge-type model whose texts are taken as they are."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = _fields(f.read())
        part = {n: dict(_fields(v)) for n, v in message if n != _PIECES}
        trainer, normalizer = part.get(_TRAINER, {}), part.get(_NORMALIZER, {})
        pieces = [dict(_fields(v)) for n, v in message if n == _PIECES]
        kinds = [p.get(_KIND, NORMAL) for p in pieces]
        if trainer.get(_MODEL_TYPE, 1) != MERGES:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(_CHARSMAP) or normalizer.get(_SQUEEZE, 1) or not normalizer.get(_ESCAPE, 1) or trainer.get(_SUFFIX, 0) or {DEFINED, UNUSED} & set(kinds):
            raise ValueError("a vocabulary that changes characters, drops spaces, or has user-defined or unused pieces")
        self.dummy = bool(normalizer.get(_DUMMY, 1))
        self.texts = [p[_TEXT].decode() for p in pieces]
        self.kinds = kinds
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == NORMAL}
        self.rank = {t: -float(np.frombuffer(pieces[i].get(_SCORE, b"\0\0\0\0"), "<f4")[0]) for t, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes_ = [self.texts.index(f"<0x{b:02X}>") for b in range(256)] if trainer.get(_BYTES) else None
        end = trainer.get(_EOS, b"</s>").decode()
        self.end = next(i for i, (t, k) in enumerate(zip(self.texts, kinds)) if t == end and k == CONTROL)
        self.controls = {i for i, k in enumerate(kinds) if k == CONTROL}
        surface = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), UNKNOWN: lambda t: trainer.get(_UNKNOWN_TEXT, b" \xe2\x81\x87 "), CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:5], 16)])}
        self.surface = [surface[k](t) for t, k in zip(self.texts, kinds)]


class Encoder:
    """Batches of texts to ids. The segments of a batch that are not kept are merged together, in
    matrices with a row a segment: a row's agenda are the ranks of its adjacent pairs in order of
    place, and each round merges the best, leftmost pair of every row. Long segments and those
    with characters outside of all pieces take an agenda of their own, a heap."""

    def __init__(self, vocabulary: Vocabulary, kept: int = _CACHE) -> None:
        self.v, self.half = vocabulary, max(1, kept // 2)
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        pairs = {t[i : i + 2] for t in vocabulary.ids for i in range(len(t) - 1)}
        apart = not any(p[1] == SPACE != p[0] for p in pairs)
        self.border = next(c for c in map(chr, [10, *range(1, 65536)]) if not any(c in p for p in pairs))
        cut = re.escape(self.border)
        # segments as texts spell them, with spaces; else the text is one segment
        marks = {c for c in map(chr, range(33, 256)) if not re.match(r"[^\W\d_]", c)} - {self.border}
        while mixed := {c for p in pairs if (p[0] in marks) != (p[1] in marks) and p[0] != SPACE for c in p} & marks:
            marks -= mixed
        m = re.escape("".join(sorted(marks)))
        parts = f" *[^ {cut}{m}]+| *[{m}]+" if marks else f" *[^ {cut}]+"
        self.segments = re.compile(f"{cut}|{parts}| +" if apart else "(?s).+")
        self._pairs()

    def _pairs(self) -> None:
        """Sorted pairs of symbols that make a piece, with its rank and symbol. Symbols are
        pieces, and single characters that only stand within pieces."""
        symbols = dict(self.v.ids)
        for t in self.v.ids:
            for c in t:
                symbols.setdefault(c, len(self.v.texts) + len(symbols))
        self.of_character = np.full(0x110000, -1, np.int64)
        for t, i in symbols.items():
            if len(t) == 1:
                self.of_character[ord(t)] = i
        self.of_character[ord(" ")] = self.of_character[ord(SPACE)]
        made = [(symbols[t[:k]] << 32 | symbols[t[k:]], self.v.rank[t], i) for t, i in self.v.ids.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols]
        made.sort()
        self.key, self.joined = np.array([m[0] for m in made] or [-1]), np.array([m[2] for m in made] or [0])
        self.order = np.unique(np.array([m[1] for m in made] or [0.0]), return_inverse=True)[1].astype(np.int32)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and symbols of pairs; pairs that make no piece rank last."""
        key = left << 32 | (right & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.order[at], _LAST), self.joined[at]

    def by_rows(self, segments: list[str]) -> list[bytes]:
        """The ids of segments of about equal length whose characters are all symbols."""
        n, width = len(segments), max(map(len, segments))
        codes = np.frombuffer("".join([s.ljust(width, "\0") for s in segments]).encode("utf-32-le"), np.uint32).reshape(n, width)
        inside = np.arange(width) < np.array([len(s) for s in segments])[:, None]
        # column width stands for no neighbour
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width] = np.where(inside, self.of_character[codes], -1)
        rank, joined = np.full((n, width + 1), _LAST, np.int32), np.zeros((n, width + 1), np.int32)
        rank[:, : width - 1], joined[:, : width - 1] = self._looked_up(symbol[:, : width - 1], symbol[:, 1:width])
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width, dtype=np.int32), n)
        before[:: width + 1] = width
        row, flat, ranks, made = np.arange(n), symbol.ravel(), rank.ravel(), joined.ravel()
        while len(row):
            left = rank[row].argmin(axis=1)
            base = row * (width + 1)
            at = base + left
            open_ = ranks[at] < _LAST
            row, left, base, at = row[open_], left[open_], base[open_], at[open_]
            right = base + after[at]
            beyond = after[right]
            new = made[at].astype(np.int64)
            flat[at] = new
            flat[right] = -1
            ranks[right] = _LAST
            after[at] = beyond
            before[base + beyond] = left
            ranks[at], made[at] = self._looked_up(new, flat[base + beyond])
            ahead = base + before[at]
            ranks[ahead], made[ahead] = self._looked_up(flat[ahead], new)
        left_over = symbol >= 0
        data = symbol[left_over].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(left_over.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def by_heap(self, segment: str) -> bytes:
        """The ids of any segment, in n log n."""
        rank, part = self.v.rank, list(segment.replace(" ", SPACE))
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[p], i, i + 1, 2) for i in range(n - 1) if (p := part[i] + part[i + 1]) in rank]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has merged since
            part[i], part[j] = part[i] + part[j], ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (p := part[left] + part[right]) in rank:
                    heappush(agenda, (rank[p], left, right, len(p)))
        out: list[int] = []
        for symbol in filter(None, part):
            if symbol in self.v.ids:
                out.append(self.v.ids[symbol])
            elif self.v.bytes_:
                out += [self.v.bytes_[b] for b in symbol.encode()]
            else:
                out.append(self.v.unknown)
        return array("i", out).tobytes()

    def merged(self, segments: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        short = sorted((s for s in segments if len(s) < _SHORT), key=len)
        codes = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
        symbol = self.of_character[codes]
        known = np.zeros(len(codes) + 1, np.int64)
        np.cumsum((symbol < 0) | (symbol >= len(self.v.texts)), out=known[1:])
        ends = np.cumsum([0, *map(len, short)])
        plain = [s for s, odd in zip(short, known[ends[1:]] - known[ends[:-1]]) if not odd]
        for at in range(0, len(plain), _ROWS):
            part = plain[at : at + _ROWS]
            out.update(zip(part, self.by_rows(part)))
        return [out[s] if s in out else self.by_heap(s) for s in segments]

    def checked(self, segments: list[str], packed: list[bytes], library) -> None:
        """Hold ids against the library's, many segments in a text: those with a space first
        lie one behind another, others behind a character that keeps apart."""
        dummy, between = self.v.dummy, self.by_heap(self.border)
        spaced, bare, theirs, ours = [], [], [], []
        for s, p in zip(segments, packed):
            if s[0] != " ":
                bare.append((self.border + s, between + p))
            elif s.strip(" "):
                spaced.append((s, p))
            elif len(s) > 1 or not dummy:  # the library reads no text but its own, not a space
                theirs.append(s[1:] if dummy else s)
                ours.append(p)
        first = array("i", library.encode(self.border)).tobytes()[: -len(between)]
        for some, drop, head in ((spaced, int(dummy), b""), (bare, 0, first)):
            for at in range(0, len(some), _CHECKED):
                texts, ids = zip(*some[at : at + _CHECKED])
                theirs.append("".join(texts)[drop:])
                ours.append(head + b"".join(ids))
        for text, ids, mine in zip(theirs, library.encode(theirs, num_threads=1), ours):
            if array("i", ids).tobytes() != mine:
                raise ValueError(f"the library encodes {text[:80]!r} otherwise")

    def encoded(self, texts: list[str | None], end: bool = True, library=None) -> list[bytes]:
        """The packed ids of texts. A batch's own segments stay until the next; of older ones
        those that were asked for lately."""
        if len(self.now) > self.half:
            self.before, self.now = {s: p for s, p in self.now.items() if len(s) < 40}, {}
        first = " " if self.v.dummy else ""
        parts = [self.segments.findall(first + t.replace(SPACE, " ")) if t else [] for t in texts]
        now, before = self.now, self.before
        fresh = []
        for s in set(chain.from_iterable(parts)).difference(now):
            if s in before:
                now[s] = before[s]
            else:
                fresh.append(s)
        if fresh:
            packed = self.merged(fresh)
            if library is not None:
                self.checked(fresh, packed, library)
            now.update(zip(fresh, packed))
        last = array("i", [self.v.end]).tobytes() if end else b""
        out = [b"".join(map(now.__getitem__, part)) for part in parts]
        if not self.v.bytes_:
            out = [self._once_unknown(p) for p in out]
        return [p + last for p in out]

    def _once_unknown(self, packed: bytes) -> bytes:
        """Unknown neighbours are one."""
        ids = np.frombuffer(packed, np.int32)
        again = (ids[1:] == self.v.unknown) & (ids[:-1] == self.v.unknown)
        return ids[np.append(np.ones(min(1, len(ids)), bool), ~again)].tobytes()


def surface(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and byte pieces as bytes, without the space that encoding put first. Each byte that is no UTF-8 becomes U+FFFD."""
    whole = data = b"".join(map(v.surface.__getitem__, ids))
    if v.dummy and data[:1] == b" ":
        first = next(i for i in ids if v.kinds[i] != CONTROL)
        if v.texts[first].startswith(SPACE):
            data = data[1:]
    if v.controls.isdisjoint(ids[:-1]):
        return data.decode("utf-8", "claimgraph-each-byte")
    # bytes on two sides of a control piece make no character together
    out = []
    for control, part in groupby(ids, lambda i: v.kinds[i] == CONTROL):
        if not control:
            part = b"".join(map(v.surface.__getitem__, part))
            part = part if out or len(data) == len(whole) else part[1:]
            out.append(part.decode("utf-8", "claimgraph-each-byte"))
    return "".join(out)


_LOADED: dict[tuple[str, str], tuple] = {}


def _loaded(name: str) -> tuple[Vocabulary, Encoder, object]:
    if name not in _LOADED:
        import sentencepiece

        path = SparkFiles.get(name)
        v = Vocabulary(path)
        _LOADED[name] = v, Encoder(v), sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[name]


def _ids(name: str, texts: pa.Array, end: bool) -> pa.Array:
    _, encoder, library = _loaded(name)
    packed = encoder.encoded(texts.to_pylist(), end, library)
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _texts(name: str, ids: pa.Array) -> pa.Array:
    v = _loaded(name)[0]
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([surface(v, values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """Adds ids array<int> for the column text: with an end id if wanted, and no other special one. Null and empty texts have no other ids. Repeated rows stay, an input column ids is
    replaced, other columns pass unread."""
    name = _vocabulary(docs.sparkSession, model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _ids(name, texts, end)

    return no_clash(docs, "ids").withColumn("ids", ids(F.col("text").cast("string")))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds decoded, the text of ids. Null ids count as none."""
    name = _vocabulary(encoded.sparkSession, model)

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        return _texts(name, ids)

    none = F.array().cast("array<int>")
    return no_clash(encoded, "decoded").withColumn("decoded", texts(F.coalesce("ids", none)))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task: adds ids and decoded."""
    name = _vocabulary(docs.sparkSession, model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _ids(name, texts, True)
        return pa.StructArray.from_arrays([ids, _texts(name, ids)], names=["ids", "decoded"])

    return _with_parts(no_clash(docs, "ids", "decoded"), both(F.col("text").cast("string")))


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_model())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable] = {"op11_pieces": op11_pieces}
ORACLE_SQL: dict[str, str] = {}

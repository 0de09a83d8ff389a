"""Encoding of texts with a public byte-level BPE vocabulary, by tree concatenation."""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that splits a text into pieces before byte-pair merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a segment, the unit that is encoded on its own; a text of n characters has about n / SEGMENT of them.
SEGMENT = 512
#: Characters of the texts that are held at once with their ids.
_HELD = 4 << 20

_MAX_VOCABULARY_BYTES = 16 << 20
_encodings: dict[bytes, object] = {}


def encoding(vocabulary: bytes):
    """The encoder of a vocabulary file's bytes; one per worker process."""
    import hashlib

    import tiktoken

    key = hashlib.sha256(vocabulary).digest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


_SPACES = " \t\n\r"


def _kind(c: str) -> str:
    if c.isalpha():
        return "L"
    if unicodedata.category(c)[0] == "N":
        return "N"
    if c in _SPACES:
        return "S"
    return "?" if c.isspace() else "P"


def join_kind(text: str, at: int) -> str:
    """How the parts of ``text`` before and after ``at`` are joined.

    ``safe``: every piece ends there, whatever stands around it. ``raw``: the place is inside a run that
    is one piece, and both parts split alike on their own. '': neither is certain.
    """
    a, b = text[at - 1], text[at]
    left, right = _kind(a), _kind(b)
    if "?" in (left, right):
        return ""
    if left != right:
        if left == "S" or (left == "P" and right == "L" and a in "'’"):
            return ""
        return "safe"
    if left == "S":
        return "raw" if at + 1 < len(text) and _kind(text[at + 1]) == "S" else ""
    if left == "P":
        return "" if b == "'" else "raw"
    if left == "L":  # three letters after an apostrophe, no contraction reaches here
        return "raw" if at >= 3 and _kind(text[at - 2]) == _kind(text[at - 3]) == "L" else ""
    return "raw"


def segments(text: str, size: int = SEGMENT) -> list[tuple[str, str]]:
    """(join, part) of a text cut into parts of about ``size`` characters; join tells how a part goes on from the one before.

    A cut is made at the first place after each multiple of ``size`` where the join is known: at the end of a piece, or
    inside a run, as most are.
    """
    out, start, join = [], 0, "safe"
    while len(text) - start > size + size // 2:
        at = start + size
        while at < len(text) and not join_kind(text, at):
            at += 1
        if at == len(text):
            break
        out.append((join, text[start:at]))
        start, join = at, join_kind(text, at)
    out.append((join, text[start:]))
    return out


class Node:
    """Ids of a part of a text; the numbers of ids of its first and last piece; is it a single piece?"""

    __slots__ = ("ids", "head", "tail", "single")

    def __init__(self, ids, head: int, tail: int, single: bool):
        self.ids, self.head, self.tail, self.single = array("i", ids), head, tail, single


def leaf(enc, part: str, ids: list[int], inside_left: bool = True, inside_right: bool = True) -> Node:
    """The node of an encoded part; its first and last piece are measured only where it is joined inside a run."""
    import regex

    if not (inside_left or inside_right) or not part:
        return Node(ids, 0, 0, False)
    count = lambda piece: len(enc._encode_single_piece(piece))
    head = regex.match(PATTERN, part).group()
    if len(head) == len(part):
        return Node(ids, len(ids), len(ids), True)
    at = len(part) - 1
    while at and join_kind(part, at) != "safe":
        at -= 1
    tail = regex.findall(PATTERN, part[at:])[-1]
    return Node(ids, count(head) if inside_left else 0, count(tail) if inside_right else 0, False)


def _concatenate(enc, left: array, right: array) -> array:
    """Ids of one piece from the ids of its two halves.

    Windows around the join are encoded again, of 1, 2, 4, ... ids on each side, until the new ids
    begin and end with those of the window. All neighbours are then pairs that some valid encoding
    has, and a sequence of such pairs is the only valid one for its bytes.
    """
    w = 1
    while True:
        a, b = left[-w:], right[:w]
        middle = enc._encode_single_piece(enc.decode_bytes([*a, *b]))
        if (w >= len(left) or middle[0] == a[0]) and (w >= len(right) or middle[-1] == b[-1]):
            return left[: len(left) - len(a)] + array("i", middle) + right[len(b) :]
        w *= 2


def concatenate(enc, a: Node, join: str, b: Node) -> Node:
    """The node of two neighbouring parts."""
    if join != "raw":
        return Node(a.ids + b.ids, a.head, b.tail, False)
    piece = _concatenate(enc, a.ids[len(a.ids) - a.tail :], b.ids[: b.head])
    ids = a.ids[: len(a.ids) - a.tail] + piece + b.ids[b.head :]
    return Node(ids, len(piece) if a.single else a.head, len(piece) if b.single else b.tail, a.single and b.single)


def tree(enc, nodes: list[tuple[str, Node]]) -> array:
    """Ids of a text from the nodes of its parts, joined two by two; the join is how a part goes on from the one before."""
    while len(nodes) > 1:
        pairs = [(nodes[k][0], concatenate(enc, nodes[k][1], nodes[k + 1][0], nodes[k + 1][1])) for k in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[2 * len(pairs) :]
    return nodes[0][1].ids


def encode_texts(enc, texts: list[str | None], size: int = SEGMENT, threads: int = 1) -> list[array]:
    """Ids of each text: its segments are encoded side by side, then joined in a tree; [] for NULL and ''."""
    cut = [segments(t, size) if t else [] for t in texts]
    coded = iter(enc.encode_ordinary_batch([part for parts in cut for _, part in parts], num_threads=threads))
    out = []
    for parts in cut:
        nodes = []
        for k, (join, part) in enumerate(parts):
            goes_on = k + 1 < len(parts) and parts[k + 1][0] == "raw"
            nodes.append((join, leaf(enc, part, next(coded), join == "raw", goes_on)))
        out.append(tree(enc, nodes) if nodes else array("i"))
    return out


def encode_text(enc, text: str | None, size: int = SEGMENT) -> list[int]:
    """Ids of one text; [] for NULL and ''."""
    return encode_texts(enc, [text], size)[0].tolist()


def encode(
    df: DataFrame, *, text: str = "text", row_id: str = "doc_id", vocabulary: str = VOCABULARY, segment: int = SEGMENT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(row_id, the columns of ``keep``, ids): each text as ids of the vocabulary, without special tokens; [] for NULL and ''.

    The strings of special tokens are ordinary text. Each row comes out once, repeated rows too. Every text is
    cut into segments, at a place where a piece of the vocabulary's pattern ends, or inside a run that has none. The
    segments are encoded on their own, by as many threads as a task has processors (``spark.task.cpus``), and
    joined in a tree; a join inside a run encodes growing windows again, until both sides agree. The result is that
    of the whole text. The table is scanned once and there is no exchange. A long run costs no more a character than a
    short one, since no piece longer than a segment is merged at once. The vocabulary file is read on the driver
    and broadcast; its size is checked.
    """
    data = Path(vocabulary).read_bytes()
    if len(data) > _MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(data)
    threads = int(spark.conf.get("spark.task.cpus", "1"))
    names = [row_id, *keep, "ids"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names[:-1]) + ", ids array<int>"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held >= _HELD or k + 1 == len(texts):
                    ids = encode_texts(enc, texts[begin : k + 1], segment, threads)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    values = np.frombuffer(b"".join(ids), dtype=np.int32)
                    part = b.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], names=names)
                    begin, held = k + 1, 0

    return df.select(row_id, *keep, F.col(text).alias("_text")).mapInArrow(coded, schema)

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Ranks come from a file of base64 tokens and their ranks.  The library works on characters, so bytes are mapped to printable
characters one to one; merges follow from the ranks (each token is the pair that the lower ranks leave of it).  Each match of
the pre-token pattern is encoded by itself and no special tokens exist.  Decoding goes from ids to bytes by table, so a
character whose bytes are split over tokens comes back whole.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLAB = 1 << 20  # characters of text given to the library at once
CACHE = 1 << 17  # pre-tokens remembered by a worker; when there are more, it starts afresh


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each longer token, in rank order: what the lower ranks leave when they are merged first."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@functools.lru_cache(4)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file; built once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    name = lambda token: "".join([chars[b] for b in token])
    model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)])
    made = Tokenizer(model)
    steps = [pre_tokenizers.Split(Regex(pattern), "isolated")] if pattern else []
    made.pre_tokenizer = pre_tokenizers.Sequence([*steps, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class Pieces:
    """Ids of texts without offsets: texts are split by the pattern, and each distinct pre-token is encoded once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.made, self.known = tokenizer(path, ""), {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        found = [self.split(t) for t in texts]
        coded = pa.array(chain.from_iterable(found), pa.string(), size=sum(map(len, found))).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known = {}
        new = [piece for piece in distinct if piece not in self.known]
        self.known.update(zip(new, (array("i", x.ids).tobytes() for x in self.made.encode_batch_fast(new, add_special_tokens=False))))
        own = [self.known[piece] for piece in distinct]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, first, which = np.frombuffer(b"".join(own), np.int32), np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        at = np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], size[which])
        cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return flat[at], np.diff(ends[cuts])


@functools.lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after another in rank order, and where each begins."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def _slabs(texts: list[str]) -> Iterator[list[str]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLAB:
            yield texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", *, offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array<int>) and, if asked, ``offsets``: each token's (first, last) character, end exclusive.

    A token that holds part of a character has the offsets of that whole character.  Null and empty texts have no tokens; texts
    are never cut.  A special token's name in a text is ordinary text.  Input columns of the results' names are replaced, others
    pass unchanged, repeated rows stay, and an empty table gives an empty result.
    """
    df = df.drop("ids", "offsets")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("offsets", span)] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pieces = tokenizer(path, pattern) if offsets else None, Pieces(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("").to_pylist()
            ids, ends, spans = [], [np.zeros(1, np.int64)], []
            for part in _slabs(texts):
                if offsets:
                    found = made.encode_batch(part, add_special_tokens=False)
                    lists = [np.array(x.ids, np.int32) for x in found]
                    own, sizes = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
                    spans += [np.array(x.offsets, np.int32).reshape(-1, 2) for x in found]
                else:
                    own, sizes = pieces.ids(part)
                ids.append(own)
                ends.append(sizes)
            cuts = pa.array(np.cumsum(np.concatenate(ends)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))]
            if offsets:
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
                columns.append(pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "stop"])))
            out = pa.Table.from_batches([batch])
            for field, column in zip(new, columns):
                out = out.append_column(field.name, column)
            yield from out.to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes (binary) behind the ids; a null list decodes to no bytes, an unknown id fails."""
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = token_bytes(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = ids[a:b]
                size = starts[own + 1] - starts[own]
                ends = np.cumsum(size)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[own] - (ends - size), size)
                out.append(data[at].tobytes())
            yield from pa.Table.from_batches([batch]).append_column("decoded", pa.array(out, pa.binary())).to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))

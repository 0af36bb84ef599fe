"""The compact binary format of a group model: header, languages, prefix-shared n-grams, scales, weights, bias."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from ..functions.quantise import pack6, pq_assign, pq_decode, quantise, scales, unpack6
from ..operators.vocabulary import canonical
from ..plans.model import GroupModel

#: The mark at the head, and the header bytes that stand for six-bit and product-quantised weights.
MAGIC, SIX_BITS, PRODUCT = b"LD", 6, 0xF4
SIZES = (1, 2, 3, 4, 5)


def encode_grams(grams: list[str]) -> bytes:
    """Each n-gram, in byte order, as what it shares with the one before and its own rest, up to 15 bytes each."""
    out, before = bytearray(), b""
    for g in sorted(x.encode() for x in grams):
        shared = next((k for k, (a, b) in enumerate(zip(g, before)) if a != b), min(len(g), len(before)))
        if shared > 15 or len(g) - shared > 15:
            raise ValueError(f"{g!r} is too long for the format")
        out.append(shared << 4 | len(g) - shared)
        out += g[shared:]
        before = g
    return bytes(out)


def decode_grams(data: bytes, at: int, count: int) -> tuple[list[str], int]:
    out, before = [], b""
    for _ in range(count):
        shared, rest = divmod(data[at], 16)
        before = before[:shared] + data[at + 1 : at + 1 + rest]
        at += 1 + rest
        out.append(before.decode())
    return out, at


def dumps(model: GroupModel) -> bytes:
    """The model as bytes; with a codebook its weights are product-quantised, and its n-grams must be in byte order."""
    vocab = {n: model.vocab.get(n, []) for n in SIZES}
    if model.codebook is not None and any(v != sorted(v, key=str.encode) for v in vocab.values()):
        raise ValueError("a model with a codebook needs its n-grams in byte order")
    model = canonical(GroupModel(model.langs, vocab, model.weights, model.bias, model.codebook))
    rows, columns = model.weights.shape
    out = bytearray(MAGIC + struct.pack("<BHH5H", SIX_BITS if model.codebook is None else PRODUCT, rows, columns, *map(len, model.vocab.values())))
    out += b"".join(x.encode() + b"\0" for x in model.langs)
    for n in SIZES:
        out += encode_grams(model.vocab[n])
    bias_scale = float(scales(model.bias, False))
    if model.codebook is None:
        scale = scales(model.weights, True).astype("<f4")
        body = pack6(quantise(model.weights, scale.astype(float)).ravel())
    else:
        index, scale = pq_assign(model.weights, model.codebook)
        k, d = model.codebook.shape
        body = struct.pack("<HBH", k, d, index.shape[1]) + model.codebook.astype("<f4").tobytes() + index.astype(np.uint8).tobytes()
    return bytes(out) + np.asarray(scale, "<f4").tobytes() + struct.pack("<f", bias_scale) + body + pack6(quantise(model.bias, np.float64(bias_scale)))


def loads(data: bytes) -> GroupModel:
    """A model from its bytes; any weight mark but PRODUCT is read as six bits."""
    kind, rows, columns, *counts = struct.unpack_from("<BHH5H", data, 2)
    at, langs = 17, []
    for _ in range(rows):
        end = data.index(b"\0", at)
        langs.append(data[at:end].decode())
        at = end + 1
    vocab = {}
    for n, many in zip(SIZES, counts, strict=True):
        vocab[n], at = decode_grams(data, at, many)
    scale = np.frombuffer(data, "<f4", rows, at).astype(float)
    bias_scale = struct.unpack_from("<f", data, at + 4 * rows)[0]
    at += 4 * rows + 4
    if kind == PRODUCT:
        k, d, pieces = struct.unpack_from("<HBH", data, at)
        book = np.frombuffer(data, "<f4", k * d, at + 5).reshape(k, d).astype(float)
        at += 5 + 4 * k * d
        index = np.frombuffer(data, np.uint8, rows * pieces, at).reshape(rows, pieces)
        weights, at = pq_decode(book, index, scale, columns), at + rows * pieces
    else:
        book, size = None, -(-rows * columns * 3 // 4)
        weights, at = unpack6(data[at : at + size], rows * columns).reshape(rows, columns) / scale[:, None], at + size
    return GroupModel(langs, vocab, weights, unpack6(data[at:], rows) / bias_scale, book)


def size_estimate(model: GroupModel) -> int:
    """Bytes with plain n-grams and six-bit weights."""
    rows, columns = model.weights.shape
    names = sum(len(x.encode()) + 1 for x in [*model.langs, *(g for v in model.vocab.values() for g in v)])
    return 17 + names + 4 * rows + 4 + (6 * (rows * columns + rows) + 7) // 8


def read_models(spark: SparkSession, paths: dict[str, str]) -> dict[str, GroupModel]:
    """Models by group from files on any file system that Spark reads."""
    out = {}
    for group, path in paths.items():
        out[group] = loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return out



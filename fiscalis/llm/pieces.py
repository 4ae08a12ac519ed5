"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

The library segments; this module normalises the text once more itself, by the longest prefix in the model's compiled
character map, and notes for each normalised byte which source bytes it came from. The lengths of the pieces cut the
normalised text, and the notes project each piece to its span in the original bytes.
Each text is a row of its own in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import parts, pick, table, text_of
from fiscalis.llm.tokenizers import default_path, sentencepiece
from fiscalis.sources.tables import spread

MODEL = "piece_bpe_32k.model"
BLANK = "▁".encode()
#: Text that is encoded into one Arrow batch; a piece takes 12 bytes there.
PART_BYTES = 128 * 1024
#: Kinds of pieces and numbers of fields in the model's file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
SCHEMA = "id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the public wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Normalizer:
    """Source-aligned normalisation by a model's rules: character map, blanks and the blank put in front."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, whole: tuple[bytes, ...] = ()):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.whole = sorted(whole, key=len, reverse=True)
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.strings = charsmap[4 + size :]

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What the longest mapped prefix of text[at:] becomes, and its length; else one character as it is."""
        for w in self.whole:
            if text.startswith(w, at):
                return w, len(w)
        found = None
        if self.units:
            offset = lambda u: (u >> 10) << ((u & 512) >> 6)
            node = offset(self.units[0])
            for k in range(at, len(text)):
                node ^= text[k]
                if node >= len(self.units) or self.units[node] & 0x800000FF != text[k]:
                    break
                unit = self.units[node]
                node ^= offset(unit)
                if unit >> 8 & 1:
                    found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found:
            return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + size], size

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its bytes the first source byte and the one after the last.

        A character that stays as it is maps byte by byte; a replaced prefix maps as a whole.
        """
        if not self.units and not self.squeeze and not self.whole:
            return self._plain(text)
        out, starts, ends = bytearray(), [], []
        blank = BLANK if self.escape else b" "
        at = 0
        if self.squeeze:  # blanks in front go
            while at < len(text) and self.prefix(text, at)[0] in (b" ", b""):
                at += self.prefix(text, at)[1]
        if at < len(text) and self.dummy_prefix:
            out += blank
            starts += [at] * len(blank)
            ends += [at] * len(blank)
        after_blank = self.squeeze
        while at < len(text):
            new, size = self.prefix(text, at)
            if self.squeeze and after_blank:
                new = new.lstrip(b" ")
            same = new == text[at : at + size]
            for k, byte in enumerate(new):
                put = blank if byte == 32 else bytes([byte])
                out += put
                starts += [at + k if same else at] * len(put)
                ends += [at + k + 1 if same else at + size] * len(put)
            if new:
                after_blank = self.squeeze and new.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
            del starts[len(out) :], ends[len(out) :]
        return bytes(out), np.array(starts, np.int64), np.array(ends, np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The same for a model that only escapes blanks."""
        if not text:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        source = np.arange(len(text))
        normal = text
        if self.escape:
            source = np.repeat(source, np.where(np.frombuffer(text, np.uint8) == 32, len(BLANK), 1))
            normal = text.replace(b" ", BLANK)
        ends = source + 1
        if self.dummy_prefix:
            blank = BLANK if self.escape else b" "
            normal = blank + normal
            zero = np.zeros(len(blank), np.int64)
            source, ends = np.concatenate([zero, source]), np.concatenate([zero, ends])
        return normal, source, ends


@lru_cache(2)
def model(path: str) -> tuple[Normalizer, np.ndarray, int]:
    """The normaliser of a model file, the normalised bytes of each piece, and the id of the unknown piece."""
    with open(path, "rb") as f:
        fields = list(_fields(f.read()))
    spec = dict(next((v for k, v in fields if k == 3), b"") and _fields(next(v for k, v in fields if k == 3)))
    sizes, whole, unknown = [], [], 0
    for i, piece in enumerate(dict(_fields(v)) for k, v in fields if k == 1):
        kind = piece.get(3, NORMAL)
        sizes.append(1 if kind == BYTE else 0 if kind == CONTROL else len(piece[1]))
        if kind == USER_DEFINED:
            whole.append(piece[1])
        if kind == UNKNOWN:
            unknown = i
    return Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), tuple(whole)), np.array(sizes, np.int64), unknown


def encode(text: bytes, path: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The ids of a text, and the span of each in the text's bytes."""
    library, (normalizer, sizes, unknown) = sentencepiece(path), model(path)
    ids = library.encode(text.decode())
    if not ids:
        return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    normal, starts, ends = normalizer(text)
    of = sizes[np.array(ids)]
    if unknown in ids:
        of = np.array([len(p.encode()) if i == unknown else n for i, p, n in zip(ids, library.encode(text.decode(), out_type=str), of)])
    until = np.cumsum(of)
    if until[-1] != len(normal):  # the model normalises by a rule that this module doesn't know
        return ids, *library_spans(text, path)
    return ids, starts[until - of], ends[until - 1]


def library_spans(text: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The byte spans of the pieces by the library's own alignment."""
    pieces = sentencepiece(path).encode(text.decode(), return_type="proto").pieces
    return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)


def _batches(path: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece(path)
        for b in batches:
            for part in parts(b, PART_BYTES):
                ids, starts, ends, decoded, offsets = [], [], [], [], [0]
                for cell in part.column("text").cast(pa.large_binary()):
                    i, s, e = encode(cell.as_buffer().to_pybytes(), path)
                    ids.append(np.array(i, np.int32))
                    starts.append(s.astype(np.int32))
                    ends.append(e.astype(np.int32))
                    decoded.append(library.decode(i))
                    offsets.append(offsets[-1] + len(i))
                to = pa.array(offsets, pa.int32())
                lists = {"ids": ids, "starts": starts, "ends": ends} if spans else {"ids": ids}
                arrays = [pa.ListArray.from_arrays(to, pa.array(np.concatenate([*x, np.zeros(0, np.int32)]))) for x in lists.values()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays, pa.array(decoded, pa.string())], ["id", *lists, "decoded"])

    return run


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, spans: bool = True) -> DataFrame:
    """One row (id, ids, starts, ends, decoded), without starts and ends if no spans are asked for, per row of docs, as the library encodes the whole text without begin or end ids.

    starts and ends are byte offsets in the original text; the blank put in front has an empty span at 0. Null texts count
    as empty: no pieces, decoded empty. Repeated rows and ids stay rows of their own; null ids stay null.
    """
    kept = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    return kept.mapInArrow(_batches(path or default_path(MODEL), spans), SCHEMA if spans else SCHEMA.replace("starts array<int>, ends array<int>, ", ""))


def digests(found: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256, the bytes up to the end of the last span, and spans_sha256 (of all starts, a semicolon, all ends) of encoded rows."""
    return found.select(
        "id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes_spanned"),
        F.sha2(F.concat_ws(";", *(F.array_join(F.col(c).cast("array<string>"), ",") for c in ("starts", "ends"))).cast("binary"), 256).alias("spans_sha256"),
    )


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, and digests of these, the decoded texts and the spans."""
    return digests(encode_pieces(spread(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "doc_id")

"""SentencePiece encoding and decoding by a table of distinct chunks.

Spaces of a text become markers, one more marker comes first, and pieces are merged of neighbours
only. Where no piece of the model holds two neighbouring bytes next to each other, no piece can
cross; a marker after another character is such a place in the models this is for, and so are most
places between letters and punctuation. A text's ids are hence those of its chunks between such
places, one after the other.

1. Texts are gathered in blocks of some MB. A block is kept as the texts' chunks by place among its distinct ones, which
   are in the order of their hashes.
2. The table of distinct chunks over all texts lies in buckets of the hashes' range. A block sends each bucket its distinct
   chunks there; the bucket tells them apart by their bytes, segments each once, by the library, and answers each block with
   the ids in the order it asked. Buckets are of bounded size, their number follows the input, and a chunk that is
   everywhere is one entry a block. What moves is packed: distinct chunks of blocks and their ids, not words.
3. A block's texts take the ids by position, with numpy, and the decoded text from the ids.

Null text is taken as empty; empty text has no ids. Ties and repeated rows are rows as any other.
Columns of the input other than the key and the text aren't looked at. An empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import lists, rows, trim, written
from docketry.llm.interpolation import packed, unpacked
from docketry.llm.words import CHUNK_BYTES, Octets

MARK = "▁"
_MARK_BYTES = MARK.encode()


def ragged(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the given rows, one row after the other; row i has offsets[i] to offsets[i + 1]."""
    counts = offsets[which + 1] - offsets[which]
    out = np.ones(int(counts.sum()), np.int64)
    which, counts = which[counts > 0], counts[counts > 0]
    if len(which):
        out[0] = offsets[which[0]]
        out[np.cumsum(counts[:-1])] = offsets[which[1:]] - offsets[which[:-1] + 1] + 1
    return np.cumsum(out, out=out)


@dataclass
class Cuts:
    """What a model says of places that no piece crosses, and its ids in decimals."""

    #: cut[a * 256 + b]: no piece crosses from byte a to byte b, and b begins a character.
    cut: np.ndarray
    #: Ids that don't stand for the characters of their piece.
    special: np.ndarray
    #: The id of a line end.
    line: int
    #: The ids in decimals, each with a comma.
    decimals: np.ndarray
    decimal_offsets: np.ndarray
    #: The ids' characters, for ids that aren't special.
    pieces: np.ndarray
    piece_offsets: np.ndarray


def cuts(model: bytes) -> Cuts:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
    together = np.zeros((256, 256), bool)
    for i in np.flatnonzero(~special).tolist():
        b = sp.id_to_piece(i).replace(MARK, " ").encode()
        together[list(b[:-1]), list(b[1:])] = True
    cut = ~together
    cut[0x80:, 0x80:] = False
    line = sp.piece_to_id("<0x0A>")
    probe = " a  b\tc\néﬁ "
    if together[:0x20, 0x20].any() or together[0x21:, 0x20].any():
        raise ValueError("a piece holds a marker after another character")
    if together[0x0A].any() or together[:, 0x0A].any() or not sp.is_byte(line):
        raise ValueError("line ends aren't bytes of their own in this model")
    if MARK + probe.replace(" ", MARK) != sp.normalize(probe):
        raise ValueError("the model's normalizer changes text, or adds no marker before it")
    flat = []
    for made in ([f"{i},".encode() for i in range(n)], [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]):
        flat += [np.frombuffer(b"".join(made), np.uint8), np.append(0, np.cumsum([len(x) for x in made]))]
    return Cuts(cut.reshape(-1), special, line, *flat)


def chunks(texts: list[bytes], cut: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For texts that aren't empty: their distinct chunks, each chunk's place among them, and the first chunk of each
    text. A space comes before each text."""
    flat = b" " + b" ".join(texts)
    buf = np.frombuffer(flat, np.uint8)
    begin = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begin[1:])
    apart = np.empty(len(buf), bool)
    apart[1:] = cut[buf[:-1].astype(np.int32) * 256 + buf[1:]]
    apart[begin] = True
    starts = np.flatnonzero(apart)
    ends = np.append(starts[1:], len(buf))
    octets = Octets(buf)
    _, index, place = np.unique(octets.hashes(starts, ends), return_index=True, return_inverse=True)
    said = [flat[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
    like = index[place]
    if not ((ends - starts == (ends - starts)[like]) & octets.same(starts, starts[like], ends - starts)).all():
        # Chunks that share a hash: by their bytes.
        table: dict[bytes, int] = {}
        place = np.array([table.setdefault(flat[a:b], len(table)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        said = list(table)
    return said, place, np.append(np.searchsorted(starts, begin), len(starts))


def packed_ranks(x: np.ndarray) -> bytes:
    """Whole numbers of which half or so are below 255: these in a byte each, the others behind, less 255."""
    low = np.empty(len(x), np.uint8)
    np.minimum(x, 255, out=low, casting="unsafe")
    small = packed(low)
    return len(small).to_bytes(4, "little") + small + packed(x[low == 255] - 255)


def unpacked_ranks(data: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    low = unpacked(data[4:cut])
    out = low.astype(np.int32)
    out[low == 255] += unpacked(data[cut:]).astype(np.int32)
    return out


#: Chunks that a bucket is meant to be asked for.
BUCKET_CHUNKS = 1 << 18


def _blocks(docs: DataFrame, kind: str, cut: object, block_bytes: int) -> DataFrame:
    """(block, ids, counts, ranks, places, n, sizes, chunks): keys of texts, how many chunks each has, the chunks by how often
    the block has them, the place of each rank among the block's distinct chunks; these in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        ids, counts, places, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            # Frees what it has packed before it packs the next thing: a block is large.
            keys = pa.chunked_array(ids).combine_chunks()
            told = np.concatenate([*places, np.zeros(0, np.int32)])
            places.clear()
            said = list(table)
            table.clear()
            off = np.append(0, np.cumsum([len(x) for x in said])).astype(np.int64)
            flat = b"".join(said)
            h = Octets(np.frombuffer(flat, np.uint8)).hashes(off[:-1], off[1:])
            order = np.argsort(h, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            # Chunks that are there often have small numbers, which pack better.
            often = np.argsort(-np.bincount(told, minlength=len(said)), kind="stable")
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often), dtype=np.int32)
            np.take(rank, told, out=told, mode="clip")
            ranks = packed_ranks(told)
            del told, said, h, rank
            sizes = np.diff(off)
            texts = np.frombuffer(flat, np.uint8)[ragged(off, order)].tobytes()
            row = [uuid.uuid4().int >> 65, None, packed(np.concatenate(counts)), ranks, packed(place[often]), len(order), packed(sizes[order]), zstandard.compress(texts, 3)]
            columns = [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.null(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2), strict=True)]
            columns[1] = lists(keys, [len(keys)])
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "counts", "ranks", "places", "n", "sizes", "chunks"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0
                lo = at
                while at < batch.num_rows and (at == lo or (held < CHUNK_BYTES and at - lo < 4096)):
                    texts.append((rows(batch, "said")[at].as_py() or b"").replace(_MARK_BYTES, b" "))
                    held += len(texts[-1])
                    at += 1
                count = np.zeros(len(texts), np.int64)
                if (full := [i for i, t in enumerate(texts) if t]):
                    said, place, first = chunks([texts[i] for i in full], cut.value)
                    count[full] = np.diff(first)
                    places.append(np.array([table.setdefault(c, len(table)) for c in said], np.int32)[place])
                ids.append(rows(batch, "id").take(pa.array(np.arange(lo, at))))  # a slice would keep the whole batch
                counts.append(count)
                size += held + 8 * len(texts)
                if size >= block_bytes:
                    yield made()
                    ids, counts, size = [], [], 0
        if ids:
            yield made()
        trim()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, counts binary, ranks binary, places binary, n long, sizes binary, chunks binary")


class Segmenter:
    """Ids of chunks, and the text that they decode to, by the library."""

    def __init__(self, model: bytes, special: np.ndarray, line: int):
        import sentencepiece

        self.sp, self.special, self.line = sentencepiece.SentencePieceProcessor(model_proto=model), special, line

    def __call__(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
        """All ids, how many each chunk has, and the decoded text of chunks with special ids."""
        # A line end is an id of its own wherever it stands, so it parts the chunks.
        got = np.array(self.sp.encode("\n" + "\n".join(["" if c == b"\n" else c.decode("utf-8", "replace") for c in some])), np.int32)
        lines = np.append(np.flatnonzero(got == self.line), len(got))
        if (alone := [k for k, c in enumerate(some) if c == b"\n"]):
            got = np.insert(got, lines[np.array(alone) + 1], self.line)
            lines = lines + np.searchsorted(alone, np.arange(len(lines)))
        counts = np.diff(lines) - 1
        keep = np.ones(len(got), bool)
        keep[lines[:-1]] = False
        keep[: lines[0]] = False
        ids, off = got[keep], np.append(0, np.cumsum(counts))
        # Ids of ordinary pieces decode to the pieces' characters. Before others a line end keeps the library
        # from dropping a leading space.
        odd = np.flatnonzero(np.add.reduceat(self.special[ids].astype(np.int64), off[:-1])).tolist()
        return ids, counts, {k: self.sp.decode([self.line, *ids[off[k] : off[k + 1]].tolist()])[1:].encode() for k in odd}


def _answers(blocks: DataFrame, shared: object, buckets: int) -> DataFrame:
    """(of, bucket, counts, ids, odd_at, odd): for each block and bucket how many ids each of the block's chunks there
    has, the ids, and the decoded text of chunks with special ids."""
    bits = max(1, (buckets - 1).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, said in zip(*(rows(batch, c).to_pylist() for c in ("block", "sizes", "chunks")), strict=True):
                size, said = unpacked(sizes).astype(np.int64), zstandard.decompress(said)
                off = np.append(0, np.cumsum(size)).astype(np.int64)
                bucket = (Octets(np.frombuffer(said, np.uint8)).hashes(off[:-1], off[1:]) >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
                parts = [(int(bucket[a]), packed(size[a:b]), zstandard.compress(said[off[a] : off[b]], 3)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([block] * len(parts), pa.int64()), *(pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))]
                yield pa.RecordBatch.from_arrays(columns, names=["of", "bucket", "sizes", "chunks"])

    def answer(group: pa.Table) -> pa.Table:
        segment = Segmenter(*shared.value)
        table: dict[bytes, int] = {}
        asked = []
        for sizes, said in zip(group["sizes"].to_pylist(), group["chunks"].to_pylist(), strict=True):
            said, off = zstandard.decompress(said), np.append(0, np.cumsum(unpacked(sizes).astype(np.int64))).tolist()
            asked.append(np.array([table.setdefault(said[a:b], len(table)) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64))
        distinct = list(table)
        del table
        made, odd = [], {}
        for lo in range(0, len(distinct), 512):
            ids, counts, mine = segment(distinct[lo : lo + 512])
            made.append((ids, counts))
            odd |= {lo + k: x for k, x in mine.items()}
        ids, off = np.concatenate([m[0] for m in made]), np.append(0, np.cumsum(np.concatenate([m[1] for m in made])))
        is_odd = np.zeros(len(distinct), bool)
        is_odd[list(odd)] = True
        out = {"of": group["of"], "bucket": group["bucket"]}
        out["counts"] = pa.array([packed(np.diff(off)[at]) for at in asked], pa.binary())
        out["ids"] = pa.array([packed(ids[ragged(off, at)]) for at in asked], pa.binary())
        spots = [np.flatnonzero(is_odd[at]) for at in asked]
        out["odd_at"] = pa.array([x.tolist() for x in spots], pa.list_(pa.int32()))
        out["odd"] = pa.array([[odd[k] for k in at[x].tolist()] for at, x in zip(asked, spots, strict=True)], pa.list_(pa.binary()))
        return pa.table(out)

    asked = blocks.select("block", "sizes", "chunks").mapInArrow(ask, "of long, bucket int, sizes binary, chunks binary")
    return asked.groupBy("bucket").applyInArrow(answer, "of long, bucket int, counts binary, ids binary, odd_at array<int>, odd array<binary>")


def _replaced(flat: np.ndarray, off: np.ndarray, odd: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with some replaced."""
    if not odd:
        return flat, off
    sizes, parts, at = np.diff(off), [], 0
    for k in sorted(odd):
        parts += [flat[at : off[k]], np.frombuffer(odd[k], np.uint8)]
        at, sizes[k] = off[k + 1], len(odd[k])
    return np.concatenate([*parts, flat[at:]]), np.append(0, np.cumsum(sizes))


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", block_bytes: int = 24 << 20, digests: bool = False) -> DataFrame:
    """Columns key, n_tokens, then ids (array<int>) and decoded (string); with digests their SHA-256 instead.

    model: the path of the model's file, read by the driver alone.
    """
    context = df.sparkSession.sparkContext
    with open(model, "rb") as f:
        proto = f.read()
    known = cuts(proto)
    # All three are as large as the model.
    cut, shared, table = (context.broadcast(x) for x in (known.cut, (proto, known.special, known.line), (known.decimals, known.decimal_offsets, known.pieces, known.piece_offsets)))
    kind = df.schema[key].dataType.simpleString()
    blocks = written(_blocks(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("said")), kind, cut, block_bytes), "blocks")
    asked = blocks.agg(F.sum("n")).first()[0] or 0
    answers = _answers(blocks, shared, -(-asked // BUCKET_CHUNKS))
    names = [key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = [kind, "long", "string" if digests else "array<int>", "string"]

    def joined(block: pa.Table, told: pa.Table) -> pa.Table:
        """The texts of a block, from its chunks' ids by position."""
        keys = block["ids"].combine_chunks()
        keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).flatten()
        counts, places = unpacked(block["counts"][0].as_py()).astype(np.int64), unpacked(block["places"][0].as_py()).astype(np.int32)
        places = places[unpacked_ranks(block["ranks"][0].as_py())] if len(places) else places
        told = told.sort_by("bucket")
        sizes = [unpacked(x).astype(np.int64) for x in told["counts"].to_pylist()]
        ids = np.concatenate([*(unpacked(x).astype(np.int32) for x in told["ids"].to_pylist()), np.zeros(0, np.int32)])
        id_off = np.append(0, np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)])))
        starts, odd = np.cumsum([0, *(len(x) for x in sizes)]).tolist(), {}
        for base, spots, texts in zip(starts, told["odd_at"].to_pylist(), told["odd"].to_pylist(), strict=False):
            odd |= {base + k: x for k, x in zip(spots, texts, strict=True)}
        decimal, decimal_off, piece, piece_off = table.value
        said_off = np.append(0, np.cumsum(piece_off[ids + 1] - piece_off[ids]))[id_off]
        said, said_off = _replaced(piece[ragged(piece_off, ids)], said_off, odd)
        first = np.append(0, np.cumsum(counts))
        n, out_ids, out_said = np.zeros(len(counts), np.int64), [], []
        lo = 0
        while lo < len(counts):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 18), "right")) - 1)
            at, cut_at = places[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]
            mine = ids[ragged(id_off, at)]
            per = np.append(0, np.cumsum(id_off[at + 1] - id_off[at]))[cut_at]
            ends = np.append(0, np.cumsum(said_off[at + 1] - said_off[at]))[cut_at]
            raw = said[ragged(said_off, at)].tobytes()
            n[lo:hi] = np.diff(per)
            # The space before a text is dropped.
            decoded = [raw[a:b].removeprefix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            if digests:
                made = decimal[ragged(decimal_off, mine)].tobytes()
                spots = np.append(0, np.cumsum(decimal_off[mine + 1] - decimal_off[mine]))[per].tolist()
                out_ids += [hashlib.sha256(made[a : max(a, b - 1)]).hexdigest() for a, b in zip(spots[:-1], spots[1:], strict=True)]
                out_said += [hashlib.sha256(x).hexdigest() for x in decoded]
            else:
                out_ids.append(mine)
                out_said += [x.decode() for x in decoded]
            lo = hi
        trim()
        made = pa.array(out_ids, pa.string()) if digests else lists(pa.array(np.concatenate([*out_ids, np.zeros(0, np.int32)])), n)
        return pa.table([keys, pa.array(n), made, pa.array(out_said, pa.string())], names=names)

    schema = ", ".join(f"`{a}` {b}" for a, b in zip(names, kinds, strict=True))
    return blocks.select("block", "ids", "counts", "ranks", "places").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(joined, schema)

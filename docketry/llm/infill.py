"""Fill-in-middle texts by ropes.

A text's UTF-8 bytes become the leaves of a balanced tree; every node caches how many code points, unit ends and bytes lie below it, so a
split at a unit's or a code point's rank walks one path down, and the pieces share all leaves but those that are cut. A document
is split after its prefix and after its middle; prefix, suffix and middle are put together again with sentinels between them.
``restore`` does the reverse: it splits the tree of an output at its sentinels and joins the pieces in the order of the text.

Units are lines (``[^\\n]*\\n|[^\\n]+``) or code points. psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle, plain the text
alone: of empty texts, of those that hold a sentinel, and of the share that isn't asked for. Sentinels must begin with a character that
none of them has elsewhere, so that none can arise where a piece meets a sentinel, and the first one found is the one put there.

Null texts count as empty, null keys as the empty text; equal keys make equal choices. Texts of any length are taken whole, one at a time; rows
don't depend on one another, so an empty table gives no rows, repeated rows repeat, and nothing is shuffled. Columns of the input with the
names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.frames import rows, utf8

#: Bytes of a leaf, at most 3 more where a code point would be cut.
LEAF_BYTES = 2048
#: prefix, suffix and middle begin with these.
SENTINELS = ("<P>", "<S>", "<M>")
#: What infill() adds.
RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf with bytes, or a node with two ropes. height is 0 for leaves; chars, ends and size are of all below."""

    chars: int
    ends: int
    size: int
    height: int = 0
    data: bytes = b""
    left: Rope | None = None
    right: Rope | None = None

    def pieces(self) -> Iterator[bytes]:
        stack = [self]
        while stack:
            at = stack.pop()
            if at.left is None:
                yield at.data
            else:
                stack += [at.right, at.left]

    def __bytes__(self) -> bytes:
        return b"".join(self.pieces())


_CONTINUED = bytes(range(0x80, 0xC0))


def leaf(data: bytes) -> Rope:
    return Rope(len(data) if data.isascii() else len(data.translate(None, _CONTINUED)), data.count(b"\n"), len(data), 0, data)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.chars + b.chars, a.ends + b.ends, a.size + b.size, max(a.height, b.height) + 1, b"", a, b)


def _level(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Both in turn; work grows with the difference of their heights."""
    if not a.size or not b.size:
        return a if a.size else b
    if a.height > b.height + 1:
        return _level(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _level(concat(a, b.left), b.right)
    if not a.height and not b.height and a.size + b.size <= LEAF_BYTES:
        return Rope(a.chars + b.chars, a.ends + b.ends, a.size + b.size, 0, a.data + b.data)
    return _node(a, b)


def rope(data: bytes) -> Rope:
    """The tree of a text; leaves end between code points."""
    cuts, at = [0], LEAF_BYTES
    while at < len(data):
        while at < len(data) and 0x80 <= data[at] < 0xC0 and at < cuts[-1] + LEAF_BYTES + 3:
            at += 1
        cuts.append(at)
        at += LEAF_BYTES
    level = [leaf(data[a:b]) for a, b in pairwise([*cuts, len(data)])]
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def units(r: Rope, unit: str) -> int:
    """How many units a rope has; a last line without an end is one."""
    if unit == "chars":
        return r.chars
    at = r
    while at.left is not None:
        at = at.right
    return r.ends + (at.size > 0 and not at.data.endswith(b"\n"))


def _place(data: bytes, rank: int, unit: str) -> int:
    """The byte after the first rank units of a leaf that has as many."""
    if unit == "chars":
        if data.isascii():
            return rank
        at = 0
        for at, b in enumerate(data):
            if not 0x80 <= b < 0xC0:
                if not rank:
                    return at
                rank -= 1
        return len(data)
    at = -1
    for _ in range(rank):
        at = data.index(b"\n", at + 1)
    return at + 1


def split(r: Rope, rank: int, unit: str) -> tuple[Rope, Rope]:
    """The first rank units, and the rest."""
    have = r.chars if unit == "chars" else r.ends
    if rank <= 0 or rank > have:
        return (r, leaf(b"")) if rank > 0 else (leaf(b""), r)
    if r.left is None:
        at = _place(r.data, rank, unit)
        return leaf(r.data[:at]), leaf(r.data[at:])
    here = r.left.chars if unit == "chars" else r.left.ends
    if rank <= here:
        a, b = split(r.left, rank, unit)
        return a, concat(b, r.right)
    a, b = split(r.right, rank - here, unit)
    return concat(r.left, a), b


def checked(sentinels: tuple[str, str, str]) -> list[Rope]:
    """The sentinels as ropes; raises if they could arise where a piece ends."""
    firsts, rest = {s[:1] for s in sentinels}, "".join(s[1:] for s in sentinels)
    if len(set(sentinels)) != 3 or "" in sentinels or any(c in rest for c in firsts) or any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must differ, be no prefixes of one another, and begin with characters that none of them has elsewhere")
    return [leaf(s.encode()) for s in sentinels]


def rearranged(text: bytes, first: int, second: int, form: str, marks: list[Rope], unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output), cut at first % (n + 1) and second % (n + 1)."""
    whole = rope(text)
    n = units(whole, unit)
    if not text or form == "plain" or any(m.data in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    prefix, rest = split(whole, low, unit)
    middle, suffix = split(rest, high - low, unit)
    p, s, m = marks
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = leaf(b"")
    for part in parts:
        out = concat(out, part)
    return n, form, prefix.chars, middle.chars, bytes(out)


def original(output: bytes, form: str, marks: list[Rope]) -> bytes:
    """The text of an output of the given form."""
    if form == "plain":
        return output
    order = [0, 1, 2] if form == "psm" else [1, 0, 2]
    rest, parts, at = rope(output), {}, 0
    for k, nxt in zip(order, [*order[1:], None], strict=True):
        begin = at + marks[k].size
        if output[at:begin] != marks[k].data or (end := len(output) if nxt is None else output.find(marks[nxt].data, begin)) < 0:
            raise ValueError(f"no output of form {form}")
        _, rest = split(rest, marks[k].chars, "chars")
        chars = rest.chars if nxt is None else leaf(output[begin:end]).chars
        parts[k], rest = split(rest, chars, "chars")
        at = end
    return bytes(concat(concat(parts[0], parts[2]), parts[1]))


def _each(df: DataFrame, given: list[tuple[str, Column]], kinds: str, f: Callable[..., tuple]) -> DataFrame:
    """df with the results of f over the given columns of each row."""
    added = T._parse_datatype_string(kinds)
    kept, names = [x.name for x in df.schema.fields if x.name not in added.names], [name for name, _ in given]
    arrow = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.dataType.simpleString()] for x in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                made = [f(*x) for x in zip(*(rows(some, name).to_pylist() for name in names), strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows(some, c) for c in kept), *columns], names=[*kept, *results])

    schema, results = T.StructType([*(x for x in df.schema.fields if x.name in kept), *added.fields]), added.names
    return df.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(name) for name, c in given)).mapInArrow(run, schema)


def choices(key: Column, seed: int = 7) -> list[Column]:
    """Four unsigned numbers of 32 bits: the first hexadecimal digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infill(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", percent: int = 100, spm_percent: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with RESULT: the units, the form, the code points of prefix and middle (null where plain), and the output's bytes.
    percent of the documents that could be are rearranged, spm_percent of these as spm."""
    if unit not in ("lines", "chars"):
        raise ValueError("unit is lines or chars")
    marks = checked(sentinels)
    h1, h2, h3, h4 = choices(F.col(f"`{key}`"), seed)
    form = F.when(h3 % 100 >= percent, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    given = [("__text", utf8(F.col(f"`{text}`"))), ("__h1", h1), ("__h2", h2), ("__form", form)]
    return _each(df, given, RESULT, lambda t, a, b, how: rearranged(t, a, b, how, marks, unit))


def restore(df: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with the column restored: the bytes of the text that an output of infill() was made of."""
    marks = checked(sentinels)
    return _each(df, [("__output", utf8(F.col(f"`{output}`"))), ("__form", F.coalesce(F.col(f"`{form}`"), F.lit("plain")))], "restored binary", lambda o, how: (original(o, how, marks),))


def sql() -> str:
    """DuckDB SQL for op11: n, form, code points and digests of documents with the defaults."""
    return r"""
    WITH lines AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
         drawn AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || d[25:32])::BIGINT % 100 AS h4 FROM lines),
         cut AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
                        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM cut"""

"""Fill-in-the-middle: whole texts, cut at two token boundaries and put together anew.

A text is cut into chunks where a rolling hash of its last WINDOW bytes says so, so equal passages make equal chunks wherever they stand. A
chunk's summary (code points, token ends inside, whether it begins and ends with white space) is made once and kept under the chunk's own bytes:
a chunk counts as known only if all its bytes agree. Sums of the summaries, with the token ends on chunk boundaries, give a
document's tokens, and a cut is searched in those sums; only the chunk that holds it is read again.

A token is white space with the run of other characters after it, or white space at the end. So a token ends where white space follows anything
else, and at the end of a text that isn't empty.

Defined results: null is empty text, which is plain and has 0 tokens; texts with a marker inside are plain; a null doc_id draws as the empty
string; rows of the same id draw alike, each for its own text; an empty table gives no rows; other columns are not read. A very long text
takes a few times its own size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import claim, mix, remember, slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FILLED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: Bytes that the rolling hash sees; least and most bytes of a chunk; bits that are 0 at one of 1,024 places.
WINDOW, LEAST, MOST, BITS = 32, 256, 8192, 10
#: Bytes of chunks that a worker remembers.
KEPT = 48 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end; the same bytes are cut alike wherever they stand, but for LEAST and MOST."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW and reach < len(h):
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    places = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > LEAST:
        i = int(np.searchsorted(places, at + LEAST))
        at = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def token_ends(chunk: bytes) -> np.ndarray:
    """Places inside a chunk where white space follows anything else."""
    space = _SPACE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Summaries(dict):
    """(code points, token ends inside, first is white space, last is white space) by a chunk's bytes."""

    def __init__(self):
        self.bytes = 0

    def __missing__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = (code_points(chunk), len(token_ends(chunk)), bool(_SPACE[chunk[0]]), bool(_SPACE[chunk[-1]]))
        if self.bytes > KEPT:
            self.clear()
            self.bytes = 0
        self[chunk] = found
        self.bytes += len(chunk) + 200
        return found


class Document:
    """A text as chunks, with the sums over their summaries."""

    def __init__(self, text: bytes, known: Summaries):
        self.text, ends = text, chunk_ends(np.frombuffer(text, np.uint8))
        self.at = [0, *ends]
        rows = [known[text[a:b]] for a, b in zip(self.at, ends)]
        self.chars = np.cumsum([0, *(r[0] for r in rows)])
        #: 1 where a token ends right at the beginning of a chunk.
        self.edge = np.array([0, *(int(b[2] and not a[3]) for a, b in zip(rows, rows[1:]))][: len(rows)], np.int64)
        self.upto = np.cumsum(self.edge + np.array([r[1] for r in rows], np.int64)) if rows else np.zeros(0, np.int64)
        self.n = int(self.upto[-1]) + 1 if rows else 0

    def cut(self, k: int) -> tuple[int, int]:
        """The byte and the code point at which the first k tokens end."""
        if k == 0:
            return 0, 0
        if k >= self.n:
            return len(self.text), int(self.chars[-1])
        i = int(np.searchsorted(self.upto, k))
        rest = k - (int(self.upto[i - 1]) if i else 0) - int(self.edge[i])
        a, b = self.at[i], self.at[i + 1]
        inside = int(token_ends(self.text[a:b])[rest - 1]) if rest else 0
        return a + inside, int(self.chars[i]) + (code_points(self.text[a : a + inside]) if inside else 0)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits for each document, whatever stands around it."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arranged(doc_id: int | None, text: bytes, known: Summaries, seed: int, percent: int, suffix_first: int) -> tuple:
    """One row of FILLED without its doc_id."""
    document, (h1, h2, h3, h4) = Document(text, known), draws(seed, doc_id)
    if not text or h3 % 100 >= percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return document.n, "plain", None, None, text
    cuts = sorted((h1 % (document.n + 1), h2 % (document.n + 1)))
    (a, a_chars), (b, b_chars) = map(document.cut, cuts)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return document.n, form, a_chars, b_chars - a_chars, output


_SUMMARIES = Summaries()


def _forget() -> None:
    _SUMMARIES.clear()
    _SUMMARIES.bytes = 0


remember("chunks", _forget)


def _fill(seed: int, percent: int, suffix_first: int):
    def run(batches):
        for batch in slices(batches):
            claim("chunks")
            rows = [arranged(i, t or b"", _SUMMARIES, seed, percent, suffix_first) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch))]
            n, form, prefix, middle, output = (list(x) for x in zip(*rows))
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: `percent` of the documents are rearranged, `suffix_first` per cent of
    those with the suffix in front. Nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_fill(seed, percent, suffix_first), FILLED)


def restored(output: Column, form: Column) -> Column:
    """The text out of an output: no part of a rearranged text holds a marker, so each marker stands once."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

"""Keyword-stuffed pages and link lists.

A text is cut into blocks. Each block is compressed behind the longer of the
two parts of its page that lie before and after it, so its compression ratio
tells how much of it the page has already said; a list repeats its keywords,
hosts, name parts and separators. Ratios are normalised by those of blocks made
of sentences, of the same language, block length and length of context. The
text itself is compressed, as it stands but for case.

A block is confirmed by its punctuation: few of its letters are in sentences
that close with a mark, and it holds no data, which are numbers standing alone
or unbroken runs of letters. A page is stuffed if confirmed blocks are more
than half of it and extremely redundant as a whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.operators.grouped import spread
from voxelmill.storage import materialize

BLOCK = 150  # letters
#: Classes that are compared: block lengths and lengths of context.
LENGTHS = (30, 60, 90, 120, 150, 180, 210, 240)
CONTEXTS = (1, 200, 400, 800, 1600, 3200, 6400, 12800)
LOW_RATIO = 0.94  # of the norm, over the confirmed blocks of a page
#: The ratio of sentences, where no block of a class is made of them.
USUAL_RATIO = 0.6
SENTENCES = 0.6  # a block whose letters are in sentences to this share counts for the norm
FEW_SENTENCES = 0.5  # a confirmed block has fewer
FRESH = 0.72  # of the letters of a sentence are in words not used before in it
FEW_NUMBERS = 0.16  # and fewer letters in numbers
LONG_RUN = 0.5  # and fewer in unbroken runs
FLUSH = 5  # bytes that mark the end of a block in the stream

_END = re.compile(r"[.!?]+[\"'”»)\]]*(?=\s|$)|[。！？]+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"(?<![\w.-])[+-]?\d[\d.,:/-]*(?![\w-])")
_SIGN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_RUN = re.compile(r"[A-Za-z]{30,}")


def sentences(text: str) -> list[tuple[int, int]]:
    """Where sentences lie: five words or more, few of their letters in repeated ones, closed by a mark; eight signs, few of them repeated, in scripts without spaces."""
    out, begin = [], 0
    for end in _END.finditer(text):
        a, begin = begin, end.end()
        if end.group()[0] == "\n":
            continue
        s = text[a:begin].lower()
        words = _WORD.findall(s)
        signs = _SIGN.findall(s)
        if len(signs) >= 8:
            if len(set(signs)) >= FRESH * len(signs):
                out.append((a, begin))
        elif len(words) >= 5 and sum(map(len, set(words))) >= FRESH * sum(map(len, words)):
            out.append((a, begin))
    return out


def cut(text: str) -> list[int]:
    """Block edges, the ends included, moved to the next line end or space near by so that words and links stay whole."""
    n = len(text)
    count = max(1, round(n / BLOCK))
    edges = [0]
    for k in range(1, count):
        at = n * k // count
        near = text.find("\n", at, at + 60)
        near = text.find(" ", at, at + 60) if near < 0 else near
        if max(near, at) > edges[-1]:
            edges.append(max(near, at))
    edges.append(n)
    return edges


def packed(parts: list[bytes]) -> list[int]:
    """Bytes that each part adds to the compressed stream of those before it."""
    stream = zlib.compressobj(6, zlib.DEFLATED, -15)
    return [max(1, len(stream.compress(p)) + len(stream.flush(zlib.Z_SYNC_FLUSH)) - FLUSH) for p in parts]


def measure(text: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, int, float]]]:
    """Blocks made of sentences (length class, context class, ratio) and confirmed blocks (the same behind their letters)."""
    edges = cut(text)
    parts = [text[a:b].lower() for a, b in zip(edges[:-1], edges[1:])]
    raw = [p.encode("utf-8", "replace") for p in parts]
    forth = packed(raw)
    back = packed(raw[::-1])[::-1] if len(raw) > 1 else forth
    said = [0] * len(parts)  # letters in sentences
    k = 0
    for a, b in sentences(text):
        while edges[k + 1] <= a:
            k += 1
        j = k
        while j < len(parts) and edges[j] < b:
            said[j] += min(b, edges[j + 1]) - max(a, edges[j])
            j += 1
    spoken, poor = [], []
    for k, part in enumerate(parts):
        n, before, after = edges[k + 1] - edges[k], edges[k], len(text) - edges[k + 1]
        share = said[k] / n
        if FEW_SENTENCES <= share < SENTENCES:
            continue
        row = (bisect_right(LENGTHS, n), bisect_right(CONTEXTS, max(before, after)), (forth[k] if before >= after else back[k]) / len(raw[k]))
        if share >= SENTENCES:
            spoken.append(row)
        elif sum(map(len, _NUMBER.findall(part))) < FEW_NUMBERS * len(part) and sum(map(len, _RUN.findall(part))) < LONG_RUN * len(part):
            poor.append((n, *row))
    return spoken, poor


def block_measures(df: DataFrame, item: str, text: str, language: str) -> DataFrame:
    """``i, lang, n, spoken, poor``: the measures of every text; null and blank texts have none."""
    kind = dict(df.dtypes)[item]
    row = [("width", pa.int8()), ("context", pa.int8()), ("ratio", pa.float32())]
    kinds = {"spoken": row, "poor": [("n", pa.int32()), *row]}

    def lists(rows: list[list[tuple]], fields: list[tuple]) -> pa.Array:
        flat = [r for own in rows for r in own]
        values = pa.StructArray.from_arrays([pa.array([r[j] for r in flat], t) for j, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column(2).to_pylist()
                rows = [measure(t) if t and not t.isspace() else ([], []) for t in texts]
                cols = [lists([r[j] for r in rows], fields) for j, fields in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t or "") for t in texts], pa.int64()), *cols], names=["i", "lang", "n", *kinds])

    lang = F.lower(F.trim(F.coalesce(F.col(language).cast("string"), F.lit("und")))).alias("lang")
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), lang, F.col(text).alias("x"))
    return spread(rows).mapInArrow(run, f"i {kind}, lang string, n long, spoken array<struct<width:byte,context:byte,ratio:float>>, poor array<struct<n:int,width:byte,context:byte,ratio:float>>")


def stuffed_pages(df: DataFrame, item: str, text: str, language: str, low_ratio: float = LOW_RATIO) -> DataFrame:
    """``item, share, ratio``: stuffed pages, the share of their letters in confirmed blocks, and the mean ratio of these to the norm.

    Null, empty and blank texts are no such pages; null languages count as
    ``und``. Rows of one id are taken as one text.
    """
    measured = materialize(block_measures(df, item, text, language), "blocks")
    # the norm is that of sentences, so however much of the corpus is stuffed doesn't move it
    spoken = measured.select("lang", F.explode("spoken").alias("b")).select("lang", "b.*")
    own = spoken.groupBy("lang", "width", "context").agg(F.percentile_approx("ratio", 0.5).alias("own"))
    common = spoken.groupBy("width", "context").agg(F.percentile_approx("ratio", 0.5).alias("common"))
    # most pages are out before any join: those that consist of sentences or data
    letters = F.aggregate("poor", F.lit(0).cast("long"), lambda s, b: s + b.n)
    pages = measured.select("i", "lang", "n", letters.alias("letters"), "poor").where("2 * letters > n")
    blocks = pages.select("i", "lang", "n", F.explode("poor").alias("b")).select("i", "lang", F.col("n").alias("whole"), "b.*")
    classes = materialize(blocks.select("lang", "width", "context").distinct().join(own, ["lang", "width", "context"], "left").join(common, ["width", "context"], "left").select("lang", "width", "context", F.coalesce(F.greatest("own", "common"), F.lit(USUAL_RATIO)).alias("norm")), "norms")
    out = blocks.join(classes, ["lang", "width", "context"]).groupBy("i").agg(F.sum("n").alias("letters"), F.sum("whole").alias("wholes"), F.count("*").alias("blocks"), F.sum(F.col("n") * F.col("ratio") / F.col("norm")).alias("weighed"))
    out = out.select(F.col("i").alias(item), (F.col("letters") * F.col("blocks") / F.col("wholes")).alias("share"), (F.col("weighed") / F.col("letters")).alias("ratio"))
    return out.where(F.col("ratio") < low_ratio)

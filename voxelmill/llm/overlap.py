"""Same or near-same records across splits.

One edit destroys a q-letter shingle only if it falls into it. Of sequences
within t edits, any set of shingles that needs t + 1 edits to be destroyed,
such as t + 1 that don't overlap, has one left in the other sequence, at a
position that differs by at most t. Shingles are taken in order of their
rarity until t + 1 of those taken lie apart: these prefixes are short and
selective. Prefixes of the evaluation records are the index, those of the
training records probe it, lengths and positions filter, and the distance
itself verifies. Records too short for that are matched by what is left of them
after one deletion.

Copies are compared once: results are pairs of classes with their members, and
whoever wants pairs of records expands them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelmill.functions.keys import entry_code
from voxelmill.operators.grouped import spread
from voxelmill.storage import materialize

SHINGLE = 5
#: One edit is allowed for so many letters of the longer sequence.
PER_EDIT = 10
#: Classes of shingles whose counts give the order; the counts (4 MB) are broadcast.
CLASSES = 1 << 19


def bare_sequence(seq: Column) -> Column:
    """Upper-case, without white space and ``*``; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(seq, r"[\s*]+", "")), F.lit(""))


def shingles(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text number, position and 64-bit code of each shingle. Codes that fall together only add candidates."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length) - length
    count = np.maximum(length - q + 1, 0)
    number = np.repeat(np.arange(len(texts)), count)
    position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = start[number] + position
    code = np.zeros(len(at), np.uint64)
    for j in range(q):
        code = (code ^ chars[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return number, position, code


def _reach(length: np.ndarray, per: int) -> np.ndarray:
    """The most edits between a text of this length and any partner: the longest has m letters, m - m // per <= length."""
    longest = length + length // (per - 1)
    longest = np.where(longest - longest // per > length, longest - 1, longest)
    return np.maximum(longest, length) // per


def _check(q: int, per: int) -> None:
    length = np.arange(2 * per - 2, 2 * per + 2000)
    if (length - q + 1 < q * _reach(length, per) + 1).any():
        raise ValueError(f"shingles of {q} letters are too long for one edit in {per}")


def _class_counts(texts: DataFrame, q: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            code = shingles(batch.column(0).to_pylist(), q)[2]
            total += np.bincount((code >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    rows = texts.select("seq").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return counts


def prefix(position: np.ndarray, code: np.ndarray, q: int, edits: int) -> int:
    """How many shingles, in their order, hold ``edits`` + 1 that lie apart; all of the last one's code count."""
    taken, apart = bytearray(int(position.max()) + q), 0
    for m, p in enumerate(position.tolist()):
        if not taken[p]:
            apart += 1
            if apart > edits:
                m += 1
                while m < len(code) and code[m] == code[m - 1]:
                    m += 1
                return m
            a = max(0, p - q + 1)
            taken[a : p + q] = b"\1" * (p + q - a)
    return len(position)


def _prefixes(texts: DataFrame, q: int, per: int) -> DataFrame:
    """``sid, len, code, pos, train, eval``: the rarest shingles of every text, as many as an exact match needs."""
    held = texts.sparkSession.sparkContext.broadcast(_class_counts(texts, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                seqs = part.column(1).to_pylist()
                length = np.array([len(s) for s in seqs], np.int64)
                number, position, code = shingles(seqs, q)
                rare = counts[(code >> np.uint64(20)).astype(np.int64) % CLASSES]
                order = np.lexsort((position, code, rare, number))
                number, position, code = number[order], position[order], code[order]
                first = np.searchsorted(number, np.arange(len(seqs) + 1))
                most = _reach(length, per)
                n = np.array([prefix(position[x:y], code[x:y], q, e) for x, y, e in zip(first[:-1], first[1:], most)], np.int64)
                keep = np.arange(len(number)) - first[number] < n[number]
                number, position, code = number[keep], position[keep], code[keep]
                of = pa.array(number)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(length[number]), pa.array(code.view(np.int64)), pa.array(position), part.column(2).take(of), part.column(3).take(of)], names=["sid", "len", "code", "pos", "train", "eval"])

    long = texts.where(F.length("seq") >= 2 * per - 2)
    return spread(long.select("sid", "seq", "train", "eval")).mapInArrow(run, "sid long, len long, code long, pos long, train boolean, eval boolean")


def near_sequences(texts: DataFrame, q: int = SHINGLE, per: int = PER_EDIT) -> DataFrame:
    """``t, e``: training and evaluation text within one edit for every ``per`` letters of the longer.

    texts: ``sid, seq, train, eval``, every seq once. A text of both sides pairs with itself.
    """
    _check(q, per)
    allowed = "floor(greatest({0}, {1}) / " + str(per) + ")"
    posts = materialize(_prefixes(texts, q, per), "prefixes")
    index = posts.where("eval").select("code", F.col("sid").alias("e"), F.col("len").alias("el"), F.col("pos").alias("ep"))
    probe = posts.where("train").select("code", F.col("sid").alias("t"), F.col("len").alias("tl"), F.col("pos").alias("tp"))
    edits = allowed.format("el", "tl")
    hits = probe.join(index, "code").where(f"t <> e AND greatest(el, tl) >= {2 * per} AND abs(el - tl) <= {edits} AND abs(ep - tp) <= {edits}").select("t", "e")
    # texts of under two allowed edits: equal after at most one deletion in each
    short = texts.where(F.length("seq") < 2 * per)
    cuts = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.concat(F.substring(F.col("seq"), F.lit(1), i - 1), F.substring(F.col("seq"), i + 1, F.length("seq"))))
    left = short.select("sid", "train", "eval", F.explode(F.array_distinct(F.concat(F.array("seq"), cuts))).alias("rest"))
    brief = left.where("train").select("rest", F.col("sid").alias("t")).join(left.where("eval").select("rest", F.col("sid").alias("e")), "rest").where("t <> e").select("t", "e")
    pairs = hits.union(brief).distinct()
    text = texts.select("sid", "seq")
    both = pairs.join(text.select(F.col("sid").alias("t"), F.col("seq").alias("ts")), "t").join(text.select(F.col("sid").alias("e"), F.col("seq").alias("es")), "e")
    near = both.where("levenshtein(ts, es, cast(" + allowed.format("length(ts)", "length(es)") + " AS int)) >= 0").select("t", "e")
    return near.union(texts.where("train AND eval").select(F.col("sid").alias("t"), F.col("sid").alias("e")))


def read_records(train: DataFrame, evaluation: DataFrame, row: str, name: str, sequence: str) -> DataFrame:
    """``r, seq, entry, train`` of both sides, written once; rows without an id are left out."""
    side = lambda df, is_train: df.select(F.col(row).cast("long").alias("r"), bare_sequence(F.col(sequence)).alias("seq"), entry_code(F.col(name)).alias("entry"), F.lit(is_train).alias("train"))
    return materialize(side(train, True).union(side(evaluation, False)).where("r IS NOT NULL"), "records")


def near_classes(records: DataFrame, q: int = SHINGLE, per: int = PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """Pairs ``t, e`` of classes of equal sequences, one with a training and one with an evaluation record, that are near the same, and members ``class, r, train``.

    A class is named after its smallest record and near itself. Nulls match
    nothing, nor does a sequence of which nothing is left without white space
    and ``*``.
    """
    own = records.where("seq IS NOT NULL").select("seq", "r", "train")
    texts = materialize(own.groupBy("seq").agg(F.min("r").alias("sid"), F.max("train").alias("train"), (~F.min("train")).alias("eval")), "texts")
    members = own.join(texts.select("seq", "sid"), "seq").select(F.col("sid").alias("class"), "r", "train")
    return near_sequences(texts, q, per), members


def entry_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for records that name one entry: a class is an entry that both sides name."""
    members = records.where("entry IS NOT NULL").select(F.col("entry").alias("class"), "r", "train")
    both = members.groupBy("class").agg(F.min("train").alias("a"), F.max("train").alias("b")).where("a <> b")
    return both.select(F.col("class").alias("t"), F.col("class").alias("e")), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b`` (a < b): all records of paired classes."""
    left = members.where("train").select(F.col("class").alias("t"), F.col("r").alias("a"))
    right = members.where("NOT train").select(F.col("class").alias("e"), F.col("r").alias("b"))
    return pairs.join(left, "t").join(right, "e").select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def cross_split_pairs(train: DataFrame, evaluation: DataFrame, row: str, name: str, sequence: str, q: int = SHINGLE, per: int = PER_EDIT) -> DataFrame:
    """``row_id_a, row_id_b`` (a < b): a training and an evaluation record with near-same sequences, or that name the same entry."""
    records = read_records(train, evaluation, row, name, sequence)
    return expand(*near_classes(records, q, per)).union(expand(*entry_classes(records))).distinct()


def overlapping(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``r``: evaluation records whose class is paired; no pair of records is formed."""
    return members.where("NOT train").join(pairs.select(F.col("e").alias("class")).distinct(), "class", "left_semi").select("r")


def overlap_report(hits: DataFrame, evaluation: DataFrame, row: str, split: str, source: str) -> DataFrame:
    """``split, source, records, overlapping`` of the evaluation records; sources trimmed and lower-case, null kept as a source. hits: ``r``."""
    ids = hits.distinct().withColumn("hit", F.lit(1))
    rows = evaluation.select(F.col(row).cast("long").alias("r"), F.col(split).alias("split"), F.lower(F.trim(F.col(source))).alias("source")).where("r IS NOT NULL").dropDuplicates(["r"])
    return rows.join(ids, "r", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))

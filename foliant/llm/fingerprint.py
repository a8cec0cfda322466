"""Quartile-bucket digests of whole texts and a bounded score of how alike two digests are.

A window of five bytes runs over the UTF-8 text; each of its TRIPLETS is hashed into one of BUCKETS counters. The digest
codes each counter by the quartile of the text's counters that it falls in (two bits), after two hexadecimal digits for
the logarithm of the length. Equal texts have equal digests. The difference of two digests is the sum of quartile
distances plus a bounded share for the length; likeness is 1 less the difference over its greatest value.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_in
from foliant.llm.kernels import BYTE, mix

BUCKETS = 256
# Places of the bytes of each triplet in the window.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4)]
WINDOW = 5
#: Most that the length adds to a difference, and that the counters can.
LENGTH_MOST, COUNT_MOST = 3 * BUCKETS // 8, 3 * BUCKETS
#: Bytes hashed at a time; bytes of a range of documents by descending id, and ranges that a task has in the mean.
SLICE, RANGE, RANGES = 1 << 20, 1 << 24, 4
_ROLE = mix(np.arange(31, 31 + 3 * len(TRIPLETS), dtype=np.uint64)) | np.uint64(1)


def counts(data: np.ndarray) -> np.ndarray:
    """Counters of a text's bytes; a text shorter than a window counts as one window padded with zeros."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    if 0 < len(data) < WINDOW:
        data = np.pad(data, (0, WINDOW - len(data)))
    for at in range(0, len(data) - WINDOW + 1, SLICE):
        value = BYTE[data[at : at + SLICE + WINDOW - 1]]
        n = len(value) - WINDOW + 1
        for t, (i, j, k) in enumerate(TRIPLETS):
            key = value[i : i + n] * _ROLE[3 * t] + value[j : j + n] * _ROLE[3 * t + 1] + value[k : k + n] * _ROLE[3 * t + 2]
            total += np.bincount((key >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    """Hexadecimal digest of a text; null counts as empty."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = counts(data)
    rank = np.sort(total)
    edges = rank[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (total[:, None] > edges).sum(axis=1).astype(np.uint8)
    length = min(255, int(round(16 * np.log2(1 + len(data)) / 2)))
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return f"{length:02x}{packed.tobytes().hex()}"


_PAIR = np.array([sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for a in range(256) for b in range(256)], dtype=np.int64)


def likeness(x: str, y: str) -> float:
    """1 for equal digests down to 0; symmetric."""
    a, b = np.frombuffer(bytes.fromhex(x), dtype=np.uint8), np.frombuffer(bytes.fromhex(y), dtype=np.uint8)
    count = int(_PAIR[a[1:].astype(np.int64) * 256 + b[1:]].sum())
    length = min(LENGTH_MOST, 4 * abs(int(a[0]) - int(b[0])))
    return 1.0 - (count + length) / (COUNT_MOST + LENGTH_MOST)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_column(text: str = "text"):
    """The digest of a text column, as a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return run(F.coalesce(F.col(text), F.lit("")))


def compare_with_next(docs: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Digests of each document (doc_id, text), of its edited text, and their likeness; next: the next lower doc_id.

    The last floor(n_chars / 2) code points of the edited text are the first of the next document's; after the last
    comes the first, which is also a lone document's next. Null texts count as empty; null ids come last, and rows
    with one id follow each other by a hash of their text. Other columns are ignored; an empty table gives an empty
    table.

    Documents lie in ranges of about `range_bytes` by descending id, however many share an id, and sorted in each. A
    range needs one row of the next, its first: those rows, one per range, are found from ids and hashes alone and
    dealt a second time.
    """
    rows = docs.select(id_in(), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = Ranges.of(rows, least, range_bytes)
    firsts = rows.groupBy(ranges.place().alias("place")).agg(F.min(F.struct("no_id", F.bitwise_not("doc_id").alias("order"), "hash")).alias("first")).collect()
    before = ranges.before(firsts)
    dealt = (
        rows.withColumn("place", ranges.place())
        .withColumn("places", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("borrowed"), "place"), before))))
        .select("no_id", "doc_id", "text", "hash", "places.borrowed", "places.place")
        .repartition(max(least, ranges.count // RANGES), "place")
        .sortWithinPartitions("place", "borrowed", "no_id", F.desc("doc_id"), "hash", "text")
    )
    schema = "no_id boolean, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = dealt.select("place", "borrowed", "no_id", "doc_id", "text").mapInPandas(_compare, schema)
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


class Ranges:
    """Ranges of (id descending, nulls last, hash): an id that fills several has them by equal shares of its hashes.

    Holds two numbers per range; ranges grow with the bytes of the table, one for each 16 MB.
    """

    def __init__(self, bounds: list[int]):
        often = Counter(bounds) or Counter([0])
        self.edge = sorted(often, reverse=True)
        self.many = np.array([often[e] for e in self.edge])
        self.start = np.cumsum(self.many) - self.many
        self.count = int(self.many.sum()) + 1  # null ids have ranges of their own behind the others
        self.nulls = 1

    @staticmethod
    def of(rows: DataFrame, least: int, range_bytes: int) -> Ranges:
        sums = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count_if("no_id").alias("nulls")).first()
        parts = max(least, -(-(sums["bytes"] or 0) // range_bytes))
        own = max(1, round(parts * (1 - sums["nulls"] / max(1, sums["n"]))))
        cuts = ", ".join(str(k / own) for k in range(1, own + 1))
        found = rows.where("not no_id").agg(F.expr(f"approx_percentile(doc_id, array({cuts}), {min(1_000_000, 100 * own + 10_000)})").alias("cuts")).first()["cuts"]
        out = Ranges(list(found or []))
        out.nulls = max(1, round(parts * sums["nulls"] / max(1, sums["n"])))
        out.count += out.nulls - 1
        return out

    def places(self, doc_id: np.ndarray, no_id: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        edge = np.array(self.edge[::-1], dtype=np.int64)  # rising
        at = len(edge) - 1 - np.minimum(np.searchsorted(edge, doc_id), len(edge) - 1)
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        many = self.many[at]
        within = np.where(doc_id == np.array(self.edge, dtype=np.int64)[at], np.minimum(many - 1, (share * many).astype(np.int64)), many - 1)
        first_null = int(self.many.sum())
        return np.where(no_id, first_null + np.minimum(self.nulls - 1, (share * self.nulls).astype(np.int64)), self.start[at] + within)

    def place(self):
        ranges = self

        @F.pandas_udf("int")
        def run(doc_id: pd.Series, no_id: pd.Series, hashes: pd.Series) -> pd.Series:
            return pd.Series(ranges.places(doc_id.to_numpy(), no_id.to_numpy(), hashes.to_numpy()).astype(np.int32))

        return run("doc_id", "no_id", "hash")

    def before(self, firsts: list):
        """For the first row of a range: the range before it that has rows; null for others."""
        found = sorted((r["place"], r["first"]) for r in firsts)
        previous = {p: found[i - 1][0] for i, (p, _) in enumerate(found)}
        first = {p: (f["no_id"], ~f["order"], f["hash"]) for p, f in found}

        @F.pandas_udf("int")
        def run(doc_id: pd.Series, no_id: pd.Series, hashes: pd.Series, place: pd.Series) -> pd.Series:
            rows = zip(place, no_id, doc_id, hashes, strict=True)
            return pd.Series([previous[p] if first[p] == (n, d, h) else None for p, n, d, h in rows], dtype="Int32")

        at = run("doc_id", "no_id", "hash", "place")
        return F.when(at.isNotNull(), F.struct(F.lit(1).alias("borrowed"), at.alias("place")))


def _compare(batches):
    previous = None  # (place, no_id, doc_id, text, digest) of the row that waits for its next

    def row(no_id, doc_id, text, mark, following, following_mark):
        change = edited(text, following)
        print_ = digest(change)
        sha = hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest()
        return no_id, doc_id, len(text), sha, mark, print_, likeness(mark, print_), likeness(mark, following_mark)

    names = ["no_id", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for place, borrowed, no_id, doc_id, text in zip(*(batch[c] for c in ("place", "borrowed", "no_id", "doc_id", "text")), strict=True):
            if borrowed and (previous is None or previous[0] != place):
                continue  # rows equal to a borrowed one follow it; only the first is anybody's next
            mark = digest(text)
            if previous is not None:
                out.append(row(*previous[1:], text, mark))
            previous = None if borrowed else (place, no_id, doc_id, text, mark)
        yield pd.DataFrame(out, columns=names)

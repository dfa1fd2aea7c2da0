"""The same or nearly the same record in different splits: segmented code blocks, bit fingerprints, verification.

Texts are compared by their letter skeletons, each distinct one once, with at most one letter in ten different.
A train text of ``n`` letters below ``EVEN_BELOW`` is cut into ``n/9 + 1`` even code blocks; whatever the
``n/9`` possible differences are, one block stands intact in the other text, shifted by no more than the
differences before it, so a held-out text asks for its blocks at those places only and every pair shares a key.
Longer texts, which have more intact stretches, are cut at content-defined places; their keys are ordered pairs of
blocks that stand near each other, so keys grow in proportion to a text's length.  Candidates within the
Hamming radius of the texts' 128-bit SimHashes go to an edit distance, which decides.  Blocks of the SimHash
itself fail as keys: a tenth of the letters changed flips about a quarter of the bits, and blocks short enough
to survive that are shared by every other text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.characters import letter_skeleton, per_distinct
from codexlake.runtime import durable, table

MIN_LETTERS = 20
MAX_CHANGED = 0.1
#: Hamming radius of the 128-bit SimHash; a tenth of the letters changed moves about 32 bits, give or take 5.
RADIUS = 54
#: Train texts of fewer letters have even blocks, others content-defined ones.
EVEN_BELOW = 121
#: Half-widths of the windows in which a trigram hash must be least to end a content-defined block.
WIDTHS = (3, 2)
#: Pairs of content-defined blocks are formed up to this distance.
REACH = 5

_M1, _M2, _M3, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x2545F4914F6CDD1D))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _inverse(x: int) -> int:
    return pow(int(x), -1, 2**64)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed letters of all texts in a row, the text of each letter, its place in it, and trigram hashes with where they are whole."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n)
    mixed = _mix(letters * _M1)
    grams = np.full(len(letters), _TOP)
    inside = place + 2 < n[row] if len(row) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    grams[at] = _mix(mixed[at] * _M1 + mixed[at + 1] * _M2 + mixed[at + 2] * _M3)
    return mixed, row, place, grams, inside


#: Texts of more trigrams than this have their bits counted one text at a time.
COUNTED_TOGETHER = 1024


def simhashes(texts: list[str]) -> np.ndarray:
    """SimHash of the letter trigrams of each text, as two words of 64 bits.

    The bits of all texts are counted side by side, trigram by trigram, in binary counters that lie in planes: plane
    ``k`` of a text holds bit ``k`` of the 64 counts.
    """
    _, row, _, grams, inside = _flat(texts)
    at = np.flatnonzero(inside)
    counts = np.bincount(row[at], minlength=len(texts))
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    long = order[counts[order] > COUNTED_TOGETHER]
    order = order[(counts[order] > 0) & (counts[order] <= COUNTED_TOGETHER)]
    n, out = counts[order], np.zeros((len(texts), 2), dtype=np.int64)
    for half, hashes in enumerate((grams[at], _mix(grams[at] + _M1))):
        planes: list[np.ndarray] = []
        for j in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -j, side="left"))
            carry = hashes[start[order[:m]] + j]
            if (j + 1).bit_length() > len(planes):
                planes.append(np.zeros(len(order), dtype=np.uint64))
            for plane in planes:
                plane[:m], carry = plane[:m] ^ carry, plane[:m] & carry
        # A bit is set where its count is above half of the trigrams.
        above, level = np.zeros(len(order), dtype=np.uint64), np.full(len(order), _TOP)
        for k in range(len(planes) - 1, -1, -1):
            limit = np.where(n // 2 >> k & 1, _TOP, np.uint64(0))
            above |= level & planes[k] & ~limit
            level &= ~(planes[k] ^ limit)
        out[order, half] = above.view(np.int64)
        for i in long:
            bits = np.unpackbits(hashes[start[i] : start[i] + counts[i]].view(np.uint8).reshape(-1, 8), axis=1)
            out[i, half] = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > counts[i]).view(np.uint64).view(np.int64)[0]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = np.full(n + 1, _BASE), np.full(n + 1, np.uint64(_inverse(int(_BASE))))
    power[0] = back[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(back)


def _most(n: int) -> int:
    """Differences that a text of ``n`` letters may have with a longer one."""
    return n // 9


@lru_cache(maxsize=None)
def _even(n: int) -> list[tuple[int, int]]:
    """Start and length of the even blocks of a train text of ``n`` letters."""
    cuts = [n * i // (_most(n) + 1) for i in range(_most(n) + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=None)
def _asked(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and tags of the stretches in which a held-out text of ``n`` letters looks for blocks.

    For each length of a train text within reach and each of its blocks: before the block lie no more
    differences than blocks, or, seen from the end, after it no more than the remaining ones.
    """
    out = []
    for train in range(n - n // 10, EVEN_BELOW):
        if train - n > train // 10:
            break
        most = max(train, n) // 10
        # One block more than there may be differences is enough.
        for i, (start, length) in enumerate(_even(train)[: most + 1]):
            after = most - i
            low = max(0, start - min(i, most), start + n - train - after)
            high = min(n - length, start + min(i, most), start + n - train + after)
            out += [(p, length, train * 64 + i) for p in range(low, high + 1)]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


@lru_cache(maxsize=None)
def _held(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and tags of the blocks of a train text of ``n`` letters."""
    return tuple(np.array(x, dtype=np.int64) for x in zip(*[(s, k, n * 64 + i) for i, (s, k) in enumerate(_even(n))], strict=True))


def even_keys(texts: list[str], of: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and key of each even block (``of`` is ``_held``) or of each stretch looked at (``_asked``)."""
    rows, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        start, length, tag = of(int(n))
        if len(start):
            letters = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64).reshape(len(at), n)
            power, back = _powers(int(n))
            sums = np.concatenate([np.zeros((len(at), 1), dtype=np.uint64), np.cumsum(_mix(letters * _M1) * power[:-1], axis=1, dtype=np.uint64)], axis=1)
            codes = (sums[:, start + length] - sums[:, start]) * back[start]
            keys.append(_mix(codes * _M2 + _mix(tag.astype(np.uint64) * _M3)).view(np.int64).ravel())
            rows.append(np.repeat(at, len(start)))
    return np.concatenate(rows), np.concatenate(keys)


def paired_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, key, and places (two halves of a word) of each pair of content-defined blocks."""
    mixed, row, place, grams, inside = _flat(texts)
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    power, back = _powers(max((len(t) for t in texts), default=0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[place], dtype=np.uint64)])
    for width in WIDTHS if len(mixed) else ():
        least = inside.copy()
        for k in range(1, width + 1):
            same = row[k:] == row[:-k]
            least[:-k] &= ~same | (grams[:-k] <= grams[k:])
            least[k:] &= ~same | (grams[k:] < grams[:-k])
        begin = place == 0
        begin[1:] |= least[:-1] & (row[1:] == row[:-1])
        heads = np.flatnonzero(begin)
        ends = np.concatenate([heads[1:], [len(mixed)]])
        codes = _mix((sums[ends] - sums[heads]) * back[place[heads]] + (ends - heads).astype(np.uint64) * _M1)
        owner = row[heads]
        for gap in range(REACH + 1):
            a = np.arange(max(0, len(heads) - gap))
            # A text of a single block is its own pair.
            kept = np.bincount(owner)[owner] == 1 if gap == 0 else owner[a] == owner[a + gap]
            a = a[kept]
            key = _mix(codes[a] * _M1 + _mix(codes[a + gap] + np.uint64(width)) * _M2).view(np.int64)
            out.append((owner[a], key, place[heads[a]] << 32 | place[heads[a + gap]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def split_of(column: str) -> Column:
    """``train``, ``val`` or ``test`` of a delivered split; null for null and unknown spellings."""
    plain = F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(plain.isin("train", "training"), "train").when(plain.isin("val", "valid", "validation"), "val").when(plain == "test", "test")


def _skeletons(texts: pd.Series) -> pd.Series:
    return per_distinct(texts, letter_skeleton)


def _keyed(texts: DataFrame, train: bool) -> DataFrame:
    """``key``, ``text_id``, ``places`` of one side of the join."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, given, n = batch["text_id"].to_numpy(), batch["skeleton"].to_numpy(), batch["skeleton"].str.len().to_numpy()
            # A held-out text may be a tenth shorter or longer than its train text.
            even = np.flatnonzero(n < EVEN_BELOW if train else n <= EVEN_BELOW * 10 // 9)
            paired = np.flatnonzero(n >= EVEN_BELOW if train else n >= EVEN_BELOW - EVEN_BELOW // 9)
            row, key = even_keys(list(given[even]), _held if train else _asked)
            yield pd.DataFrame({"key": key, "text_id": ids[even][row], "places": np.int64(0)})
            for s in range(0, len(paired), 1000):
                part = paired[s : s + 1000]
                row, key, places = paired_keys(list(given[part]))
                yield pd.DataFrame({"key": key, "text_id": ids[part][row], "places": places})

    return texts.select("text_id", "skeleton").mapInPandas(keys, "key bigint, text_id bigint, places bigint")


def _simhash(column: str) -> Column:
    def words(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(simhashes(list(texts)), columns=["a", "b"])

    return F.pandas_udf(words, "a bigint, b bigint")(column)


def near_links(texts: DataFrame) -> DataFrame:
    """Links ``train_id``, ``eval_id`` between different texts: at most one letter in ten differs.

    ``texts``: ``text_id``, ``skeleton``, ``sim``, ``in_train``, ``in_eval``, one row for each distinct skeleton, so
    groups of copies, however large, count once.  Keys hold the length of the text and the number of the
    block, so a formula that many texts share is spread over both; a key that is hot all the same is split by
    the skew handling of the sort-merge join, which has no outer side and may divide either.
    """
    t = _keyed(texts.where("in_train"), True).select("key", F.col("text_id").alias("train_id"), F.col("places").alias("t"))
    e = _keyed(texts.where("in_eval"), False).select("key", F.col("text_id").alias("eval_id"), F.col("places").alias("e"))
    # Places are within a tenth of the longer text, whose length is known only later: a bound by the place itself.
    low = F.lit(2**32 - 1)
    p, q = F.shiftright("t", 32) - F.shiftright("e", 32), F.col("t").bitwiseAND(low) - F.col("e").bitwiseAND(low)
    drift = F.abs(p - q) <= 2 + F.abs(F.shiftright("t", 32) - F.col("t").bitwiseAND(low)) / 2
    candidates = t.join(e.hint("merge"), "key").where((F.col("train_id") != F.col("eval_id")) & drift).select("train_id", "eval_id").distinct()
    words = texts.select("text_id", "skeleton", "sim")
    a, b = (words.select(F.col("text_id").alias(f"{side}_id"), F.col("skeleton").alias(name), F.col("sim").alias(f"{name}_sim")) for side, name in (("train", "a"), ("eval", "b")))
    held = candidates.join(a, "train_id").join(b, "eval_id")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * MAX_CHANGED).cast("int")
    alike = F.bit_count(F.col("a_sim.a").bitwiseXOR(F.col("b_sim.a"))) + F.bit_count(F.col("a_sim.b").bitwiseXOR(F.col("b_sim.b"))) <= RADIUS
    held = held.withColumn("most", most).where((F.abs(F.length("a") - F.length("b")) <= F.col("most")) & alike)
    return held.where(F.expr("levenshtein(a, b, most) >= 0")).select("train_id", "eval_id")


def text_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a split and enough letters (``row_id``, ``split``, ``digest``), and their distinct texts.

    Texts are told apart by a digest of 128 bits and numbered anew, so no two share an id.
    """
    skeleton = F.pandas_udf(_skeletons, "string")
    read = rows.select("row_id", split_of("split").alias("split"), "text").where(F.col("split").isNotNull() & F.col("text").isNotNull() & F.col("row_id").isNotNull())
    members = read.select("row_id", "split", skeleton("text").alias("skeleton"))
    members = members.where(F.length(F.regexp_replace("skeleton", r"\p{N}", "")) >= MIN_LETTERS)
    members = durable(members.withColumn("digest", F.unhex(F.md5("skeleton"))))
    texts = members.groupBy("digest").agg(F.min("skeleton").alias("skeleton"), F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))
    return members, durable(texts.withColumns({"text_id": F.monotonically_increasing_id(), "sim": _simhash("skeleton")}))


def class_links(texts: DataFrame) -> DataFrame:
    """``train_digest``, ``eval_digest``, ``same``: linked texts, a text in both splits with itself."""
    own = texts.select("text_id", "digest")
    links = near_links(texts).join(own.select(F.col("text_id").alias("train_id"), F.col("digest").alias("train_digest")), "train_id").join(own.select(F.col("text_id").alias("eval_id"), F.col("digest").alias("eval_digest")), "eval_id")
    same = texts.where("in_train and in_eval").select(F.col("digest").alias("train_digest"), F.col("digest").alias("eval_digest"), F.lit(True).alias("same"))
    return links.select("train_digest", "eval_digest", F.lit(False).alias("same")).unionByName(same)


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a train row and a val or test row with the same or nearly the same text.

    ``rows``: ``row_id``, ``split``, ``text`` and any other columns.  Returns ``train_row``, ``eval_row``,
    ``eval_split`` and ``same`` (equal skeletons).  Rows with a null split, text or id, and texts with fewer
    than 20 letters give nothing; digits count as letters when texts are compared; texts of any length are
    compared whole; an empty table gives an empty result.
    """
    members, texts = text_classes(rows)
    train = members.where("split = 'train'").select(F.col("digest").alias("train_digest"), F.col("row_id").alias("train_row"))
    held = members.where("split <> 'train'").select(F.col("digest").alias("eval_digest"), F.col("row_id").alias("eval_row"), F.col("split").alias("eval_split"))
    return class_links(texts).join(train, "train_digest").join(held, "eval_digest").select("train_row", "eval_row", "eval_split", "same")


def overlap_counts(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``eval_split``, ``source``, ``n_pairs``, ``n_rows``, ``n_same_text``: overlaps with train, from the sizes of the classes.

    ``source``: ``row_id``, ``source``; rows without one count under null.  No pair of rows is formed.
    """
    members, texts = text_classes(rows)
    train = members.where("split = 'train'").groupBy(F.col("digest").alias("train_digest")).agg(F.count(F.lit(1)).alias("n_train"))
    linked = class_links(texts).join(train, "train_digest").groupBy(F.col("eval_digest").alias("digest")).agg(F.sum("n_train").alias("n_train"), F.max("same").alias("same"))
    held = members.where("split <> 'train'").select("row_id", "digest", F.col("split").alias("eval_split")).join(source.select("row_id", "source"), "row_id", "left")
    held = held.groupBy("digest", "eval_split", "source").agg(F.count(F.lit(1)).alias("n"))
    return held.join(linked, "digest").groupBy("eval_split", "source").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_rows"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("n_same_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, sf_dir, "import_rows"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b")).distinct()


_SPLIT_SQL = "CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END"
SAME_TEXT_SQL = f"""
WITH r AS (SELECT row_id, {_SPLIT_SQL} AS s, text FROM import_rows WHERE text IS NOT NULL AND row_id IS NOT NULL), t AS (SELECT text, count(*) FILTER (WHERE s = 'train') AS n_train, count(*) FILTER (WHERE s <> 'train') AS n_held FROM r WHERE s IS NOT NULL GROUP BY 1)
SELECT text, n_train, n_held FROM t WHERE n_train > 0 AND n_held > 0 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= {MIN_LETTERS + 4}
"""


def p4_same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 24 letters or more that occur letter for letter in train and in val or test, with their rows on either side.

    The classes come from the operator's links of equal skeletons; a class whose rows differ in spelling gives each spelling
    that stands on both sides.
    """
    rows = table(spark, sf_dir, "import_rows")
    members, texts = text_classes(rows)
    both = texts.where("in_train AND in_eval").select("digest")
    spelled = members.join(both, "digest", "left_semi").join(rows.select("row_id", "text"), "row_id")
    counts = spelled.groupBy("text").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") != "train").alias("n_held"))
    return counts.where((F.col("n_train") > 0) & (F.col("n_held") > 0) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= MIN_LETTERS + 4))


def p4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap per held-out split and source (the codex in the image reference): pairs, and rows that have any.

    Rows whose reference names no known manuscript count under a null source.
    """
    from codexlake.llm.grouped_split import codex_of_rows  # that module reads splits by this one

    rows = table(spark, sf_dir, "import_rows")
    return overlap_counts(rows, codex_of_rows(rows, table(spark, sf_dir, "release_lines")).select("row_id", F.col("codex").alias("source")))

"""Mixing sources to target weights: token quotas with capped repeats, interleaved by Pfair scheduling.

Each source is a stream of blocks of equal token count.  In a frame of slots, block ``k`` of a source with
weight ``w`` is released at slot ``floor(k/w)`` and due by ``ceil((k+1)/w)``; the earliest deadline among the
released blocks goes first, which keeps every source within one block of its share at any point.  A frame is
planned once and repeated, so the plan's size depends on the number of sources, not on the data.  A document
runs on from block to block of its source, so every block holds exactly its tokens.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Mapping
from functools import lru_cache
from math import ceil

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators.prefix import prefix_sum
from codexlake.runtime import durable, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 4096
#: Slots of a frame: at least this many, and more if a share is smaller than one slot.
MIN_FRAME, MAX_FRAME = 1_000, 200_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(column: str, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of a text; null stays null, the empty text has none.

    The vocabulary is the file that ``ship`` has sent to the executors, else the one at the same path there.
    """

    def count(texts: pd.Series) -> pd.Series:
        shipped = SparkFiles.get(os.path.basename(tokenizer))
        encode = _encoding(shipped if os.path.exists(shipped) else tokenizer).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t is not None else None).astype("Int64")

    return F.pandas_udf(count, "bigint")(column)


def ship(spark: SparkSession, tokenizer: str = TOKENIZER) -> None:
    """Send the vocabulary file to all executors."""
    spark.sparkContext.addFile(tokenizer)


def frame_counts(shares: Mapping[str, float]) -> tuple[int, dict[str, int]]:
    """Slots of a frame and blocks of each source in it, by largest remainder; every source gets at least one."""
    frame = min(MAX_FRAME, max(MIN_FRAME, ceil(1 / min(shares.values()))))
    exact = {s: w * frame for s, w in shares.items()}
    counts = {s: int(x + 1e-9) for s, x in exact.items()}
    if min(counts.values()) < 1:
        raise ValueError(f"a share is smaller than a slot of the largest frame, 1/{MAX_FRAME}")
    for s in sorted(exact, key=lambda s: (counts[s] - exact[s], s))[: frame - sum(counts.values())]:
        counts[s] += 1
    return frame, counts


def pfair_plan(counts: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, slot)`` of one frame: earliest deadline first among the released blocks."""
    frame = sum(counts.values())
    waiting = [(0, s, 0) for s in sorted(counts) if counts[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    plan = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * frame // counts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        plan.append((s, k, slot))
        if k + 1 < counts[s]:
            heapq.heappush(waiting, ((k + 1) * frame // counts[s], s, k + 1))
    return plan


def largest_total(sizes: Mapping[str, int], targets: Mapping[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The largest mixture that meets all shares within the caps, and the shares it uses.

    Sources without a target or of share 0 are left out; a target whose source holds no tokens can't be met,
    and its share goes to the others in proportion.
    """
    usable = {s: w for s, (w, cap) in targets.items() if w > 0 and cap > 0 and sizes.get(s, 0) > 0}
    whole = sum(usable.values())
    shares = {s: w / whole for s, w in usable.items()}
    return min((sizes[s] * targets[s][1] / shares[s] for s in shares), default=0.0), shares


def counted(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of the documents whose source has a target."""
    wanted = targets.where("source IS NOT NULL AND target_share > 0").select("source").distinct()
    ship(docs.sparkSession, tokenizer)
    read = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("source").isNotNull()).select("doc_id", "source", "text")
    return durable(read.join(wanted, "source", "left_semi").select("doc_id", "source", count_tokens("text", tokenizer).alias("n_tokens")).where("n_tokens > 0"))


def mix(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture in pieces of documents: ``slot``, ``slot_offset``, ``source``, ``doc_id``, ``repeat``, ``token_start``, ``n_tokens``.

    ``tokens``: ``doc_id``, ``source``, ``n_tokens``; ``targets``: ``source``, ``target_share``, ``max_repeats``,
    a small table by nature.  Ordered by ``slot`` and ``slot_offset`` the rows are the mixed stream; a document
    that passes the end of a block goes on in its source's next one, and a source's last document is cut at its
    quota, so after any slot every source is within one block of its share.  Without ``total_tokens`` the mixture
    is the largest that meets every share within the caps; with it, a source too small for its quota gives all it
    may, ``max_repeats`` times each document.  Documents follow in a seeded order that differs from pass to pass.
    Null sources, shares and sizes count as absent; empty tables give an empty mixture.
    """
    tokens = tokens.select("doc_id", "source", "n_tokens").where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0")
    aims: dict[str, tuple[float, int]] = {}
    for r in targets.where("source IS NOT NULL AND target_share > 0").select("source", "target_share", "max_repeats").distinct().orderBy("source").limit(MAX_FRAME + 1).collect():
        if r.source in aims:
            raise ValueError(f"two targets for {r.source}")
        aims[r.source] = (r.target_share, r.max_repeats if r.max_repeats is not None else 1)
    held = tokens.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    sizes = {r.source: r.n for r in held}
    most, shares = largest_total(sizes, aims)
    spark = tokens.sparkSession
    if not shares:
        return tokens.select(F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("slot_offset"), "source", "doc_id", F.lit(0).alias("repeat"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens").where(F.lit(False))
    total = most if total_tokens is None else float(total_tokens)
    frame, counts = frame_counts(shares)
    rows = [(s, float(sizes[s]), total * w, min(aims[s][1], ceil(total * w / sizes[s] - 1e-9)), counts[s]) for s, w in sorted(shares.items())]
    quotas = spark.createDataFrame(rows, "source string, size double, quota double, passes int, per_frame int")
    plan = spark.createDataFrame(pfair_plan(counts), "source string, block_in_frame int, slot_in_frame int")

    copies = tokens.join(F.broadcast(quotas), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), "passes")))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "repeat"))
    placed = prefix_sum(copies, ["source", "repeat"], "h", "n_tokens", "before", max(r.docs for r in held)).withColumn("at", F.col("before") + (F.col("repeat") - 1) * F.col("size").cast("bigint"))
    placed = placed.withColumn("quota", F.round("quota").cast("bigint")).where("at < quota").withColumn("end", F.least(F.col("at") + F.col("n_tokens"), F.col("quota")))
    first, last = (F.floor(x / BLOCK_TOKENS) for x in (F.col("at"), F.col("end") - 1))
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start, stop = F.greatest("at", F.col("block") * BLOCK_TOKENS), F.least("end", (F.col("block") + 1) * BLOCK_TOKENS)
    frame_of = F.floor(F.col("block") / F.col("per_frame"))
    pieces = pieces.select("source", "doc_id", "repeat", (start - F.col("at")).alias("token_start"), (stop - start).alias("n_tokens"), (start % BLOCK_TOKENS).alias("slot_offset"), frame_of.alias("frame"), (F.col("block") - frame_of * F.col("per_frame")).cast("int").alias("block_in_frame"))
    return pieces.join(F.broadcast(plan), ["source", "block_in_frame"]).select((F.col("frame") * frame + F.col("slot_in_frame")).alias("slot"), "slot_offset", "source", "doc_id", "repeat", "token_start", "n_tokens")


def share_report(mixture: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source that has a target or tokens, with its use of documents."""
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("repeat").alias("most_repeats"))
    held = tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    whole = F.sum("mixed_tokens").over(_everything())
    report = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").join(held, "source", "left").join(used, "source", "left")
    return report.select("source", "target_share", F.coalesce(F.round(F.col("mixed_tokens") / whole, 6), F.lit(0.0)).alias("actual_share"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")


def _everything():  # noqa: ANN202
    """One window over the report, which has a row for each target."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix(counted(table(spark, sf_dir, "documents"), targets), targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    tokens = counted(table(spark, sf_dir, "documents"), targets)
    return share_report(mix(tokens, targets), tokens, targets)


def p8_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by a mixture as large as the corpus, where small sources run into their caps."""
    targets = table(spark, sf_dir, "mix_targets")
    tokens = counted(table(spark, sf_dir, "documents"), targets)
    return share_report(mix(tokens, targets, tokens.agg(F.sum("n_tokens")).first()[0] or 0), tokens, targets)

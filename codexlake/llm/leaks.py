"""Evaluation passages leaking into a corpus: latent semantic candidates, then common-subsequence checks.

Passages and documents are reduced to letters (no case, accents, punctuation, breaks or hyphens).  Passages
are TF-IDF vectors over letter n-grams, with document frequencies counted over the whole corpus.  A randomised
SVD of the passages, whose matrix products run over partitions of the terms, gives the latent space; every
document is cut into overlapping windows, which are projected onto it, and windows whose cosine with a passage
is high enough are candidates.  A candidate is a leak if a common subsequence in one place holds half of the
passage; a paraphrase is a candidate of high cosine that has half of the passage's words in order and half of
its answers (numbers and names).

Passages are a stated query set, taken in blocks of ``BLOCK``; a block and what is derived from it travel to
the executors and have a size of their own, whatever the number of passages.  Documents are never shuffled,
and no pair of document and passage is formed that is no candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.characters import letter_skeleton
from codexlake.runtime import durable, release, table

GRAM = 5
#: Fewest letters of a passage that is searched for.
MIN_LETTERS = 2 * GRAM
#: A window is two cells of this many letters; windows overlap by one cell.
CELL = 120
RANK = 200
OVERSAMPLE = 16
POWER_ROUNDS = 2
#: Least share of the passage that makes a leak.
MIN_SHARE = 0.5
#: N-grams of more passages than this are stock phrases and no features, unless a passage would lose half of its own.
MAX_ITEMS = 2
#: Share of half a passage's n-grams that must match near one offset before subsequences are compared: with a
#: tenth of the letters wrong, 0.9**GRAM = 59 % still match.
MIN_DENSITY = 0.4
#: Letters that may be missing or strange between two matches in one place, and drift of their offset.
GAP, DRIFT = 30, 24
#: Least cosine of a paraphrase, and least share of the passage's words in order and of its answers.
SAME_MEANING, MIN_WORDS, MIN_ANSWERS = 0.15, 0.5, 0.5
#: Letters handled at once; longer documents go piece by piece with an overlap longer than any passage.
PIECE = 400_000
#: Passages searched for in one reading of the documents; more go block by block.
BLOCK = 256
_BITS, _SIEVE = 22, 16

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Folded base letter of each code point of the basic plane, 0 where nothing is left."""
    if not _FOLD:
        out = np.zeros(0x10000, dtype=np.uint32)
        for code in range(0x10000):
            if not 0xD800 <= code < 0xE000 and (bare := letter_skeleton(chr(code))):
                out[code] = ord(bare[0])
        _FOLD.append(out)
    return _FOLD[0]


def letters_of(text: str) -> np.ndarray:
    """Folded base letters and digits of a text as code points; letters that expand keep their first part."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table_ = _fold_table()
    if len(codes) and codes.max() >= 0x10000:
        folded = np.where(codes < 0x10000, table_[np.minimum(codes, 0xFFFF)], codes)
    else:
        folded = table_[codes]
    return folded[folded > 0]


def grams_of(letters: np.ndarray) -> np.ndarray:
    """64-bit hash of the n-gram that begins at each letter."""
    n = len(letters) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = letters.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, GRAM):
        h = h * _M1 + wide[k : k + n]
    h ^= h >> np.uint64(31)
    h *= _M2
    return h ^ (h >> np.uint64(29))


class Passages:
    """The evaluation passages as letters and n-grams, with a bitmap over the n-grams for a quick first look."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        kept = [(i, x) for i, t in zip(ids, texts, strict=True) if len(x := letters_of(t)) >= MIN_LETTERS]
        self.texts = dict(zip(ids, texts, strict=True))
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        self.letters = [x for _, x in kept]
        self.grams = [grams_of(x) for x in self.letters]
        own = [np.unique(g) for g in self.grams]
        terms, items = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        kept = items <= MAX_ITEMS
        for g in own:
            at = np.searchsorted(terms, g)
            if kept[at].sum() < len(at) / 2:
                kept[at[np.argsort(items[at], kind="stable")[: -(-len(at) // 2)]]] = True
        self.vocabulary = terms[kept]
        self.terms = [np.searchsorted(self.vocabulary, g[np.isin(g, self.vocabulary)]) for g in self.grams]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.vocabulary >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams that occur in a passage, and their numbers in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, grams[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[term] == grams[at]
        return at[real], term[real]


def _pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents, or pieces of one, as letters, the document of each letter and the pieces' starts."""
    docs: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.array(docs), np.concatenate([[0], np.cumsum(lengths)])

    for d, text in enumerate(texts):
        if not text:
            continue
        letters = letters_of(text)
        for start in range(0, max(1, len(letters) - overlap), PIECE):
            part = letters[start : start + PIECE + overlap]
            if size and size + len(part) > PIECE:
                yield out()
                docs, parts, size = [], [], 0
            docs.append(d)
            parts.append(part)
            size += len(part)
    if size:
        yield out()


def document_frequencies(docs: DataFrame, passages: Passages) -> tuple[np.ndarray, int]:
    """Number of documents that hold each n-gram of the vocabulary, and number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(passages.vocabulary), dtype=np.int64)
        read = 0
        for batch in batches:
            read += len(batch)
            for letters, _, bounds in _pieces(list(batch["text"]), 0):
                at, term = passages.hits(grams_of(letters))
                piece = np.searchsorted(bounds, at, side="right") - 1
                whole = at + GRAM <= bounds[piece + 1]
                pairs = np.unique(piece[whole].astype(np.int64) * len(found) + term[whole])
                found += np.bincount(pairs % max(1, len(found)), minlength=len(found))
        terms = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(terms, -1), "n": np.append(found[terms], read)})

    rows = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(passages.vocabulary), dtype=np.int64)
    real = rows["term"].to_numpy() >= 0
    df[rows["term"].to_numpy()[real]] = rows["n"].to_numpy()[real]
    return df, int(rows["n"].to_numpy()[~real].sum())


def passage_vectors(passages: DataFrame, known: Passages, df: np.ndarray, n_docs: int) -> DataFrame:
    """The TF-IDF matrix of the passages, unit rows: ``item`` (row), ``term`` (column), ``weight``."""
    row_of = {int(i): r for r, i in enumerate(known.ids)}

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                if int(item) in row_of:
                    _, term = known.hits(grams_of(letters_of(text)))
                    terms, counts = np.unique(term, return_counts=True)
                    weight = counts * np.log((n_docs + 1.0) / (df[terms] + 0.5)).clip(0)
                    yield pd.DataFrame({"item": row_of[int(item)], "term": terms, "weight": weight / max(1e-9, float(np.sqrt((weight * weight).sum())))})

    return passages.mapInPandas(entries, "item int, term bigint, weight double")


def randomised_svd(entries: DataFrame, rows: int, rank: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Left vectors over singular values, and latent coordinates, of a sparse matrix ``item``, ``term``, ``weight``.

    A random range finder with power rounds.  The matrix lies in partitions of whole columns; each round is
    one job in which every partition multiplies its columns' part of the product and hands over a table of
    ``rows`` x (rank + oversampling) numbers.  The right vectors are the rows' sums under the first result
    and are formed where they are needed.
    """
    k = min(rank, rows)
    held = durable(entries.repartition("term"))

    def product(probe: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = [b for b in batches if len(b)]
            if frames:
                b = pd.concat(frames).sort_values("term")
                item, weight = b["item"].to_numpy(), b["weight"].to_numpy()
                begins = np.flatnonzero(np.diff(b["term"].to_numpy(), prepend=-1))
                columns = np.add.reduceat(weight[:, None] * probe[item], begins, axis=0)
                out = np.zeros((rows, probe.shape[1]))
                np.add.at(out, item, weight[:, None] * np.repeat(columns, np.diff(begins, append=len(item)), axis=0))
                yield pd.DataFrame({"part": [out.tobytes()]})

        parts = [np.frombuffer(r.part).reshape(rows, -1) for r in held.mapInPandas(part, "part binary").toLocalIterator()]
        return np.sum(parts, axis=0) if parts else np.zeros((rows, probe.shape[1]))

    probe = np.random.default_rng(seed).normal(size=(rows, min(rows, k + OVERSAMPLE)))
    for _ in range(POWER_ROUNDS):
        probe, _ = np.linalg.qr(product(probe))
    values, vectors = np.linalg.eigh(probe.T @ product(probe))
    release(held)
    best = np.argsort(values)[::-1][:k]
    best = best[values[best] > 1e-9 * max(1e-30, values.max())]
    left = probe @ vectors[:, best]
    singular = np.sqrt(values[best])
    return left / singular, left * singular


def least_cosines(passages: Passages, loads: np.ndarray, latent: np.ndarray, square: np.ndarray, strange: float) -> tuple[np.ndarray, int]:
    """Latent cosine asked of a window for each passage, and number of features asked of any window.

    Both follow from what the worst placed half of a passage still reaches in its best window, with
    ``MIN_DENSITY`` of its n-grams intact, as the later check asks, and foreign letters for the rest; so short
    passages ask for few features and long ones for many.
    """
    cosines = np.zeros(len(passages.ids))
    features = np.inf
    for i, grams in enumerate(passages.grams):
        half = -(-len(passages.letters[i]) // 2)
        # Letters of the half that its best window holds, wherever the cells begin.
        inside = half if half <= CELL else min(2 * CELL, (half + CELL) // 2)
        at, term = passages.hits(grams)
        sums = np.zeros((3, len(grams) + 1))
        for row, value in zip(sums, (loads[term] @ latent[i], square[term], 1.0), strict=True):
            row[at + 1] = value
        sums = sums.cumsum(axis=1)
        width = min(max(1, inside - GRAM + 1), len(grams))
        dot, mass, held = MIN_DENSITY * (sums[:, width:] - sums[:, :-width])
        cosines[i] = (dot / np.sqrt(np.maximum(1e-9, mass + np.maximum(0, 2 * CELL - held) * strange**2))).min()
        features = min(features, held.min())
    return cosines, max(1, int(features))


def _rows(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Rows of the common-subsequence table as bits: bit ``i`` is 0 where letter ``i`` of ``a`` adds to the length."""
    masks: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = [full]
    for c in b.tolist():
        match = rows[-1] & masks.get(c, 0)
        rows.append(((rows[-1] + match) | (rows[-1] - match)) & full)
    return rows


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    return len(a) - _rows(a, b)[-1].bit_count()


def _standing(a: np.ndarray, b: np.ndarray) -> int:
    """Letters of ``a`` in the longest common subsequence, single wrong letters between two of them included."""
    rows = _rows(a, b)
    held = np.zeros(len(a), dtype=bool)
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            held[i] = True
    held[1:-1] |= held[:-2] & held[2:]
    return int(held.sum())


def _grown(a: np.ndarray, b: np.ndarray) -> int:
    """How many letters two texts go on alike, up to the first two wrong letters in a row."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    stop = np.flatnonzero(~same[:-1] & ~same[1:])
    good = np.flatnonzero(same[: stop[0]] if len(stop) else same)
    return int(good[-1]) + 1 if len(good) else 0


def sieve_of(keys: np.ndarray) -> np.ndarray:
    """Table over the first bits of hashes that tells most n-grams a passage hasn't got."""
    out = np.zeros(1 << _SIEVE, dtype=bool)
    out[(keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    return out


def share_in_one_place(passage: np.ndarray, order: np.ndarray, keys: np.ndarray, document: np.ndarray, grams: np.ndarray, sieve: np.ndarray | None = None) -> float:
    """Largest share of the passage's letters that stands in the document in order and in one place.

    ``keys``/``order``: the passage's sorted n-grams and their places; ``sieve``: their table, for a quick first look.
    """
    places = np.arange(len(grams)) if sieve is None else np.flatnonzero(sieve[(grams >> np.uint64(64 - _SIEVE)).astype(np.int64)])
    lo = np.searchsorted(keys, grams[places], side="left")
    hi = np.searchsorted(keys, grams[places], side="right")
    k = np.repeat(np.arange(len(places)), hi - lo)
    j = places[k]
    if not len(j):
        return 0.0
    step = np.arange(len(j)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    q = order[lo[k] + step]
    offset = j - q
    by_offset = np.sort(offset)
    best = 0.0
    tried: list[int] = []
    density = np.searchsorted(by_offset, by_offset + DRIFT, side="right") - np.arange(len(by_offset))
    for at in np.argsort(-density, kind="stable"):
        low = by_offset[at]
        if density[at] < MIN_DENSITY * MIN_SHARE * len(passage):
            break
        if any(abs(low - t) <= DRIFT // 2 for t in tried):
            continue
        tried.append(low)
        inside = (offset >= low) & (offset <= low + DRIFT)
        a, b = j[inside], q[inside]
        cuts = np.flatnonzero((np.diff(a) > GAP + GRAM) | (np.abs(np.diff(b)) > GAP + GRAM)) + 1
        for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True):
            y0, y1, x0, x1 = y.min(), y.max() + GRAM, x.min(), x.max() + GRAM
            ends = _grown(passage[:y0][::-1], document[max(0, x0 - y0) : x0][::-1]) + _grown(passage[y1:], document[x1 : x1 + len(passage) - y1])
            p, d = passage[y0:y1], document[x0:x1]
            if min(len(p), len(d)) + ends >= MIN_SHARE * len(passage) > best * len(passage) - 1:
                held = _common(p, d) + ends
                if 0.8 * MIN_SHARE * len(passage) <= held < MIN_SHARE * len(passage):
                    held = _standing(p, d) + ends
                best = max(best, held / len(passage))
        if best >= 1:
            break
    return best


#: Words of a passage that an answer may hinge on: numbers, and names inside a sentence.
_ANSWER = regex.compile(r"\d+(?:[.,]\d+)*|(?<=[\p{Ll}\p{N},;:]\s)\p{Lu}[\p{L}\p{M}'’-]+")
_STEM = 5


def _words(text: str) -> list[str]:
    return [x[:_STEM] for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text) if (x := letter_skeleton(w))]


def same_meaning(passage: str, document: str) -> tuple[float, float]:
    """Shares of the passage's words (by their stems, in order) and of its answers that a document has in one place.

    The place is the stretch of twice the passage's length with most of its words; a passage without answers has them all.
    """
    own, other = _words(passage), _words(document)
    if not own or not other:
        return 0.0, 0.0
    known = set(own)
    hit = np.concatenate([[0], np.cumsum([w in known for w in other])])
    span = min(len(other), 2 * len(own))
    at = int(np.argmax(hit[span:] - hit[:-span]))
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in x]) for x in (own, other[at : at + span]))
    answers = {x[:_STEM] for w in _ANSWER.findall(passage) if (x := letter_skeleton(w))}
    return _common(a, b) / len(own), len(answers & set(other[at : at + span])) / len(answers) if answers else 1.0


@dataclass(slots=True)
class Space:
    """A block of passages with its latent space, as it travels to the executors."""

    known: Passages
    left: np.ndarray
    latent: np.ndarray
    idf: np.ndarray
    least: np.ndarray
    features: int

    def loads(self) -> np.ndarray:
        """Latent coordinates of each term of the vocabulary, times its weight."""
        out = np.zeros((len(self.known.vocabulary), self.left.shape[1]), dtype=np.float32)
        for terms, x in zip(self.known.terms, self.left, strict=True):
            t, counts = np.unique(terms, return_counts=True)
            w = counts * self.idf[t]
            out[t] += (w / max(1e-9, float(np.sqrt((w * w).sum())))).astype(np.float32)[:, None] * x
        return out * self.idf.astype(np.float32)[:, None]


def latent_space(block: DataFrame, docs: DataFrame) -> Space | None:
    """Latent space of a block of passages (``item_id``, ``text``) with document frequencies of all ``docs``; None without passages."""
    rows = block.orderBy("item_id").collect()
    known = Passages([r.item_id for r in rows], [r.text for r in rows])
    if not len(known.ids):
        return None
    df, n_docs = document_frequencies(docs, known)
    idf = np.log((n_docs + 1.0) / (df + 0.5)).clip(0)
    left, latent = randomised_svd(passage_vectors(block, known, df, n_docs), len(known.ids), RANK)
    space = Space(known, left.astype(np.float32), latent.astype(np.float32), idf, np.zeros(0), 1)
    # Letters without a feature weigh as much as the mean feature, whatever the size of the corpus.
    space.least, space.features = least_cosines(known, space.loads(), space.latent, idf * idf, float(idf.mean()))
    return space


def candidates(space: Space, loads: np.ndarray, least: np.ndarray, letters: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """``(piece, passage, cosine)`` of the pieces that have a window near enough to a passage in the latent space."""
    known, square, strange = space.known, space.idf * space.idf, float(space.idf.mean())
    at, term = known.hits(grams)
    piece = np.searchsorted(bounds, at, side="right") - 1
    whole = at + GRAM <= bounds[piece + 1]
    at, term, piece = at[whole], term[whole], piece[whole]
    # Cells of the pieces, numbered through; each piece ends with an empty cell.
    cells_of = -(-np.diff(bounds) // CELL) + 1
    first = np.concatenate([[0], np.cumsum(cells_of)])
    cell = first[piece] + (at - bounds[piece]) // CELL
    n_cells = int(first[-1])
    held = np.bincount(cell, minlength=n_cells)
    busy = np.flatnonzero(held[:-1] + held[1:] >= space.features)
    wanted = np.zeros(n_cells + 1, dtype=bool)
    wanted[busy] = wanted[busy + 1] = True
    term, cell = term[wanted[cell]], cell[wanted[cell]]
    if not len(cell):
        return
    used, begin = np.unique(cell, return_index=True)
    sums = np.zeros((n_cells, loads.shape[1]), dtype=np.float32)
    for s in range(0, len(used), 2048):
        a, b = begin[s], begin[s + 2048] if s + 2048 < len(used) else len(cell)
        sums[used[s : s + 2048]] = np.add.reduceat(loads[term[a:b]], begin[s : s + 2048] - a, axis=0)
    mass = np.bincount(cell, weights=square[term], minlength=n_cells) + np.maximum(0, CELL - held) * strange**2
    best: dict[tuple[int, int], float] = {}
    for s in range(0, len(busy), 4096):
        w = busy[s : s + 4096]
        cosine = ((sums[w] + sums[w + 1]) @ space.latent.T) / np.sqrt(np.maximum(1e-9, mass[w] + mass[w + 1]))[:, None]
        x, item = np.nonzero(cosine >= least)
        pieces = np.searchsorted(first, w[x], side="right") - 1
        for p, i, c in zip(pieces.tolist(), item.tolist(), cosine[x, item].tolist(), strict=True):
            best[p, i] = max(c, best.get((p, i), -1.0))
    for (p, i), c in sorted(best.items()):
        yield p, i, c


def _blocks(passages: DataFrame) -> list[DataFrame]:
    """The passages (``item_id``, ``text``, each item once) in blocks of about ``BLOCK``."""
    rows = passages.where("item_id IS NOT NULL AND passage IS NOT NULL").groupBy("item_id").agg(F.max(F.struct(F.length("passage"), F.col("passage").alias("text"))).alias("p")).select("item_id", "p.text")
    n = -(-rows.count() // BLOCK)
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def _searched(docs: DataFrame, passages: DataFrame, key: str, least: Callable[[Space], np.ndarray], judge: Callable, columns: str) -> DataFrame:
    """``doc_id``, ``item_id`` and ``columns`` of the candidates that ``judge`` keeps, over all blocks of passages."""
    read = docs.select(F.col(key).alias("doc_id"), "text").where(F.col("text").isNotNull())
    kind = dict(docs.dtypes)[key]
    out = read.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), *[F.lit(0.0).alias(c) for c in columns.split()]).where(F.lit(False))
    for block in _blocks(passages):
        space = latent_space(block, read)
        if space is not None:

            def search(batches: Iterator[pd.DataFrame], space: Space = space) -> Iterator[pd.DataFrame]:
                known, loads, asked = space.known, space.loads(), least(space)
                overlap = 2 * max(len(x) for x in known.letters)
                keyed = [(np.argsort(g, kind="stable"), np.sort(g), sieve_of(g)) for g in known.grams]
                for batch in batches:
                    rows: list[tuple] = []
                    names, texts = batch["doc_id"].to_numpy(), list(batch["text"])
                    for letters, owner, bounds in _pieces(texts, overlap):
                        grams = grams_of(letters)
                        for p, item, cosine in candidates(space, loads, asked, letters, grams, bounds):
                            a, b = bounds[p], bounds[p + 1]
                            kept = judge(known, item, keyed[item], letters[a:b], grams[a : max(a, b - GRAM + 1)], texts[owner[p]], cosine)
                            if kept:
                                rows.append((names[owner[p]], known.ids[item], *kept))
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", *columns.split()])

            schema = ", ".join([f"doc_id {kind}", "item_id bigint", *[f"{c} double" for c in columns.split()]])
            out = out.unionByName(read.mapInPandas(search, schema))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in columns.split()])


def leaked_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``item_id``, ``share``: documents that hold at least half of a passage in one place.

    Null and empty texts and passages hold nothing, as do passages of fewer than ten letters; a repeated
    item is one item with its longest passage; texts of any length are searched whole; other columns are
    ignored; empty tables give an empty result.
    """

    def judge(known: Passages, item: int, keyed: tuple, letters: np.ndarray, grams: np.ndarray, text: str, cosine: float) -> tuple | None:
        share = share_in_one_place(known.letters[item], *keyed[:2], letters, grams, keyed[2])
        return (share,) if share >= MIN_SHARE else None

    return _searched(docs, passages, key, lambda space: space.least, judge, "share")


def paraphrased_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``item_id``, ``cosine``, ``words``, ``answers``: documents near a passage in meaning.

    The latent cosine is at least ``SAME_MEANING``, and shares of the passage's words and answers in one place
    reach their bounds, so words may be exchanged, inflected or left out where ``leaked_passages`` asks for the
    letters.  Nulls, short passages and repeated items as there.
    """

    def judge(known: Passages, item: int, keyed: tuple, letters: np.ndarray, grams: np.ndarray, text: str, cosine: float) -> tuple | None:
        words, answers = same_meaning(known.texts[int(known.ids[item])], text)
        return (cosine, words, answers) if words >= MIN_WORDS and answers >= MIN_ANSWERS else None

    return _searched(docs, passages, key, lambda space: np.full(len(space.known.ids), SAME_MEANING), judge, "cosine words answers")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near a held-out passage in meaning, with the shares that say so."""
    found = paraphrased_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))
    return found.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("cosine", "words", "answers")])

"""Compounds cut into words of the corpus, with linking sounds, any number of parts.

Every piece of a word that is itself a word of the corpus is found by a join; what is
frequent as a piece ("tion") is sent to all executors (``joins``). The best cut of a word
is a shortest path over its letters, from one place to the next along a known piece and the
linking sound after it. What is best depends on the variant, a cost of pieces:

- ``frequent``: the product of the pieces' shares of the corpus, less a factor for each piece and sound
- ``greedy``: long pieces, the sum of their squared lengths
- ``conservative``: two pieces of six letters or more, as ``frequent``
- ``recursive``: as many pieces as there can be, of these as ``frequent``

A word that no variant cuts stays whole. Of equal cuts the one whose pieces end first wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import through_folder
from .joins import looked_up

LINKS = ("", "s", "es", "n", "en", "er")
LEAST_PART, LEAST_WORD, LEAST_CONSERVATIVE = 4, 10, 6
MIN_COUNT = 2
#: Costs of a piece and of a linking sound, besides those of what they are.
PIECE_COST, LINK_COST = 1.0, 0.7

Cost = Callable[[str, int, float], tuple[float, float]]
Piece = tuple[int, int, int]  #: start, end, count


def _log(n: int, total: float) -> float:
    return math.log(total / max(n, 1))


COSTS: dict[str, Cost] = {
    "frequent": lambda piece, n, total: (_log(n, total) + PIECE_COST, 0.0),
    "greedy": lambda piece, n, total: (-float(len(piece) ** 2), 0.0),
    "conservative": lambda piece, n, total: (_log(n, total) + PIECE_COST, 0.0) if len(piece) >= LEAST_CONSERVATIVE else (math.inf, 0.0),
    "recursive": lambda piece, n, total: (-1.0, _log(n, total)),
}


def cut(word: str, pieces: list[Piece], total: float, variant: str) -> list[str]:
    """The pieces of the best cut of ``word``, two at least; [word] if there is none."""
    cost, most = COSTS[variant], 2 if variant == "conservative" else len(word)
    by_start: dict[int, list[Piece]] = {}
    for p in sorted(set(pieces)):
        if p[1] - p[0] < len(word):
            by_start.setdefault(p[0], []).append(p)
    # best way to each place with so many pieces: cost, the pieces
    best: dict[tuple[int, int], tuple[float, float, tuple[Piece, ...]]] = {(0, 0): (0.0, 0.0, ())}
    for at in range(len(word)):
        for k in sorted(k for a, k in best if a == at and k < most):
            a, b, path = best[at, k]
            for p in by_start.get(at, ()):
                x, y = cost(word[p[0] : p[1]], p[2], total)
                if x == math.inf:
                    continue
                for link in LINKS:
                    to = p[1] + len(link)
                    if not word.startswith(link, p[1]) or (to == len(word) and link) or (link and to > len(word) - LEAST_PART):
                        continue
                    new = (round(a + x + (LINK_COST if link and variant != "greedy" and variant != "recursive" else 0.0), 9), round(b + y, 9), (*path, p))
                    key = (to, k + 1 if variant == "conservative" else min(k + 1, 2))
                    if key not in best or new < best[key]:
                        best[key] = new
    found = best.get((len(word), 2))
    return [word[a:b] for a, b, _ in found[2]] if found else [word]


def pieces(words: DataFrame) -> DataFrame:
    """word, n, pieces (array of start, end, count): the words of ``words`` (word, n) long enough to be cut, with what they hold of others."""
    part = words.where((F.length("word") >= LEAST_PART) & (F.col("n") >= MIN_COUNT))
    long = words.where(F.length("word") >= LEAST_WORD)
    starts = F.explode(F.sequence(F.lit(0), F.length("word") - LEAST_PART)).alias("a")
    each = long.select("word", starts).select("word", "a", F.explode(F.sequence(F.col("a") + LEAST_PART, F.length("word"))).alias("b"))
    each = each.where("b - a < length(word)").select("word", "a", "b", F.substring("word", F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"))
    each = through_folder(each.join(F.broadcast(part.select(F.length("word").alias("_l")).distinct()), F.col("b") - F.col("a") == F.col("_l")).drop("_l"), "pieces")  # lengths of words are few
    often = each.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    known = through_folder(often.join(part.select(F.col("word").alias("piece"), F.col("n").alias("count")), "piece"), "known")
    held = looked_up(each, known, ["piece"], "rows").where("count IS NOT NULL")
    own = held.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("a", "b", "count"))).alias("pieces"))
    return long.join(own, "word")


def split(words: DataFrame) -> DataFrame:
    """word, n and, for each variant, its cut as an array; words of ``words`` (word, n: a row for each) that some variant cuts."""
    words = through_folder(words.select("word", F.col("n").cast("long").alias("n")), "words")
    total = float(words.agg(F.sum("n")).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, [(p["a"], p["b"], p["count"]) for p in ps]) for w, n, ps in zip(*(batch[c].to_pylist() for c in ("word", "n", "pieces")), strict=True)]
            cuts = [[cut(w, ps, total, v) for v in COSTS] for w, _, ps in rows]
            keep = [k for k, c in enumerate(cuts) if any(len(x) > 1 for x in c)]
            made = [pa.array([rows[k][0] for k in keep], pa.string()), pa.array([rows[k][1] for k in keep], pa.int64())]
            made += [pa.array([cuts[k][j] for k in keep], pa.list_(pa.string())) for j in range(len(COSTS))]
            yield pa.RecordBatch.from_arrays(made, names=["word", "n", *COSTS])

    return pieces(words).mapInArrow(run, "word string, n bigint, " + ", ".join(f"{v} array<string>" for v in COSTS))

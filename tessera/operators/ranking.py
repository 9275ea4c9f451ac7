"""Pairwise ranking: comparisons, ordered rating folds, and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import by_value
from .scan import numbered, scanned, with_parts


def win_counts(topics: DataFrame, comparisons: DataFrame) -> DataFrame:
    """topic, wins, n_comparisons of every topic. comparisons: winner, loser."""
    ends = comparisons.select(F.explode(F.array(F.struct(F.col("winner").alias("topic"), F.lit(1).alias("won")), F.struct(F.col("loser").alias("topic"), F.lit(0).alias("won")))).alias("e"))
    counted = ends.groupBy("e.topic").agg(F.sum("e.won").alias("wins"), F.count("*").alias("n_comparisons"))
    return topics.join(counted, "topic", "left").na.fill(0, ["wins", "n_comparisons"])


def ranked(rows: DataFrame, score: str, pos: str, *by: str, base: int = 0) -> DataFrame:
    """rows with rank_idx: by descending score, ties in order of pos, inside each group of by; from running counts in segments."""
    placed = numbered(rows.withColumn("__o", F.struct((-F.col(score)).alias("s"), F.col(pos).alias("p"))), "__o", "rank_idx", *by)
    return placed.withColumn("rank_idx", (F.col("rank_idx") - 1 + base).cast("int")).drop("__o")


def paired(topics: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """round, a, b: in each round the topics in a hashed order, neighbours paired; an odd one is left out."""
    rows = topics.select("topic").crossJoin(F.broadcast(topics.sparkSession.range(rounds).withColumnRenamed("id", "round")))
    order = Window.partitionBy("round").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "round", "topic")), "topic")
    numbered = rows.withColumn("i", F.row_number().over(order) - 1)
    pairs = numbered.groupBy("round", F.floor(F.col("i") / 2).alias("pair")).agg(F.min_by("topic", "i").alias("a"), F.max_by("topic", "i").alias("b"), F.count("*").alias("n"))
    return pairs.where("n = 2").select("round", "pair", "a", "b")


def random_pairs(topics: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """i, a, b: n pairs of different topics (topic, pos from 0, dense), drawn with replacement by hashes; none for fewer than two topics."""
    size = topics.agg(F.count("*").alias("n_topics"))
    draw = lambda name, below: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), F.col("i"))), 1, 12), 16, 10).cast("long") % below
    slots = topics.sparkSession.range(n).withColumnRenamed("id", "i").join(F.broadcast(size), F.lit(True)).where("n_topics > 1")
    first = slots.select("i", "n_topics", draw("a", F.col("n_topics")).alias("pa"))
    both = first.select("i", "pa", ((F.col("pa") + 1 + draw("b", F.col("n_topics") - 1)) % F.col("n_topics")).alias("pb"))
    at = lambda c: topics.select(F.col("pos").alias(f"p{c}"), F.col("topic").alias(c))
    return both.join(at("a"), "pa").join(at("b"), "pb").select("i", "a", "b")


class RatingSystem:
    """An ordered aggregate over comparisons; extend it for a system of your own."""

    def start(self, topics: list[str]) -> None:
        raise NotImplementedError

    def update(self, winner: str, loser: str) -> None:
        raise NotImplementedError

    def scores(self) -> dict[str, tuple[float, float | None]]:
        """topic: (rating, uncertainty)."""
        raise NotImplementedError


@dataclass
class Elo(RatingSystem):
    #: The start rating and the step of the rating system.
    initial: float = 1000.0
    k: float = 32.0
    rating: dict[str, float] = field(default_factory=dict)

    def start(self, topics):
        self.rating = dict.fromkeys(topics, self.initial)

    def update(self, winner, loser):
        gain = self.k * (1 - 1 / (1 + 10 ** ((self.rating[loser] - self.rating[winner]) / 400)))
        self.rating[winner] += gain
        self.rating[loser] -= gain

    def scores(self):
        return {t: (r, None) for t, r in self.rating.items()}


@dataclass
class TrueSkill(RatingSystem):
    #: Mean, deviation, noise of a game, drift.
    mu: float = 1000.0
    sigma: float = 333.333
    beta: float = 166.667
    tau: float = 1.0
    state: dict[str, tuple[float, float]] = field(default_factory=dict)

    def start(self, topics):
        self.state = dict.fromkeys(topics, (self.mu, self.sigma**2))

    def update(self, winner, loser):
        (mw, vw), (ml, vl) = self.state[winner], self.state[loser]
        total = vw + vl + 2 * self.beta**2
        c = math.sqrt(total)
        t = (mw - ml) / c
        v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / ((1 + math.erf(t / math.sqrt(2))) / 2 + 1e-6)
        w = v * (v + t)
        shrunk = lambda var: var * (1 - var / total * w) + self.tau**2
        self.state[winner] = (mw + vw / c * v, shrunk(vw))
        self.state[loser] = (ml - vl / c * v, shrunk(vl))

    def scores(self):
        return {t: (m, math.sqrt(v)) for t, (m, v) in self.state.items()}


HISTORY = "system string, run string, snapshot int, topic string, rating double, sigma double, rank int"


#: Rows of a rating history that a fold hands on at a time.
HANDED = 10_000


def _fold(name: str, make: Callable[[], RatingSystem], every: int | None):
    """Rows (run, game, a, b) in order to histories: those of a run are together, its topics (game false, a) before its games (a beat b)."""

    def fold(batches):
        import pyarrow as pa

        names = ["system", "run", "snapshot", "topic", "rating", "sigma", "rank"]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        rows: list[tuple] = []
        order: list = []
        system, run, n, open_ = None, None, 0, False

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
            rows.clear()
            return out

        def start():
            started = make()
            started.start(order)
            return started

        def snapshot(number: int) -> None:
            scores = system.scores()
            place = {t: i for i, t in enumerate(order)}
            for rank, t in enumerate(sorted(scores, key=lambda x: (-scores[x][0], place[x])), 1):
                rows.append((name, run, number, t, scores[t][0], scores[t][1], rank))

        for batch in batches:
            for of, game, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not open_ or of != run:
                    if open_:
                        system = system or start()
                        if not n or not every or n % every:
                            snapshot((n - 1) // every if n and every else 0)
                    system, run, order, n, open_ = None, of, [], 0, True
                if not game:
                    order.append(a)
                    continue
                system = system or start()
                system.update(a, b)
                n += 1
                if every and n % every == 0:
                    snapshot((n - 1) // every)
                if len(rows) >= HANDED:
                    yield handed()
        if open_:
            system = system or start()
            if not n or not every or n % every:
                snapshot((n - 1) // every if n and every else 0)
        yield handed()

    return fold


def folded(comparisons: DataFrame, topics: DataFrame, name: str, make: Callable[[], RatingSystem], every: int | None = None) -> DataFrame:
    """system, run, snapshot, topic, rating, sigma, rank (from 1) after every `every` comparisons, and at the end.

    comparisons: run, seq, winner, loser; topics: run, topic, pos. A fold is sequential, so a run is one task; runs and systems are
    independent groups and spread over the cluster. The task reads its games as a sorted stream, which Spark sorts on disk where need be, and
    hands snapshots on as they come: it holds the state of a run's topics and nothing of its games. Of equal seq, the lesser names come first.
    """
    text = lambda c: F.col(c).cast("string")
    first = topics.select(text("run").alias("run"), F.lit(False).alias("game"), "pos", text("topic").alias("a"))
    games = comparisons.select(text("run").alias("run"), F.lit(True).alias("game"), "seq", text("winner").alias("a"), text("loser").alias("b"))
    both = first.unionByName(games, allowMissingColumns=True)
    last = [F.asc_nulls_last(c) for c in ("pos", "seq")]
    return both.repartition("run").sortWithinPartitions("run", "game", *last, "a", "b").select("run", "game", "a", "b").mapInArrow(_fold(name, make, every), HISTORY)


#: Parts that a ranking is cut into at most where inversions are counted; their pairs are counted in one task.
PARTS = 256


def inversions(values, group, n_groups: int):
    """For each group the pairs of its values in the wrong order (a larger one first). group: rises from 0."""
    import numpy as np

    out = np.zeros(n_groups, dtype="i8")
    if not len(values):
        return out
    # Ranks of (group, value): between groups nothing is in the wrong order.
    ranks = np.unique(np.rec.fromarrays([group, values]), return_inverse=True)[1]
    of_rank = np.zeros(int(ranks.max()) + 1, dtype="i8")
    of_rank[ranks] = group
    # From the highest bit on: among values whose higher bits agree, each 1 before a 0 is a pair.
    for bit in reversed(range(int(ranks.max()).bit_length())):
        higher = ranks >> (bit + 1)
        ones = (ranks >> bit) & 1
        start = np.concatenate(([True], higher[1:] != higher[:-1]))
        seen = np.cumsum(ones) - ones
        seen = seen - seen[np.flatnonzero(start)[np.cumsum(start) - 1]]
        zeros = ones == 0
        np.add.at(out, of_rank[ranks[zeros]], seen[zeros])
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return out


def _groups(table, by: int):
    """The index of each row's group, in order of rows sorted by group, and the first row of each."""
    import numpy as np

    codes = [table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for i in range(by)]
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0) if codes else False
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _inverted(by: int, cells: bool):
    """Rows (by, ra, rb, pa, pb) of a part to the inversions of each group; with cells less those inside a part of the other order."""

    def inverted(table):
        import numpy as np
        import pyarrow as pa

        names = table.column_names[:by]
        table = table.sort_by([(c, "ascending") for c in (*names, "ra", "rb")])
        group, first = _groups(table, by)
        rb = table.column("rb").to_numpy()
        found = inversions(rb, group, len(first))
        if cells and len(first):
            other = table.column("pa").to_numpy()
            new = np.ones(len(group), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
            np.subtract.at(found, group[new], inversions(rb, np.cumsum(new) - 1, int(new.sum())))
        return table.select(names).take(pa.array(first)).append_column("d", pa.array(found))

    return inverted


def _between(by: int):
    """Counts (by, pa, pb, n) of one group to the pairs of rows in different parts of both orders that are in the wrong order."""

    def between(table):
        import numpy as np
        import pyarrow as pa

        a, b, n = (table.column(c).to_numpy() for c in ("pa", "pb", "n"))
        ia, ib = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
        cells = np.zeros((ia.max() + 1, ib.max() + 1), dtype="i8")
        np.add.at(cells, (ia, ib), n)
        # Rows of earlier parts with a higher one of the other.
        earlier = np.cumsum(cells, axis=0) - cells
        higher = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
        return table.select(table.column_names[:by]).slice(0, 1).append_column("d", pa.array([int((cells * higher).sum())]))

    return between


def kendall(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, tau (tau-b) of two rankings (by, topic, rank), from counts of inversions.

    Rows are cut into parts of about equal size by (group, rank in a) and by (group, rank in b). Inversions inside a part of either
    are counted in its task (those in a part of both once; equal ranks in b share a part); pairs apart in both come from the counts of the parts' cells, at
    most PARTS * PARTS of a group. So n topics cost n log n, also in one group. A ranking with all topics tied has no tau.
    """
    from ..storage import round_table

    if not by:
        return kendall(a.withColumn("__all", F.lit(0)), b.withColumn("__all", F.lit(0)), "__all").drop("__all")
    both = a.select(*by, "topic", F.col("rank").alias("ra")).join(b.select(*by, "topic", F.col("rank").alias("rb")), [*by, "topic"]).select(*by, "ra", "rb")
    n = min(PARTS, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = both.withColumns({"__a": F.struct("ra", "rb"), "__b": F.col("rb")})
    rows = with_parts(rows, "__a", *by, n=n).withColumnRenamed("__part", "pa").drop("__tie")
    rows = round_table(with_parts(rows, "__b", *by, n=n, apart=False).withColumnRenamed("__part", "pb").select(*by, "ra", "rb", "pa", "pb"), "ranks")
    fields = "".join(f"`{c}` {both.schema[c].dataType.simpleString()}, " for c in by)
    counted = f"{fields}d bigint"
    inside = rows.groupBy("pa").applyInArrow(_inverted(len(by), False), counted)
    across = rows.groupBy("pb").applyInArrow(_inverted(len(by), True), counted)
    cells = rows.groupBy(*by, "pa", "pb").agg(F.count("*").alias("n"))
    apart = cells.groupBy(*by).applyInArrow(_between(len(by)), counted)
    wrong = inside.unionByName(across).unionByName(apart).groupBy(*by).agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
    pairs = lambda c: F.sum(F.col(c).cast("decimal(19,0)") * (F.col(c) - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)")
    each = rows.groupBy(*by, "ra", "rb").agg(F.count("*").alias("n"))
    tied = {"n0": [], "n1": ["ra"], "n2": ["rb"], "n3": ["ra", "rb"]}
    parts = [each.groupBy(*by, *c).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias("k")).withColumn("of", F.lit(name)) for name, c in tied.items()]
    counts = wrong.select(*by, F.col("d").alias("k"), F.lit("d").alias("of"))
    for part in parts:
        counts = counts.unionByName(part)
    one = {name: F.coalesce(F.max(F.when(F.col("of") == name, F.col("k"))), F.lit(0)).alias(name) for name in ("d", *tied)}
    found = counts.groupBy(*by).agg(*one.values())
    right = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("d")
    norm = F.sqrt((F.col("n0") - F.col("n1")).cast("double") * (F.col("n0") - F.col("n2")).cast("double"))
    return found.where("n0 > 0").select(*by, (right.cast("double") / F.nullif(norm, F.lit(0.0))).alias("tau"))


def average_ranks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """rows with avg_rank: ascending, ties share the mean of their places. Equal values are counted before they are placed."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    places = scanned(counts, value, {"__upto": F.col("__n")}, *by).select(*[F.col(c).alias(f"__{c}") for c in (*by, value)], (F.col("__upto") - (F.col("__n") - 1) / 2).alias("avg_rank"))
    same = [rows[c].eqNullSafe(places[f"__{c}"]) for c in (*by, value)]
    return rows.join(places, same).select(*rows.columns, "avg_rank")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    rx = average_ranks(rows, x).withColumnRenamed("avg_rank", "rx")
    return average_ranks(rx, y).agg(F.corr("rx", "avg_rank").alias("rho"), F.count("*").alias("n"))


def line_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def convergence(history: DataFrame) -> DataFrame:
    """system, run, snapshot, mean_rating, mean_sigma, rank_std (population), n_changed."""
    before = F.lag("rank").over(Window.partitionBy("system", "run", "topic").orderBy("snapshot"))
    rows = history.withColumn("changed", F.coalesce(F.col("rank") != before, F.lit(False)))
    return rows.groupBy("system", "run", "snapshot").agg(F.avg("rating").alias("mean_rating"), F.avg("sigma").alias("mean_sigma"), F.stddev_pop("rank").alias("rank_std"), F.count_if("changed").alias("n_changed"))


def run_agreement(final: DataFrame) -> DataFrame:
    """system, mean, std (population), min, max of tau over pairs of runs. final: system, run, topic, rank."""
    from ..storage import round_table

    final = round_table(final.select("system", "run", "topic", "rank"), "final")
    a = final.select("system", F.col("run").alias("run_a"), "topic", "rank")
    b = final.select("system", F.col("run").alias("run_b"), "topic", "rank")
    pairs = a.select("system", "run_a").distinct().join(b.select("system", "run_b").distinct(), "system").where("run_a < run_b")
    taus = kendall(pairs.join(a, ["system", "run_a"]), pairs.join(b, ["system", "run_b"]), "system", "run_a", "run_b")
    return taus.groupBy("system").agg(F.avg("tau").alias("mean"), F.stddev_pop("tau").alias("std"), F.min("tau").alias("min"), F.max("tau").alias("max"))


def system_agreement(final: DataFrame) -> DataFrame:
    """run, system_a, system_b, tau."""
    a = final.select("run", F.col("system").alias("system_a"), "topic", "rank")
    b = final.select("run", F.col("system").alias("system_b"), "topic", "rank")
    pairs = a.select("run", "system_a").distinct().join(b.select("run", "system_b").distinct(), "run").where("system_a < system_b")
    return kendall(pairs.join(a, ["run", "system_a"]), pairs.join(b, ["run", "system_b"]), "run", "system_a", "system_b")


by_value(__name__)

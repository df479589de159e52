"""Pairwise ranking by an online skill rating, replayed in order from an append-only log.

Updates depend on their order, so one tournament is one sequential fold; tournaments run side by side.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MU, SIGMA = 50.0, 8.333
BETA, TAU = SIGMA / 2, SIGMA / 100


def update(win: tuple[float, float], lose: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """Ratings (mu, sigma) after a game without draws, in closed form (Herbrich et al., 2006)."""
    a, b = win[1] ** 2 + TAU**2, lose[1] ** 2 + TAU**2
    c = math.sqrt(a + b + 2 * BETA**2)
    t = (win[0] - lose[0]) / c
    below = 0.5 * math.erfc(-t / math.sqrt(2))
    v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / below if below > 1e-300 else -t
    w = v * (v + t)
    return (win[0] + a / c * v, math.sqrt(a * (1 - a * w / c**2))), (lose[0] - b / c * v, math.sqrt(b * (1 - b * w / c**2)))


def fold(log: pd.DataFrame, state: dict[str, tuple[float, float, int]]) -> dict[str, tuple[float, float, int]]:
    """state (id -> mu, sigma, games) after a log of (seq, a, b, winner) in the order of seq."""
    for a, b, winner in log.sort_values("seq", kind="stable")[["a", "b", "winner"]].itertuples(index=False):
        x, y = (a, b) if winner == "A" else (b, a)
        (m, s, n), (k, r, p) = state.get(x, (MU, SIGMA, 0)), state.get(y, (MU, SIGMA, 0))
        one, two = update((m, s), (k, r))
        state[x], state[y] = (*one, n + 1), (*two, p + 1)
    return state


def replay(log: DataFrame) -> DataFrame:
    """tournament, id, mu, sigma, n of a log(tournament, seq, a, b, winner); rows without winner A or B are skipped."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state = fold(rows, {})
        own = rows["tournament"].iloc[0]
        return pd.DataFrame([(own, k, m, s, n) for k, (m, s, n) in state.items()], columns=["tournament", "id", "mu", "sigma", "n"])

    kind = f"tournament {log.schema['tournament'].dataType.simpleString()}, id {log.schema['a'].dataType.simpleString()}, mu double, sigma double, n long"
    return log.where("winner in ('A', 'B') and a <> b").groupBy("tournament").applyInPandas(run, kind)


def within(log: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The log's rows of which both sides are members."""
    ids = members.select(F.col(key).alias("_id")).distinct()
    return log.join(ids, F.col("a") == F.col("_id"), "left_semi").join(ids, F.col("b") == F.col("_id"), "left_semi")


def appearances(log: DataFrame) -> DataFrame:
    return log.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def with_ratings(docs: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """docs with mu and sigma, rounded to three places, and n_comparisons, 0 without games."""
    own = ratings.select(F.col("id").alias(key), F.round("mu", 3).alias("mu"), F.round("sigma", 3).alias("sigma"), F.col("n").alias("n_comparisons"))
    return docs.join(own, key, "left").withColumn("n_comparisons", F.coalesce("n_comparisons", F.lit(0)))


def progress(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.max("sigma").alias("max_sigma"), F.avg("n").alias("mean_appearances"), F.count_if(F.col("n") == 0).alias("n_new"))


def advance(ratings: DataFrame, log: DataFrame) -> DataFrame:
    """ratings(id, mu, sigma, n) after the games of a log(seq, a, b, winner). Only the players' rows meet in the fold."""
    games = log.where("winner in ('A', 'B') and a <> b").select(F.lit(0).alias("_one"), "seq", "a", "b", "winner")
    players = games.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    start = ratings.join(players, "id", "left_semi").withColumn("_one", F.lit(0))

    def step(known: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        state = {i: (m, s, n) for i, m, s, n in known[["id", "mu", "sigma", "n"]].itertuples(index=False)}
        return pd.DataFrame([(k, m, s, n) for k, (m, s, n) in fold(rows, state).items()], columns=["id", "_mu", "_sigma", "_n"])

    kind = f"id {ratings.schema['id'].dataType.simpleString()}, _mu double, _sigma double, _n long"
    new = start.groupBy("_one").cogroup(games.groupBy("_one")).applyInPandas(step, kind)
    return ratings.join(new, "id", "left").select("id", *(F.coalesce(f"_{c}", c).alias(c) for c in ("mu", "sigma", "n")))


def select_pairs(ratings: DataFrame, n: int, seed: int, bucket_rows: int = 10_000) -> DataFrame:
    """a, b, kind of n pairs at most for a round: 30 % for uncertainty, 60 % between neighbours, the rest random.

    Uncertain documents (the largest sigma) meet the next by mu; neighbours are taken at places that a hash of the seed
    picks, all along the ranking; random pairs join documents that stand together in a hashed order. Neighbours are found
    in stretches of mu, of which a crowded one is dealt by a hash, so no task orders them all; which side is A is decided
    by a hash. Two documents or more are needed.
    """
    total, low, high = ratings.agg(F.count("*"), F.min("mu"), F.max("mu")).first()
    if total < 2:
        return ratings.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit("").alias("kind")).where("false")
    unsure, swiss = int(n * 0.3), int(n * 0.6)
    ranges = max(1, total // bucket_rows)
    band = F.least(F.lit(ranges - 1), F.floor((F.col("mu") - low) / ((high - low) / ranges))).cast("int") if high > low else F.lit(0)
    hashed = lambda tag: F.xxhash64(F.lit(tag), F.lit(seed), F.col("id"))
    placed = ratings.withColumn("_band", band)
    crowds = placed.groupBy("_band").agg(F.ceil(F.count("*") / (2 * bucket_rows)).alias("_parts"))  # at most a row for each bucket_rows documents
    placed = placed.join(F.broadcast(crowds), "_band").withColumn("_part", F.pmod(hashed("part"), F.col("_parts")))
    by_mu = Window.partitionBy("_band", "_part").orderBy("mu", "id")
    by_hash = Window.partitionBy("_slot").orderBy("_h", "id")
    near = placed.withColumn("_next", F.coalesce(F.lead("id").over(by_mu), F.lag("id").over(by_mu))).where("_next is not null")
    spread = ratings.withColumn("_h", hashed("random")).withColumn("_slot", F.pmod("_h", F.lit(ranges))).withColumn("_next", F.lead("id").over(by_hash)).where("_next is not null")
    take = lambda df, order, k, kind: df.orderBy(*order).limit(k).select("id", "_next", F.lit(kind).alias("kind"))
    chosen = take(near, [F.desc("sigma"), "id"], unsure, "uncertainty").unionByName(take(near, [hashed("swiss"), "id"], swiss, "swiss")).unionByName(take(spread, [hashed("rest"), "id"], n - unsure - swiss, "random"))
    flip = F.pmod(F.xxhash64(F.lit("slot"), F.lit(seed), "id", "_next"), F.lit(2)) == 0
    return chosen.select(F.when(flip, F.col("id")).otherwise(F.col("_next")).alias("a"), F.when(flip, F.col("_next")).otherwise(F.col("id")).alias("b"), "kind")


LOG_SHAPE = "tournament int, seq long, a string, b string, winner string, confidence double"


def run(docs: DataFrame, key: str, text: str, judge, log_path: str, appearances: int = 30, batch: int = 64, seed: int = 0, target_sigma: float = 0.0, max_failures: int = 200, resume: bool = True, full_run: bool = False) -> DataFrame:
    """Ratings of docs after rounds of pairs, judged and appended to the log at log_path, until the budget is spent.

    judge takes and returns pairs(a, b, a_text, b_text, and of both sides macro and type where docs has macro and
    source_type), adding winner and confidence. The log is only ever appended to; with resume its rows are replayed
    first. The budget is `appearances` / 2 games for each document that has none yet, on top of those replayed; with
    full_run at least that many for each document, counted from the first. A round has `batch` pairs or a fourth of the
    documents, whichever is more; the ratings are kept beside the log between rounds, so a round folds its own games
    only. Verdicts without a winner stay in the log and are not played; max_failures of them in a row end the run
    with an error.
    """
    import uuid

    from tidemark.operators.corpus import pair_context
    from tidemark.sources.files import is_missing, remove

    spark = docs.sparkSession
    read = lambda: spark.read.schema(LOG_SHAPE).parquet(log_path)
    own = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("_text"), *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("macro", "source_type")))
    ids = own.select("id").distinct()
    try:
        last = read().agg(F.max("seq")).first()[0]
    except Exception as e:
        if not is_missing(e):
            raise
        spark.createDataFrame([], LOG_SHAPE).write.mode("append").parquet(log_path)
        last = None
    seq = 0 if last is None else last + 1
    state, turn = f"{log_path.rstrip('/')}-state-{uuid.uuid4().hex}", 0

    def keep(ratings: DataFrame) -> DataFrame:
        ratings.write.parquet(f"{state}/{turn}")
        if turn:
            remove(spark, f"{state}/{turn - 1}")
        return spark.read.parquet(f"{state}/{turn}")

    known = replay(within(read().where(F.col("seq") < (seq if resume else 0)), ids, "id")).drop("tournament")
    ratings = keep(ids.join(known, "id", "left").select("id", F.coalesce("mu", F.lit(MU)).alias("mu"), F.coalesce("sigma", F.lit(SIGMA)).alias("sigma"), F.coalesce("n", F.lit(0)).alias("n")))
    n_docs, games, fresh = ratings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 0)).first()
    done = games // 2
    budget = max(done + appearances * fresh // 2, appearances * n_docs // 2 if full_run else 0)
    budget, failed = min(budget, done + appearances * n_docs), 0
    while done < budget and n_docs > 1:
        pairs = select_pairs(ratings, min(max(batch, n_docs // 4), budget - done), seed + turn)
        judged = judge(pair_context(pairs.select("a", "b"), own, "id", "_text")).select("a", "b", "winner", "confidence")
        order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + turn), "a", "b"), "a", "b")) - 1  # a round's pairs
        judged.select(F.lit(0).alias("tournament"), (order + F.lit(seq)).cast("long").alias("seq"), "a", "b", "winner", "confidence").write.mode("append").parquet(log_path)
        round_ = read().where(F.col("seq") >= seq)
        asked, won, latest = round_.agg(F.count("*"), F.count("winner"), F.max(F.when(F.col("winner").isNotNull(), F.col("seq")))).first()
        if not asked:
            break
        failed = failed + asked if latest is None else seq + asked - 1 - latest
        if failed >= max_failures:
            raise RuntimeError(f"{failed} verdicts in a row without a winner")
        turn += 1
        ratings = keep(advance(ratings, round_))
        seq, done = seq + asked, done + won
        worst, mean = ratings.agg(F.max("sigma"), F.avg("n")).first()
        if worst < target_sigma and mean >= appearances:
            break
    return ratings

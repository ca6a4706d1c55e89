"""

plays: one row a line item (event): game, season, week, actor, team, opponent, an integer value and volume, flags
games: one row an order: season, week, home and away team and score, type
intervals: owner assignments [start_week, end_week] of a team and role in a season, from supplier x season
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Plays of a task where a query asks for groups as fine as a play.
ROWS_A_TASK = 250_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def plays(self) -> DataFrame:
        return self._plays()

    @cached_property
    def plays_by_game(self) -> DataFrame:
        """plays, dealt by game into tasks of about ROWS_A_TASK rows: for groups within a game, which need no other shuffle. No fewer tasks than the session's
        shuffle partitions, as Spark may deal both sides again into those."""
        rows = self.raw("lineitem").count()  # of the files' footers
        return self._plays(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)))

    def _plays(self, tasks: int | None = None) -> DataFrame:
        """Facts stay on the streamed side; an order meets its customer before its lines, so that lines are shuffled once, by order. What is
        shuffled are the columns of plays, small whole numbers and flags, instead of prices and texts."""
        customers = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("opponent_id"))
        orders = self.raw("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        lines = self.raw("lineitem").join(self.raw("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            "l_orderkey", F.col("l_linenumber").alias("play_id"), F.col("l_suppkey").alias("actor_id"), F.col("s_nationkey").alias("team_id"),
            (F.floor("l_extendedprice") - 30000).cast("long").alias("value"), F.col("l_quantity").cast("long").alias("volume"),
            (F.col("l_returnflag") == "R").alias("attempt"), (F.col("l_linestatus") == "O").alias("success"),
            (F.floor(F.col("l_tax") * 100 + 0.5)).cast("int").alias("tax"), (F.floor(F.col("l_discount") * 100 + 0.5)).cast("int").alias("discount"),
        )
        if tasks:
            lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("game_id"), "play_id", "season", "week", "actor_id", "team_id", "opponent_id", "value", "volume", "attempt", "success", "tax", "discount"
        )

    @cached_property
    def games(self) -> DataFrame:
        home = (F.col("o_custkey") % 25).cast("int")
        price = F.floor("o_totalprice").cast("long")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"),
            home.alias("home_team"), ((home + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away_team"),
            (price % 40).cast("int").alias("home_score"), (F.expr("cast(floor(o_totalprice) as bigint) div 40") % 40).cast("int").alias("away_score"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "POST").otherwise("REG").alias("game_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("game_day"),
        )

    @cached_property
    def seasons(self) -> DataFrame:
        """The seasons that have games: a row each."""
        return self.raw("orders").select(F.year("o_orderdate").alias("season")).where("season IS NOT NULL").distinct()

    @cached_property
    def intervals(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").crossJoin(F.broadcast(self.seasons)).select(
            F.concat_ws("-", k.cast("string"), F.col("season").cast("string")).alias("interval_id"), (k % 40).alias("owner_id"), "season",
            F.col("s_nationkey").alias("team_id"), (k % 4).cast("int").alias("role"), (1 + k % 6).cast("int").alias("start_week"),
            (1 + k % 6 + k % 7).cast("int").alias("end_week"), (k % 5 == 0).alias("shared"),
            F.when(k % 3 == 0, "verified").when(k % 3 == 1, "supported").otherwise("unresolved").alias("status"),
        )

    @cached_property
    def actor_totals(self) -> DataFrame:
        """actor_seasons with what teams' seasons and variances need, written once: a query that asks for several of them passes over the plays once."""
        sums = {"volume": "volume", "value": "value", "tax": "tax", "discount": "discount", "squares": "value * value"}
        own = self.plays.groupBy("season", "team_id", "actor_id").agg(F.count(F.lit(1)).alias("plays"), *(F.sum(F.expr(e)).alias(n) for n, e in sums.items()), F.count_if("attempt").alias("attempts"), F.count_if("success").alias("successes"))
        return cut(own, "actor_totals")

    @cached_property
    def actor_seasons(self) -> DataFrame:
        """Season totals by actor: the input of most features and statistics."""
        return self.actor_totals.select("season", "team_id", "actor_id", "plays", "volume", "value", "attempts", "successes")

    @cached_property
    def team_seasons(self) -> DataFrame:
        """Season totals by team: of the actors' totals where the query has those, else of the plays, added up before they are shuffled."""
        names = ["plays", "volume", "value", "attempts", "successes", "tax", "discount"]
        if "actor_totals" in self.__dict__:
            return self.actor_totals.groupBy("season", "team_id").agg(*(F.sum(n).alias(n) for n in names))
        return self.plays.groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("plays"), F.sum("volume").alias("volume"), F.sum("value").alias("value"), F.count_if("attempt").alias("attempts"), F.count_if("success").alias("successes"), F.sum("tax").alias("tax"), F.sum("discount").alias("discount"))


SQL_TABLES = """plays AS (
  SELECT l_orderkey AS game_id, l_linenumber AS play_id, CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS week,
         l_suppkey AS actor_id, s_nationkey AS team_id, c_nationkey AS opponent_id, CAST(floor(l_extendedprice) AS BIGINT) - 30000 AS value,
         CAST(l_quantity AS BIGINT) AS volume, l_returnflag = 'R' AS attempt, l_linestatus = 'O' AS success,
         CAST(floor(l_tax * 100 + 0.5) AS INT) AS tax, CAST(floor(l_discount * 100 + 0.5) AS INT) AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
games AS (
  SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS week,
         CAST(o_custkey % 25 AS INT) AS home_team, CAST((o_custkey % 25 + 1 + o_orderkey % 24) % 25 AS INT) AS away_team,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS INT) AS home_score, CAST((CAST(floor(o_totalprice) AS BIGINT) // 40) % 40 AS INT) AS away_score,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'POST' ELSE 'REG' END AS game_type, strftime(o_orderdate, '%Y-%m-%d') AS game_day
  FROM orders),
seasons AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season FROM orders),
intervals AS (
  SELECT s_suppkey || '-' || season AS interval_id, s_suppkey % 40 AS owner_id, season, s_nationkey AS team_id, CAST(s_suppkey % 4 AS INT) AS role,
         CAST(1 + s_suppkey % 6 AS INT) AS start_week, CAST(1 + s_suppkey % 6 + s_suppkey % 7 AS INT) AS end_week, s_suppkey % 5 = 0 AS shared,
         CASE s_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'supported' ELSE 'unresolved' END AS status
  FROM supplier CROSS JOIN seasons),
actor_seasons AS (
  SELECT season, team_id, actor_id, count(*) AS plays, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(value) AS BIGINT) AS value,
         count(*) FILTER (WHERE attempt) AS attempts, count(*) FILTER (WHERE success) AS successes
  FROM plays GROUP BY season, team_id, actor_id),
team_seasons AS (
  SELECT season, team_id, count(*) AS plays, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(value) AS BIGINT) AS value,
         count(*) FILTER (WHERE attempt) AS attempts, count(*) FILTER (WHERE success) AS successes, CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(discount) AS BIGINT) AS discount
  FROM plays GROUP BY season, team_id)"""

"""Projection, cleaning and keys (family B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import blank_to_null, finite, ordered_when


def canonical_alias(df: DataFrame, column: str, aliases: DataFrame, prefix: str = "team_") -> DataFrame:
    """df plus canonical and canonical_id; an unknown alias gives NULL."""
    known = aliases.select(F.col("alias").alias(column), "canonical")
    return df.join(known, column, "left").withColumn("canonical_id", F.concat(F.lit(prefix), F.lower("canonical")))


def unknown_alias_audit(df: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank values of the columns that the alias table does not hold."""
    values = df.select(F.explode(F.array(*(blank_to_null(F.col(c)) for c in columns))).alias("alias")).where("alias IS NOT NULL").distinct()
    return values.join(aliases.select("alias").distinct(), "alias", "left_anti")


def alias_observations(frames: list[tuple[str, DataFrame]], aliases: DataFrame) -> DataFrame:
    """source, alias, canonical, first_season, last_season over frames of (alias, season)."""
    out = None
    for source, df in frames:
        own = df.select(F.lit(source).alias("source"), blank_to_null(F.col("alias")).alias("alias"), "season")
        out = own if out is None else out.unionByName(own)
    seen = out.where("alias IS NOT NULL").groupBy("source", "alias").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    return seen.join(aliases.select("alias", "canonical"), "alias", "left").select("source", "alias", "canonical", "first_season", "last_season")


def preferred_row(df: DataFrame, keys: list[str], preferred: Column, ties: list[str]) -> DataFrame:
    """One row a key: the preferred one if there is one, then by ties."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(preferred, F.lit(False)).desc(), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def alias_merge(frames: list[DataFrame]) -> DataFrame:
    """Alias tables of several seasons in one: the earliest first and the latest last season."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.groupBy("source", "alias", "canonical").agg(F.min("first_season").alias("first_season"), F.max("last_season").alias("last_season"))


def key_audit(df: DataFrame, keys: list[str], samples: int = 5) -> DataFrame:
    """One row: null_keys, duplicate_keys, excess_rows, and the first duplicate keys as text. Rows are reduced to
    keys by a map-side aggregate."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    audit = groups.agg(
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~null & (F.col("n") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(~null & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("excess_rows"),
    )
    lowest = groups.where(~null & (F.col("n") > 1)).orderBy(*keys).limit(samples).agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("_s"))
    text = F.transform("_s", lambda x: F.concat_ws("-", *(x[k].cast("string") for k in keys)))
    first = lowest.select(F.array_join(text, ",").alias("sample_keys"))
    return audit.crossJoin(first)  # one row each


def resolve_actor(df: DataFrame, primary: str, override: str, measure: str, pattern: str) -> DataFrame:
    """df plus actor and resolution_status, by the first rule that holds: conflicting_ids, invalid_value,
    missing_id, invalid_id, resolved. The override id wins over the primary one."""
    a, b = blank_to_null(F.col(override)), blank_to_null(F.col(primary))
    chosen = F.coalesce(a, b)
    status = ordered_when([
        (a.isNotNull() & b.isNotNull() & (a != b), "conflicting_ids"),
        (~F.coalesce(finite(F.col(measure)), F.lit(False)), "invalid_value"),
        (chosen.isNull(), "missing_id"),
        (~chosen.rlike(pattern), "invalid_id"),
    ], "resolved")
    return df.withColumn("actor", chosen).withColumn("resolution_status", status)


def parent_reconcile(events: DataFrame, parents: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row: events without a parent, and for each compared column how many differ from it (null-safe)."""
    right = parents.select(F.col(key), F.lit(True).alias("_found"), *(F.col(c).alias(f"_{c}") for c in compared))
    joined = events.join(right, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("_found").isNull()).alias("without_parent"), *(F.count_if(F.col("_found") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differs") for c in compared))


def entity_master(entity: str, sources: list[DataFrame], attributes: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Distinct ids of the sources; each attribute from the first frame (key, value, season) of its name that
    has a non-null value, its latest season first."""
    universe = None
    for df in sources:
        ids = df.select(entity).where(F.col(entity).isNotNull())
        universe = ids if universe is None else universe.unionByName(ids)
    out = universe.distinct()
    names: dict[str, list[str]] = {}
    for i, (name, df, season) in enumerate(attributes):
        latest = df.where(F.col(name).isNotNull()).groupBy(entity).agg(F.max(F.struct(season, name)).alias("_m")).select(entity, F.col(f"_m.{name}").alias(f"_{i}"))
        out = out.join(latest, entity, "left")
        names.setdefault(name, []).append(f"_{i}")
    return out.select(entity, *(F.coalesce(*own).alias(name) for name, own in names.items()))


def external_ids(df: DataFrame, entity: str, systems: list[str], known: DataFrame) -> DataFrame:
    """entity, system, external_id of every non-blank id column, known entities only, distinct."""
    long = df.select(entity, F.explode(F.array(*(F.struct(F.lit(s).alias("system"), blank_to_null(F.col(s).cast("string")).alias("external_id")) for s in systems))).alias("x"))
    long = long.select(entity, "x.system", "x.external_id").where("external_id IS NOT NULL")
    return long.join(known.select(entity).distinct(), entity, "left_semi").distinct()


def ambiguous_ids(ids: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(ids that map to one entity only, quarantined (system, external_id) with their entities)."""
    groups = ids.groupBy("system", "external_id").agg(F.count_distinct(entity).alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(entity).cast("string"))), "|").alias("entities"))
    bad = groups.where("n > 1")
    return ids.join(bad.select("system", "external_id"), ["system", "external_id"], "left_anti"), bad


def unique_or_null(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A key's value if all its non-null values are the same, else NULL."""
    return df.groupBy(*keys).agg(F.when(F.min(column) == F.max(column), F.max(column)).alias(column))


def unique_membership(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """members (sorted text), member (if just one) and status: single, ambiguous or unavailable."""
    groups = df.groupBy(*keys).agg(F.sort_array(F.collect_set(member)).alias("_m"))
    n = F.size("_m")
    return groups.select(*keys, F.array_join(F.transform("_m", lambda x: x.cast("string")), "|").alias("members"), F.when(n == 1, F.element_at("_m", 1)).alias("member"), F.when(n == 1, "single").when(n > 1, "ambiguous").otherwise("unavailable").alias("status"))


def partition_by_attribute(df: DataFrame, master: DataFrame, key: str, attribute: str, wanted: list) -> DataFrame:
    """df plus eligibility: eligible, or why not (unknown_entity, missing_attribute, other_attribute)."""
    out = df.join(master.select(key, F.col(attribute).alias("_a"), F.lit(True).alias("_known")), key, "left")
    status = ordered_when([(F.col("_known").isNull(), "unknown_entity"), (F.col("_a").isNull(), "missing_attribute"), (~F.col("_a").isin(wanted), "other_attribute")], "eligible")
    return out.withColumn("eligibility", status).drop("_a", "_known")


def crosswalk_fill(df: DataFrame, column: str, external: str, crosswalk: DataFrame) -> DataFrame:
    """Missing ids through (external -> entity) pairs, where the external id maps to exactly one entity."""
    one = crosswalk.groupBy(external).agg(F.when(F.count_distinct("entity") == 1, F.max("entity")).alias("_e")).where("_e IS NOT NULL")
    return df.join(one, external, "left").withColumn(column, F.coalesce(F.col(column), F.col("_e"))).drop("_e")


def context_bins(df: DataFrame, distance: str, place: str, quarter: str, margin: str) -> DataFrame:
    """distance_bin, zone (width 20), quarter_bin (clipped to 1..5) and score_state."""
    return df.select(
        "*",
        F.when(F.col(distance) <= 3, "short").when(F.col(distance) <= 7, "medium").when(F.col(distance).isNotNull(), "long").alias("distance_bin"),
        F.floor(F.least(F.greatest(F.col(place), F.lit(0)), F.lit(99)) / 20).cast("int").alias("zone"),
        F.least(F.greatest(F.col(quarter), F.lit(1)), F.lit(5)).cast("int").alias("quarter_bin"),
        F.when(F.col(margin) > 0, "ahead").when(F.col(margin) < 0, "behind").when(F.col(margin) == 0, "level").alias("score_state"),
    )


def personnel(text: str) -> Column:
    """Struct of rb, te, wr, personnel and reason from a column of texts like "1 RB, 2 TE, 2 WR"; other positions and
    counts over 5 are rejected with a reason."""
    n = {p: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{text}`, '([0-9]+) *{p}', 1), '') as int)"), F.lit(0)) for p in ("RB", "TE", "WR")}
    rest = F.regexp_replace(F.regexp_replace(F.col(text), "[0-9]+ *(RB|TE|WR)", ""), "[ ,]+", "")
    reason = F.when(blank_to_null(F.col(text)).isNull(), "missing").when(rest != "", "unknown_position").when(F.greatest(*n.values()) > 5, "count_too_large")
    good = {p.lower(): F.when(reason.isNull(), c) for p, c in n.items()}
    group = F.when(reason.isNull(), F.concat(n["RB"].cast("string"), n["TE"].cast("string")))
    return F.struct(*(c.alias(p) for p, c in good.items()), group.alias("personnel"), reason.alias("reason"))


def interval_tokens(df: DataFrame, column: str) -> DataFrame:
    """Rows of "id~name~start~end~status~shared;..." texts: the parts, and valid where start and end are ordered numbers."""
    token = df.withColumn("_t", F.explode(F.split(F.col(column), ";"))).where(F.trim("_t") != "").withColumn("_p", F.split("_t", "~"))
    part = lambda i: F.get("_p", F.lit(i))
    out = token.select(*[c for c in df.columns if c != column], part(0).alias("id"), part(1).alias("name"), F.expr("try_cast(get(_p, 2) as int)").alias("start"), F.expr("try_cast(get(_p, 3) as int)").alias("end"), part(4).alias("status"), (part(5) == "true").alias("shared"))
    return out.withColumn("valid", F.coalesce((F.col("start") >= 1) & (F.col("end") >= F.col("start")), F.lit(False)))


def play_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows, how many each exclusion takes (in order, the first that holds), and those eligible."""
    why = None
    for name, excluded in rules.items():
        why = F.when(excluded, name) if why is None else why.when(excluded, name)
    marked = df.select(why.alias("_why"))
    return marked.agg(F.count(F.lit(1)).alias("row_count"), *(F.count_if(F.col("_why") == n).alias(n) for n in rules), F.count_if(F.col("_why").isNull()).alias("eligible"))


def round_doubles(df: DataFrame, places: int) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Entities that texts are unescaped from; the ampersand is last, so that nothing is unescaped twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&apos;|&#0?39;", "'"), ("&nbsp;|&#160;", " "), ("&ndash;|&#8211;", "-"), ("&amp;|&#38;", "&"))


def required_terms(docs: DataFrame, text: str, rules: DataFrame, on: str) -> DataFrame:
    """docs x their rules: the pipe-separated terms of the rule that the normalised text does not hold."""
    plain = F.col(text)
    for entity, letter in ENTITIES:
        plain = F.regexp_replace(plain, entity, letter)
    clean = F.regexp_replace(F.regexp_replace(F.lower(plain), "\\b0+([0-9])", "$1"), "\\s+", " ")
    joined = docs.withColumn("_t", clean).join(rules, on)
    missing = F.filter(F.split(F.lower("terms"), "\\|"), lambda x: ~F.contains(F.col("_t"), x))
    return joined.withColumn("missing_terms", F.array_join(missing, "|")).drop("_t")


def phrase_flag(text: Column, affirm: list[str], negate: list[str]) -> Column:
    """Any affirming phrase and no negating one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    yes, no = F.lit(False), F.lit(False)
    for p in affirm:
        yes = yes | F.contains(low, F.lit(p))
    for p in negate:
        no = no | F.contains(low, F.lit(p))
    return yes & ~no

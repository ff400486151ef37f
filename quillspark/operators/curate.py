"""Curation: merging, matching, expansion and ordering of records (AGG7-AGG14, JN2-JN16, WIN2-WIN4, WIN10, CUR1-CUR4, X12-X25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.signals import names_match
from ..functions.text import any_phrase, clean_list, normalize_key, null_if_blank, squeeze
from ..plans.session import row_numbers, stored


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(order: str, value) -> Column:
    """A column's values of a group as an array in the order of another column, without nulls."""
    pairs = F.array_sort(F.collect_list(F.when(_c(value).isNotNull(), F.struct(F.col(order).alias("o"), _c(value).alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def first_filled(order: str, value: str) -> Column:
    """The first non-empty value of a group in order."""
    return F.min_by(value, F.when(F.coalesce(F.trim(F.col(value)), F.lit("")) != "", F.col(order)))


def unique_join(items, separator: str = " ") -> Column:
    """AGG9: distinct items in order, joined."""
    return F.array_join(F.array_distinct(_c(items)), separator)


#: Evidence levels from strong to weak.
EVIDENCE = ("high", "medium")


def strongest_evidence(level: str, order: str) -> Column:
    """AGG10: high before medium before whatever came first."""
    rank = F.when(F.col(level) == "high", 0).when(F.col(level) == "medium", 1).otherwise(2)
    return F.min_by(level, F.when(F.coalesce(F.col(level), F.lit("")) != "", F.struct(rank, F.col(order))))


def merge_entities(rows: DataFrame, key: Column, order: str, first: list[str] = (), joined: list[str] = (), lists: list[str] = (), sets: list[str] = (), evidence: str | None = None) -> DataFrame:
    """AGG8: one row for each key: first non-empty texts, distinct joined texts, ordered distinct lists, sorted sets, strongest evidence."""
    keyed = rows.withColumn("merge_key", key)
    aggs = [first_filled(order, c).alias(c) for c in first]
    aggs += [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    if evidence:
        aggs.append(strongest_evidence(evidence, order).alias(evidence))
    out = keyed.groupBy("merge_key").agg(*aggs, F.min(order).alias(order))
    if joined or lists:
        names = [*joined, *lists]
        texts = _distinct_values(keyed, order, joined, lists).withColumnRenamed("merge_key", "_k")
        out = out.join(texts, F.col("merge_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        out = out.withColumns({c: F.coalesce(F.transform(c, lambda x: x["item"]), F.array().cast("array<string>")) for c in names})
        out = out.withColumns({c: F.array_join(c, " ") for c in joined})
    return out.select("merge_key", *first, *joined, *lists, *sets, *([evidence] if evidence else []), order)


def _distinct_values(keyed: DataFrame, order: str, joined: list[str], lists: list[str]) -> DataFrame:
    """The distinct texts of each key, sorted by where they come first, as an array for each column.

    Repeats go before anything is collected, so that a group holds its distinct texts only, however many rows it has.
    """

    def value(c: str, low: Column, item: Column, row: Column, i: Column) -> Column:
        return F.struct(F.lit(c).alias("name"), low.alias("low"), F.struct(F.col(order).alias("o"), row.alias("row"), i.cast("int").alias("i"), item.alias("item")).alias("at"))

    def whole(c: str) -> Column:
        return F.transform(F.array_compact(F.array(null_if_blank(c))), lambda x: value(c, x, x, F.lit(None).cast("array<string>"), F.lit(0)))

    def items(c: str) -> Column:
        some = F.filter(F.transform(c, lambda x, i: F.struct(squeeze(x).alias("x"), i.alias("i"))), lambda p: F.coalesce(p["x"], F.lit("")) != "")
        return F.coalesce(F.transform(some, lambda p: value(c, F.lower(p["x"]), p["x"], F.col(c), p["i"])), F.array())

    found = [whole(c) for c in joined] + [items(c) for c in lists]
    one = keyed.select("merge_key", F.inline(F.concat(*found))).groupBy("merge_key", "name", "low").agg(F.min("at").alias("at"))
    return one.groupBy("merge_key").agg(*[F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("at")))).alias(c) for c in (*joined, *lists)])


def first_by_key(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """WIN2: the first row of each key in order; never a bare dropDuplicates, which keeps any."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, order: list, name: str = "id", pattern: str = "row_%04d", buckets: int = 512) -> DataFrame:
    """WIN3: sequential ids in the order of some columns."""
    return row_numbers(rows, order, "_number", buckets).withColumn(name, F.format_string(pattern, F.col("_number"))).drop("_number")


def top_per_key(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """WIN4: the first k rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def match_profiles(rows: DataFrame, text: Column, profiles: dict[str, list[str]], k: int = 4, key: str = "id") -> DataFrame:
    """JN9, X12: (key, profile, hits, evidence, rank): profiles with a keyword in the text, the k with most hits.

    The profiles are a literal list, so the match is an array expression over one scan in place of a cross join, and
    the best are cut inside the row.
    """
    low = F.lower(text)
    def hits(words):
        n = F.lit(0)
        for w in words:
            n = n + F.contains(low, F.lit(w)).cast("int")
        return n

    # most hits first, then by name: both ascend in the struct, so the row's own array is sorted and cut without an exchange
    found = F.array(*[F.struct((-hits(ws)).alias("less"), F.lit(p).alias("profile")) for p, ws in profiles.items()])
    best = F.slice(F.array_sort(F.filter(found, lambda x: x["less"] < 0)), 1, k)
    pairs = rows.select(key, F.posexplode(best).alias("pos", "m")).select(key, "m.profile", (-F.col("m.less")).alias("hits"), (F.col("pos") + 1).alias("rank"))
    level = F.when(F.col("hits") >= 3, "high").when(F.col("hits") == 2, "medium").otherwise("low_to_medium")
    return pairs.withColumn("evidence", level)


def with_legacy(rows: DataFrame, legacy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN7, JN8: rows filled up from legacy rows of the same key, then the legacy rows that no row has."""
    old = legacy.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    filled = rows.join(old, rows[key] == old["_k"], "left").select(*[F.coalesce(null_if_blank(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])
    return filled.unionByName(legacy.join(rows, key, "left_anti"), allowMissingColumns=True)


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], value: str, default: Column, order: str) -> DataFrame:
    """JN11, X16: the override of the first key that has one, else the default; of repeated overrides the last counts."""
    table = overrides.groupBy(normalize_key("key").alias("_k")).agg(F.max_by(value, order).alias("_v"))
    out = rows
    for i, k in enumerate(keys):
        out = out.join(table.select(F.col("_k").alias(f"_k{i}"), F.col("_v").alias(f"_v{i}")), normalize_key(k) == F.col(f"_k{i}"), "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))], default)).drop(*[f"_{x}{i}" for x in "kv" for i in range(len(keys))])


def collect_sources(records: DataFrame, sources: DataFrame, key: str = "id", names: str = "source_keys") -> DataFrame:
    """JN12: records with the titles and addresses of their sources, in the order of their keys."""
    pairs = records.select(key, F.posexplode(names).alias("pos", "source_key")).join(sources, "source_key")
    lists = pairs.groupBy(key).agg(ordered("pos", "title").alias("source_titles"), ordered("pos", "url").alias("source_urls"))
    return records.join(lists, key, "left")


def expand(rows: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """JN16: every combination with rows of small, literal dimension tables."""
    for d in dimensions:
        rows = rows.crossJoin(F.broadcast(d))
    return rows


def rotate(items, by) -> Column:
    """WIN10: a list that starts at another place."""
    a = _c(items)
    n = F.size(a)
    k = F.pmod(_c(by), F.greatest(n, F.lit(1)))
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, k + 1, n), F.slice(a, F.lit(1), k)))


def better_preparation(current, name, contexts, margin: int = 35) -> Column:
    """JN6: folds over contexts (array of name, preparation) in order; a matching preparation that is longer than the best so far by more than the margin becomes the best."""
    return F.aggregate(
        _c(contexts),
        F.coalesce(_c(current), F.lit("")),
        lambda best, x: F.when(names_match(name, x["name"]) & (F.length(F.trim(x["preparation"])) > F.length(best) + margin), F.trim(x["preparation"])).otherwise(best),
    )


def first_name_in(rows: DataFrame, names: DataFrame, text: str, name: str, order: str) -> DataFrame:
    """JN5: each row with the first name, by `order`, that is a substring of its text; rows without any are left out.

    All names are one automaton, which reads a text once however many there are (see functions/phrases.py); case
    doesn't count. Of equal names the first counts, null and empty names match nothing; repeated rows stay. A
    name's columns replace those of the same name.
    """
    spark = rows.sparkSession
    some = names.where(F.coalesce(F.length(name), F.lit(0)) > 0).withColumn("_low", F.lower(name))
    ranked = some.groupBy("_low").agg(F.min(F.struct(F.col(order).alias("o"), F.struct(*names.columns).alias("x"))).alias("b"))
    numbered = stored(row_numbers(ranked.select("_low", F.col("b.o").alias("_o"), F.col("b.x").alias("_x")), [F.col("_o"), F.col("_low")], "_rank"), "names")
    hits = phrases.first_of(rows, F.lower(F.col(text)), phrases.automaton(numbered, "_low", "_rank"), "_rank").where("_rank is not null")
    columns = [c for c in rows.columns if c not in names.columns]
    return hits.join(numbered.select("_rank", "_x"), "_rank").select(*columns, *[F.col("_x")[c].alias(c) for c in names.columns])


def applicable(rows: DataFrame, cases: DataFrame, ids: str = "applicable_case_ids", case_id: str = "case_id") -> DataFrame:
    """JN15: rows with a case in their list of ids."""
    wanted = cases.select(F.col(case_id).alias("_case")).distinct()
    pairs = rows.withColumn("_case", F.explode(F.array_distinct(ids))).join(wanted, "_case", "left_semi")
    return rows.join(pairs.select("id").distinct(), "id", "left_semi")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """AGG7: counts by value, largest first, then by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def manifest(counts: dict[str, DataFrame]) -> DataFrame:
    """AGG13, AGG14: (name, n) of several tables."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def topic_facts(text, rules: dict[str, str], group=None, defaults: dict[str, list[str]] | None = None, most: int = 10) -> Column:
    """CUR2: labels of the patterns that a text has, then the group's defaults, distinct, at most `most`."""
    found = F.array_compact(F.array(*[F.when(_c(text).rlike(f"(?i){p}"), F.lit(label)) for p, label in rules.items()]))
    if defaults:
        table = F.create_map(*[x for g, v in defaults.items() for x in (F.lit(g), F.array(*[F.lit(i) for i in v]))])
        found = F.concat(found, F.coalesce(F.try_element_at(table, _c(group)), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(found), 1, most)


def supplemental_references(text, rules: dict[str, tuple[str, str]]) -> Column:
    """CUR3, X20: (title, url) of the rules whose keyword a text has."""
    low = F.lower(_c(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(t).alias("title"), F.lit(u).alias("url"))) for k, (t, u) in rules.items()]))


def safety_note(flag, note, constant: str) -> Column:
    """Flag, the start of a note and a constant, without repeats."""
    return F.array_join(F.array_distinct(clean_list(F.array(_c(flag), F.substring(_c(note), 1, 260), F.lit(constant)))), " ")


def localized(candidates: list, names: dict[str, str], fallback) -> Column:
    """The first of several names that the dictionary has, else the fallback."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(*[F.try_element_at(table, F.lower(F.trim(_c(c)))) for c in candidates], _c(fallback))


def label_of(value, labels: dict[str, str]) -> Column:
    """A label from a dictionary, the value itself without one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), _c(value)), _c(value))


def pick(items, number) -> Column:
    """An item by number, wrapping around."""
    a = _c(items)
    return F.when(F.size(a) > 0, F.try_element_at(a, F.pmod(_c(number), F.greatest(F.size(a), F.lit(1))).cast("int") + 1))


def has_any(text, keywords) -> Column:
    """FLT24: a keyword in the lower-case text."""
    return any_phrase(F.lower(_c(text)), keywords)

"""References to records that do not exist (yet, or any more).

Parent and child keys are united in long form, tagged, and grouped by parent table and key (two
64-bit hashes of both): a group that lacks the parent flag has only orphans. Where there is a parent,
its life decides: a reference at a time is live if, of the parents that started by then, one ends
later. Repeated parents are first reduced to the latest end of each start, a group's starts then make
one short list, and each reference looks its time up in the list of its key.

Hot keys: references of a key with more than HOT_ROWS of them are salted, and the key's list is
repeated for each salt. A key with more than MAX_STARTS different starts gets no list: its rows are
placed in time instead. The running latest end is carried over days, then over the seconds of a day,
and within a second (at most a million starts, by the resolution of the clock) a sorted scan decides;
the references of a hot second are salted as well. So no task ever holds more than a bounded part
of a key, and no reference is left out.

Defined results: a NULL in a key part matches no parent; no time finds no parent started; NULL end
means open; NULL start means that the parent never starts, so it neither makes a reference live nor
started; repeated rows count once; empty inputs give no rows; columns not named here are never read.
Keys are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.session import bounded, stored

_OPEN = "timestamp_ntz'9999-12-31 00:00:00'"
_NEVER = "timestamp_ntz'9999-12-31 00:00:01'"
#: Keys with more different starts than this are placed in time by sorted scans.
MAX_STARTS = 1_000
#: References of one key (or of one second of it) per salt.
HOT_ROWS = 1_000_000
#: Lists of hot and of long keys are broadcast up to so many (40 bytes each).
BROADCAST_KEYS = 500_000
_KEY = ["k1", "k2"]


def _key(table: str, keys: Sequence[Column]) -> list[Column]:
    """Two hashes of the table and the key parts; a NULL part makes both NULL."""
    known = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return [F.when(known, F.xxhash64(F.lit(seed), F.lit(table), *keys)).alias(n) for seed, n in enumerate(_KEY)]


def parent_rows(df: DataFrame, table: str, keys: Sequence[Column], start: Column, end: Column) -> DataFrame:
    """(k1, k2, start, until) of the targets; rows with a NULL key part can't be referred to and are left out."""
    rows = df.select(*_key(table, keys), F.coalesce(start, F.expr(_NEVER)).alias("start"), F.coalesce(end, F.expr(_OPEN)).alias("until"))
    return rows.dropna(subset=_KEY)


def child_rows(df: DataFrame, parent_table: str, table: str, row_id: Column, keys: Sequence[Column], at: Column) -> DataFrame:
    """(k1, k2, at, table_name, row_id) of the references."""
    return df.select(*_key(parent_table, keys), at.alias("at"), F.lit(table).alias("table_name"), row_id.alias("row_id"))


def key_groups(starts: DataFrame, children: DataFrame) -> DataFrame:
    """(k1, k2, starts, children): how many different starts and references each key has, from the tagged long form."""
    long = starts.select(*_KEY, F.lit(1).alias("parent"), F.lit(0).alias("child")).unionByName(children.dropna(subset=_KEY).select(*_KEY, F.lit(0).alias("parent"), F.lit(1).alias("child")))
    return long.groupBy(*_KEY).agg(F.sum("parent").alias("starts"), F.sum("child").alias("children"))


def find_orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(table_name, row_id, at, orphan_kind) of the references without a live target, once per distinct reference."""
    starts = stored(parents.groupBy(*_KEY, "start").agg(F.max("until").alias("until")), "starts")
    groups = stored(key_groups(starts, children).where("children > 0 AND starts > 0"), "key_groups")
    lists = _salted_lists(starts, groups)
    salts = bounded(_salts(groups, _KEY), BROADCAST_KEYS)
    asked = children.join(salts, _KEY, "left").withColumn("salt", _salt()).drop("salts")
    long_keys = groups.where(F.col("starts") > MAX_STARTS).select(*_KEY)
    scanned = None
    if not long_keys.isEmpty():
        long_keys = bounded(long_keys, BROADCAST_KEYS)
        scanned = _scan(starts.join(long_keys, _KEY, "left_semi"), children.join(long_keys, _KEY, "left_semi"))
        asked = asked.join(long_keys, _KEY, "left_anti")
    listed = asked.join(lists, [*_KEY, "salt"], "left")
    until = F.expr("array_max(transform(filter(lives, l -> l.start <= at), l -> l.until))")
    found = listed.select("table_name", "row_id", "at", _kind(F.col("lives").isNull(), until).alias("orphan_kind"))
    found = found if scanned is None else found.unionByName(scanned)
    return found.where("orphan_kind IS NOT NULL").distinct()


def _kind(unknown: Column, until: Column) -> Column:
    """The kind of orphan, NULL for a live reference; ``until``: the latest end among parents started by the reference's time, NULL if none has."""
    return F.when(unknown, "missing").when(until.isNull(), "late").when(until <= F.col("at"), "deleted")


def _salts(groups: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, salts): the hot ones among ``groups`` (key, children) and over how many salts their references are spread."""
    return groups.where(F.col("children") > HOT_ROWS).select(*key, F.ceil(F.col("children") / HOT_ROWS).cast("int").alias("salts"))


def _salt() -> Column:
    """The salt of a reference; those without a key, which meet nothing, are spread as well."""
    spread = F.when(F.col("k1").isNull(), 1 << 20).otherwise(F.coalesce("salts", F.lit(1)))
    return F.pmod(F.xxhash64("table_name", "row_id"), spread).cast("int")


def _salted_lists(starts: DataFrame, groups: DataFrame) -> DataFrame:
    """(k1, k2, salt, lives): the lives of each key that has references and no more than MAX_STARTS starts, once per salt."""
    asked = groups.where(F.col("starts") <= MAX_STARTS).select(*_KEY, "children")
    lives = starts.join(asked, _KEY).groupBy(*_KEY, "children").agg(F.collect_list(F.struct("start", "until")).alias("lives"))
    salts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("children") / HOT_ROWS), F.lit(1)).cast("int") - 1)
    return lives.select(*_KEY, F.explode(salts).alias("salt"), "lives")


def _carried(spans: DataFrame, outer: Sequence[str], unit: str) -> DataFrame:
    """``spans`` (outer..., unit, until) with ``before``: the latest end among the earlier units of the same outer ones."""
    earlier = W.partitionBy(*outer).orderBy(unit).rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("before", F.max("until").over(earlier))


def _scan(starts: DataFrame, children: DataFrame) -> DataFrame:
    """The kinds of references to keys with very many starts: ends carried over days and seconds, then a sorted scan."""
    day, second = [*_KEY, "day"], [*_KEY, "day", "second"]
    none = lambda kind: F.lit(None).cast(kind)
    rows = starts.select(*_KEY, F.col("start").alias("at"), F.lit(0).alias("tag"), "until", none("string").alias("table_name"), none("long").alias("row_id")).unionByName(
        children.select(*_KEY, "at", F.lit(1).alias("tag"), none("timestamp_ntz").alias("until"), "table_name", "row_id")
    )
    rows = rows.where("at IS NOT NULL").withColumn("day", F.col("at").cast("date")).withColumn("second", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', at)"))
    seconds = stored(rows.groupBy(*second).agg(F.max("until").alias("until"), F.sum("tag").alias("children")), "seconds")
    days = _carried(seconds.groupBy(*day).agg(F.max("until").alias("until")), _KEY, "day").select(*day, F.col("before").alias("day_before"))
    carried = _carried(seconds, day, "second").join(days, day, "left")
    salts = F.ceil(F.col("children") / HOT_ROWS).cast("int")
    carried = carried.where("children > 0").select(*second, salts.alias("salts"), F.greatest("before", "day_before").alias("before"))
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    placed = rows.where("tag = 1").join(carried.drop("before"), second).withColumn("salt", _salt()).drop("salts")
    lives = rows.where("tag = 0").join(carried.drop("before"), second).withColumn("salt", copies).drop("salts")
    # The head of a second comes first: it has no time of its own.
    heads = carried.select(*second, none("timestamp_ntz").alias("at"), F.lit(-1).alias("tag"), F.col("before").alias("until"), none("string").alias("table_name"), none("long").alias("row_id"), copies.alias("salt"))
    scan = W.partitionBy(*second, "salt").orderBy("at", "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = placed.unionByName(lives).unionByName(heads).withColumn("ends", F.max("until").over(scan)).where("tag = 1")
    timeless = children.where("at IS NULL").select("table_name", "row_id", "at", F.lit("late").alias("orphan_kind"))
    return seen.select("table_name", "row_id", "at", _kind(F.lit(False), F.col("ends")).alias("orphan_kind")).unionByName(timeless)


def _fold(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def attribute_orphans(reference_types: DataFrame, object_attributes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Orphans of value types (to reference types) and of data paths (to attributes)."""
    types = parent_rows(reference_types, "reference_types", [F.col("dump_id"), F.lower("uuid")], F.col("registered_at"), F.col("deleted_at"))
    owner = [F.col("dump_id"), F.col("object_type"), F.col("object_name")]
    attributes = parent_rows(object_attributes, "object_attributes", [*owner, _fold("section_name"), _fold("attr_name")], F.col("recorded_at"), F.col("removed_at"))
    refs = child_rows(
        object_attributes.where(F.col("value_type").startswith("Ref#")),
        "reference_types",
        "object_attributes",
        F.col("attr_id"),
        [F.col("dump_id"), F.lower(F.substring("value_type", 5, 1 << 20))],
        F.col("recorded_at"),
    )
    paths = bindings.withColumn("__parts", F.split("data_path", "[.]", -1)).where(F.size("__parts").isin(2, 3))
    middle = F.when(F.size("__parts") == 3, F.lower(F.trim(F.col("__parts")[1]))).otherwise("")
    bound = child_rows(paths, "object_attributes", "bindings", F.col("binding_id"), [*owner, middle, F.lower(F.trim(F.element_at("__parts", -1)))], F.col("bound_at"))
    return find_orphans(types.unionByName(attributes), refs.unionByName(bound))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(table_name, month, orphan_kind, orphans): counts per table and month of the referring row."""
    month = F.date_format("at", "yyyy-MM")
    return orphans.groupBy("table_name", month.alias("month"), "orphan_kind").agg(F.count("*").alias("orphans"))

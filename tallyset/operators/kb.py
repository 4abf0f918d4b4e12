"""A local statement table in the place of a knowledge-base endpoint.

edges (child, parent): subclass links; members (entity_id, class_id); statements (entity_id, stmt_id, prop_id, value, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import staged


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) with each node its own ancestor. Level by level, from pairs that are new: each level is staged, so
    circles end and a pair that many paths give is one row."""
    links = staged(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
    own = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    every = own.select("node", F.col("node").alias("ancestor"))
    new = staged(links.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")))
    while not new.isEmpty():
        every = every.unionByName(new)
        above = new.join(links, new["ancestor"] == links["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        new = staged(above.join(every, ["node", "ancestor"], "left_anti"))
    return every


def class_members(members: DataFrame, up: DataFrame) -> DataFrame:
    """(entity_id, class_id) with the superclasses of an entity's classes."""
    return members.join(up, members["class_id"] == up["node"]).select("entity_id", F.col("ancestor").alias("class_id")).distinct()


def member_counts(classes: DataFrame, all_members: DataFrame) -> DataFrame:
    """(class_id, n), 0 for a class without members."""
    n = all_members.groupBy("class_id").agg(F.countDistinct("entity_id").alias("n"))
    return classes.join(n, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))


def members_of(all_members: DataFrame, class_id: str, limit: int) -> DataFrame:
    return all_members.filter(F.col("class_id") == class_id).select("entity_id").distinct().orderBy("entity_id").limit(limit)


def with_links(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities with an optional site link."""
    return entities.join(links, "entity_id", "left")


def property_usage(statements: DataFrame, entities: DataFrame, limit: int = 1000) -> DataFrame:
    """(prop_id, entity_count, count) over a set of entities, the most used first."""
    rows = statements.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return rows.groupBy("prop_id").agg(F.countDistinct("entity_id").alias("entity_count"), F.count("*").alias("count")).orderBy(F.desc("entity_count"), "prop_id").limit(limit)


def one_quantity(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with one distinct value, and that value."""
    return rows.groupBy(group).agg(F.countDistinct(value).alias("k"), F.any_value(value).alias(value)).filter("k = 1").drop("k")


def not_structural(props: DataFrame, structural: DataFrame) -> DataFrame:
    return props.join(structural.select("prop_id").distinct(), "prop_id", "left_anti")


def full_properties(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Properties that every entity of a set has (relational division)."""
    ids = entities.select("entity_id").distinct()
    n = ids.agg(F.count("*").alias("n"))
    have = statements.join(ids, "entity_id", "left_semi").groupBy("prop_id").agg(F.countDistinct("entity_id").alias("have"))
    return have.join(F.broadcast(n)).filter("have = n and n > 0").select("prop_id")


def truthy(statements: DataFrame) -> DataFrame:
    """Preferred statements of an entity and property; normal ones where none is preferred; deprecated ones never."""
    best = F.max(F.when(F.col("rank") == "preferred", 2).when(F.col("rank") == "normal", 1).otherwise(0)).over(Window.partitionBy("entity_id", "prop_id"))
    rows = statements.withColumn("__b", best)
    return rows.filter(((F.col("__b") == 2) & (F.col("rank") == "preferred")) | ((F.col("__b") == 1) & (F.col("rank") == "normal"))).drop("__b")


def live(statements: DataFrame) -> DataFrame:
    """Preferred and normal statements."""
    return statements.filter(F.col("rank").isin("preferred", "normal"))


def nested(statements: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """Statements with their qualifiers (stmt_id, qualifier, value) as a map of lists."""
    q = qualifiers.groupBy("stmt_id", "qualifier").agg(F.array_sort(F.collect_list("value")).alias("v")).groupBy("stmt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qualifier", "v")))).alias("qualifiers"))
    return statements.join(q, "stmt_id", "left")


def by_qualifier(statements: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(qualifier, value, entities): which entities have each qualifier value."""
    return qualifiers.join(statements.select("stmt_id", "entity_id"), "stmt_id").groupBy("qualifier", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))


def shared_qualifier(statements: DataFrame, qualifiers: DataFrame, qualifier: str) -> DataFrame:
    """Values of a qualifier that every entity has."""
    n = statements.agg(F.countDistinct("entity_id").alias("n"))
    rows = qualifiers.filter(F.col("qualifier") == qualifier).join(statements.select("stmt_id", "entity_id"), "stmt_id")
    return rows.groupBy("value").agg(F.countDistinct("entity_id").alias("have")).join(F.broadcast(n)).filter("have = n").select("value")


def shared_classes(members: DataFrame, up: DataFrame, entities: DataFrame) -> DataFrame:
    """Classes that all of a set of entities belong to."""
    ids = entities.select("entity_id").distinct()
    n = ids.agg(F.count("*").alias("n"))
    all_ = class_members(members.join(ids, "entity_id", "left_semi"), up)
    return all_.groupBy("class_id").agg(F.countDistinct("entity_id").alias("have")).join(F.broadcast(n)).filter("have = n").select("class_id")


def most_specific(classes: DataFrame, up: DataFrame) -> DataFrame:
    """Classes of a set without a proper descendant in the set."""
    below = up.filter("node <> ancestor").join(classes.select(F.col("class_id").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("class_id")).distinct()
    return classes.join(below, "class_id", "left_anti")


def main_topics(lists: DataFrame) -> DataFrame:
    """Lists (list_id, class_id, prop_id, value, topic) that name one class and one condition, with their topics."""
    out = lists.groupBy("list_id").agg(F.countDistinct("class_id").alias("classes"), F.countDistinct("prop_id", "value").alias("conditions"), F.array_sort(F.collect_set("topic")).alias("topics"), F.min("class_id").alias("class_id"), F.min("prop_id").alias("prop_id"), F.min("value").alias("value"))
    return out.filter("classes = 1 and conditions = 1").drop("classes", "conditions")


def is_member(all_members: DataFrame, entity_id: str, class_id: str) -> bool:
    return not all_members.filter((F.col("entity_id") == entity_id) & (F.col("class_id") == class_id)).isEmpty()


def pattern(statements: DataFrame, view: str, sql: str) -> DataFrame:
    """A custom pattern, as SQL over a view of the statements."""
    statements.createOrReplaceTempView(view)
    return statements.sparkSession.sql(sql)


def labels(ids: DataFrame, table: DataFrame, fallback: str = "id") -> DataFrame:
    """Labels of ids; the id itself where there is none."""
    return ids.join(table, "id", "left").withColumn("label", F.coalesce("label", fallback))


def class_funnel(classes: DataFrame, all_members: DataFrame, statements: DataFrame, most: int) -> DataFrame:
    """Classes (class_id, quantity) fit for questions: over one member, at most `most`, as many as stated, and some
    property that every member has."""
    n = all_members.groupBy("class_id").agg(F.countDistinct("entity_id").alias("n"))
    ok = classes.join(n, "class_id").filter((F.col("n") > 1) & (F.col("n") <= most) & (F.col("n") == F.col("quantity")))
    have = all_members.join(ok.select("class_id"), "class_id", "left_semi").join(statements.select("entity_id", "prop_id").distinct(), "entity_id").groupBy("class_id", "prop_id").agg(F.countDistinct("entity_id").alias("have"))
    return have.join(ok, "class_id").filter("have = n").groupBy("class_id", "n").agg(F.array_sort(F.collect_list("prop_id")).alias("props"))


def frequent_type(items: DataFrame) -> DataFrame:
    """The most frequent type of items (entity_id, type, label), each item counting once; ties go to the least type, and a
    type has its least label."""
    return items.select("entity_id", "type", "label").dropDuplicates(["entity_id", "type"]).groupBy("type").agg(F.count("*").alias("n"), F.min("label").alias("label")).orderBy(F.desc("n"), "type").limit(1)


def typed_value(binding: F.Column, kind: F.Column) -> F.Column:
    """A binding (JSON) as (number, year, label): a quantity's number, a time's year, an item's label or id; null if bad."""
    get = lambda p: F.get_json_object(binding, p)
    number = F.when(kind == "Quantity", F.regexp_replace(get("$.value"), r"^\+", "").try_cast("double"))
    year = F.when((kind == "Time") & F.contains(get("$.value"), F.lit("T")), F.regexp_extract(get("$.value"), r"^[+]?(-?\d+)-", 1).try_cast("int"))
    label = F.when(kind == "WikibaseItem", F.coalesce(get("$.label"), get("$.id")))
    return F.struct(number.alias("number"), year.alias("year"), label.alias("label"))


def value_records(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """A property's record: values, entity count and range; null ranges and constant properties go."""
    return rows.groupBy(*group).agg(F.countDistinct("entity_id").alias("entity_count"), F.countDistinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most")).filter("n_values >= 2")


def string_domain(values: F.Column) -> F.Column:
    """All of a list of texts are without digits."""
    return F.forall(values, lambda v: ~v.rlike("[0-9]"))

"""Relations: their members as elements, and rules that act on members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import NAMESPACE, VEHICLES, Action, Rule, RuleError, Variable, filtered, run_rules, template

_PART = "struct<text:string,local:string>"
_STEP = f"struct<role:string,once:boolean,op:string,key:string,values:array<array<{_PART}>>>"


def resolved(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """members with the tags of what they name, and ``found``; each table has id and tags."""
    sides = [members.where(F.col("member_type") == kind).join(t.select(F.col("id").alias("member_id"), F.col("tags").alias("member_tags"), F.lit(True).alias("hit")), "member_id", "left") for kind, t in (("node", nodes), ("way", ways), ("relation", relations))]
    out = reduce(DataFrame.unionByName, sides)
    return out.select(*members.columns, "member_tags", F.coalesce("hit", F.lit(False)).alias("found"))


def member_lengths(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel_id, metres): the length of a relation, as the sum over its way members; ways has way_id and metres."""
    mine = members.where("member_type = 'way'").select("rel_id", F.col("member_id").alias("way_id"))
    return mine.join(ways.select("way_id", "metres"), "way_id").groupBy("rel_id").agg(F.sum("metres").alias("metres"))


def _parts(value: str, tag) -> Column:
    """A template whose variables of the relation are put in; those of the member stay open."""
    out = []
    for part in template(value):
        if isinstance(part, Variable) and part.local:
            if part.filters:
                raise RuleError("a tag of a member takes no filter")
            out.append(F.struct(F.lit(None).cast("string").alias("text"), F.lit(part.key).alias("local")))
        else:
            text = F.lit(part) if isinstance(part, str) else tag(part.key)
            for f in part.filters if isinstance(part, Variable) else ():
                text = filtered(text, f, tag)
            out.append(F.struct(text.alias("text"), F.lit(None).cast("string").alias("local")))
    return F.array(*out)


def _steps(action: Action, tag, namespace: str) -> list[Column]:
    """The changes of an apply as structs."""

    def step(op: str, key: str, values: list[str]) -> Column:
        alternatives = F.array(*[_parts(v, tag) for v in values]) if values else F.array().cast(f"array<array<{_PART}>>")
        row = F.struct(F.lit(action.role).cast("string").alias("role"), F.lit(action.name == "apply_once").alias("once"), F.lit(op).alias("op"), F.lit(key).alias("key"), alternatives.alias("values"))
        return row.cast(_STEP)

    out = []
    for a in action.inner:
        if a.name in ("setaccess", "addaccess"):
            out += [step(a.name.removesuffix("access"), f"{namespace}:{v}", a.values) for v in VEHICLES]
        elif a.name == "name":
            out.append(step("add", f"{namespace}:label:1", a.values))
        elif a.name in ("set", "add", "delete", "deletealltags", "rename", "addlabel"):
            out.append(step(a.name, a.key, a.values))
        elif a.name not in ("echo", "echotags"):
            raise RuleError(f"{a.name} cannot be applied to members")
    return out


def _folded(tags: Column, steps: Column, namespace: str) -> Column:
    """The tags of a member after all steps, in their order."""
    as_map = "map<string,string>"
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda key, _: key != k), F.create_map(k, v)).cast(as_map)

    def value(m: Column, s: Column) -> Column:
        text = lambda p: F.coalesce(p["text"], F.try_element_at(m, p["local"]))
        built = F.transform(s["values"], lambda alt: F.when(~F.exists(alt, lambda p: text(p).isNull()), F.array_join(F.transform(alt, text), "")))
        return F.try_element_at(F.filter(built, lambda v: v.isNotNull()), F.lit(1))

    def one(m: Column, s: Column) -> Column:
        v, own = value(m, s), F.try_element_at(m, s["key"])
        label = lambda i: F.lit(f"{namespace}:label:{i}")
        used = F.array_compact(F.array(*[F.try_element_at(m, label(i)) for i in range(1, 5)]))
        free = F.coalesce(*[F.when(F.try_element_at(m, label(i)).isNull(), label(i)) for i in range(1, 5)])
        gone = F.map_filter(m, lambda k, _: k != s["key"])
        return (
            F.when((s["op"] == "set") & v.isNotNull(), put(m, s["key"], v))
            .when((s["op"] == "add") & v.isNotNull() & own.isNull(), put(m, s["key"], v))
            .when(s["op"] == "delete", gone)
            .when(s["op"] == "deletealltags", F.map_filter(m, lambda k, _: F.lit(False)))
            .when((s["op"] == "rename") & own.isNotNull() & v.isNotNull(), put(gone, v, own))
            .when((s["op"] == "addlabel") & v.isNotNull() & free.isNotNull() & ~F.array_contains(used, v), put(m, free, v))
            .otherwise(m)
        )

    return F.aggregate(steps, F.coalesce(tags, F.create_map().cast(as_map)).cast(as_map), one)


def apply_rules(relations: DataFrame, members: DataFrame, rules: list[Rule], namespace: str = NAMESPACE) -> DataFrame:
    """(member_type, member_id, tags_after): members that relation rules act on, with their new tags.

    relations has rel_id and tags, members is ``resolved``. Relations act by rising rel_id, within one its
    rules, then the members by place, each with all actions of an ``apply``; ``apply_once`` takes a member
    at its first place alone. ``${}`` reads the relation's tags as they are when the rule fires, ``$()`` the member's.
    """
    tag_of = lambda key: F.try_element_at(F.col("tags"), F.lit(key))
    done = run_rules(relations.select("rel_id", "tags"), rules, tag_of, namespace=namespace, applies=lambda a, tag: _steps(a, tag, namespace))
    steps = done.select("rel_id", F.explode("applied").alias("a")).select("rel_id", "a.rule", "a.nth", F.posexplode("a.steps").alias("k", "s"))
    again = members.groupBy("rel_id", "role", "member_type", "member_id").agg(F.min("pos").alias("pos_first"), F.collect_list("pos").alias("places"))
    once = members.groupBy("rel_id", "member_type", "member_id").agg(F.min("pos").alias("pos_any"))
    mine = again.join(once, ["rel_id", "member_type", "member_id"])
    hit = steps.join(mine, "rel_id").where(F.col("s.role").isNull() | (F.col("s.role") == F.col("role")))
    first = F.when(F.col("s.role").isNull(), F.when(F.col("pos_first") == F.col("pos_any"), F.array("pos_first")).otherwise(F.array().cast("array<int>"))).otherwise(F.array("pos_first"))
    hit = hit.withColumn("pos", F.explode(F.when(F.col("s.once"), first.cast("array<int>")).otherwise(F.col("places").cast("array<int>"))))
    # The steps on one member: as many as relations and rules touch it.
    folded = hit.groupBy("member_type", "member_id").agg(F.sort_array(F.collect_list(F.struct("rel_id", "rule", "nth", "pos", "k", "s"))).alias("steps"))
    tags = members.where("found").groupBy("member_type", "member_id").agg(F.any_value("member_tags").alias("member_tags"))
    out = folded.join(tags, ["member_type", "member_id"])
    return out.select("member_type", "member_id", _folded(F.col("member_tags"), F.transform("steps", lambda x: x["s"]), namespace).alias("tags_after"))



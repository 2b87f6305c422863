"""The twelve domain query tools as join pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vergraph.functions.values import list_field, text_field
from vergraph.plans.graph import Graph
from vergraph.schema import ENTITY_TYPES, VALID_ENDPOINTS

from . import search, similarity, traverse
from .versions import new_version


def _rows(graph: Graph, *columns: str) -> DataFrame:
    return graph.latest().select("id", *columns)


def _of_type(graph: Graph, id_: str, kind: str) -> DataFrame:
    """The id's row if it has the type, else nothing: wrong ids give empty results."""
    return graph.latest().where((F.col("id") == id_) & (F.col("entity_type") == kind)).select("id")


def devices_in_room(graph: Graph, room: str) -> DataFrame:
    """id, name: devices located in a room, one row per edge (TOL1)."""
    place = _of_type(graph, room, "room").withColumnRenamed("id", "dst")
    inside = graph.edges(["located_in"]).join(place, "dst", "left_semi").select(F.col("src").alias("id"))
    return inside.join(graph.latest().where("entity_type = 'device'").select("id", "name"), "id")


def device_controls(graph: Graph, device: str) -> DataFrame:
    """id, capabilities, services and the controlled entities (TOL2)."""
    own = graph.latest().where((F.col("id") == device) & (F.col("entity_type") == "device"))
    controlled = graph.edges(["controls"]).where(F.col("src") == device).join(_rows(graph, "name", "entity_type").withColumnRenamed("id", "dst"), "dst")
    listed = controlled.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("id"), "name", "entity_type"))).alias("controls"))
    none = F.from_json(F.lit("[]"), "array<struct<id: string, name: string, entity_type: string>>")
    return own.select("id", list_field(F.col("content"), "capabilities").alias("capabilities"), list_field(F.col("content"), "services").alias("services")).join(listed, "id", "left").withColumn("controls", F.coalesce("controls", none))


def room_connections(graph: Graph, room: str) -> DataFrame:
    """id, name, via: rooms connected either way; outgoing edges first, one row per room (TOL3)."""
    e = graph.relationships.where("relationship_type = 'connects_to'")
    via = F.coalesce(text_field(F.col("properties"), "via"), F.lit("direct")).alias("via")
    out = e.where(F.col("from_entity_id") == room).select(F.col("to_entity_id").alias("id"), F.lit(0).alias("way"), F.col("id").alias("rel"), via)
    into = e.where(F.col("to_entity_id") == room).select(F.col("from_entity_id").alias("id"), F.lit(1).alias("way"), F.col("id").alias("rel"), via)
    first = F.row_number().over(Window.partitionBy("id").orderBy("way", "rel"))
    both = out.union(into).where(F.col("id") != room).withColumn("_n", first).where("_n = 1")
    return both.join(graph.latest().where("entity_type = 'room'").select("id", "name"), "id").select("id", "name", "via")


def procedures_for_device(graph: Graph, device: str) -> DataFrame:
    """kind, id, name: procedures for the device, manuals that document it (TOL10)."""
    rows = _rows(graph, "name", "entity_type")
    procedures = graph.edges(["procedure_for"]).where(F.col("dst") == device).select(F.col("src").alias("id")).join(rows.where("entity_type = 'procedure'"), "id")
    manuals = graph.edges(["documented_by"]).where(F.col("src") == device).select(F.col("dst").alias("id")).join(rows.where("entity_type = 'manual'"), "id")
    return procedures.select(F.lit("procedure").alias("kind"), "id", "name").union(manuals.select(F.lit("manual").alias("kind"), "id", "name"))


def automations_in_room(graph: Graph, room: str) -> DataFrame:
    """id, name, affected (ids in the room that it automates) (TOL11, JON10)."""
    inside = graph.edges(["located_in"]).where(F.col("dst") == room).select(F.col("src").alias("device"))
    hits = graph.edges(["automates"]).join(inside, F.col("dst") == F.col("device")).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("device")).alias("affected"))
    return hits.join(graph.latest().where("entity_type = 'automation'").select("id", "name"), "id").select("id", "name", "affected")


def entity_details(graph: Graph, id_: str) -> DataFrame:
    """id, name, entity_type, version_count, outgoing, incoming edge lists (TOL8)."""
    e = graph.edges()
    own = graph.latest().where(F.col("id") == id_).select("id", "name", "entity_type")
    count = graph.entities.where(F.col("id") == id_).groupBy("id").agg(F.count("*").alias("version_count"))

    def listed(here: str, there: str, name: str) -> DataFrame:
        return e.where(F.col(here) == id_).groupBy(F.col(here).alias("id")).agg(F.array_sort(F.collect_list(F.struct("relationship_type", F.col(there).alias("other")))).alias(name))

    none = F.from_json(F.lit("[]"), "array<struct<relationship_type: string, other: string>>")
    out = own.join(count, "id").join(listed("src", "dst", "outgoing"), "id", "left").join(listed("dst", "src", "incoming"), "id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("outgoing", "incoming")})


def path_between(graph: Graph, start: str, end: str, max_depth: int = 10) -> DataFrame:
    """One row: found, length, path (TOL7); not found is a result, not an error."""
    found = traverse.find_path(graph, start, end, max_depth).select(F.lit(True).alias("found"), "length", "path")
    asked = graph.relationships.sparkSession.createDataFrame([(True,)], "found boolean")
    return asked.join(found, "found", "left").select(F.col("path").isNotNull().alias("found"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def checked_relationship(graph: Graph, from_id: str, to_id: str, rel_type: str) -> DataFrame:
    """The edge to be created, pinned to the current versions, if both ends exist
    and their types allow it; else nothing (TOL6)."""
    a, b = (graph.latest().where(F.col("id") == i).select(F.col("id").alias(f"{s}_entity_id"), F.col("version").alias(f"{s}_entity_version"), F.col("entity_type").alias(f"{s}_type")) for s, i in (("from", from_id), ("to", to_id)))
    allowed = F.lit(False)
    for x, y in VALID_ENDPOINTS.get(rel_type, ()):
        allowed = allowed | ((F.col("from_type") == x) & (F.col("to_type") == y))
    return a.crossJoin(b).where(allowed).select(F.expr("uuid()").alias("id"), "from_entity_id", "from_entity_version", "to_entity_id", "to_entity_version", F.lit(rel_type).alias("relationship_type"), F.lit("{}").alias("properties"))  # single rows


def created_entities(wanted: DataFrame, user: str, now: Column) -> DataFrame:
    """First versions with new ids and no parents of rows of entity_type, name,
    content (TOL5); a type that is not known raises when it is met."""
    from vergraph.functions.values import version_text

    known = F.col("entity_type").isin(*ENTITY_TYPES)
    kind = F.when(known, F.col("entity_type")).otherwise(F.raise_error(F.concat(F.lit("unknown entity type "), F.coalesce("entity_type", F.lit("null")))))
    return wanted.select(F.expr("uuid()").alias("id"), version_text(now, F.lit(0), F.lit(user)).alias("version"), kind.alias("entity_type"), "name", "content", F.lit(user).alias("user_id"), F.array().cast("array<string>").alias("parent_versions"), F.lit(True).alias("is_latest"))


def created_entity(graph: Graph, entity_type: str, name: str, content: str, user: str, now: Column) -> DataFrame:
    """One of them."""
    if entity_type not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {entity_type}")
    return created_entities(graph.relationships.sparkSession.createDataFrame([(entity_type, name, content)], "entity_type string, name string, content string"), user, now)


def updated_entity(graph: Graph, id_: str, changes: str, user: str, now: Column) -> DataFrame:
    """The next version of an entity (TOL12)."""
    rows = graph.latest().where(F.col("id") == id_)
    if "parent_versions" not in rows.columns:
        rows = rows.withColumn("parent_versions", F.array().cast("array<string>"))
    return new_version(rows, user, now, F.lit(0), F.lit(changes))


def call(graph: Graph, name: str, **arguments) -> DataFrame:
    """A tool by name; an unknown tool or entity type raises ValueError."""
    tools = {
        "get_devices_in_room": lambda room_id: devices_in_room(graph, room_id),
        "find_device_controls": lambda device_id: device_controls(graph, device_id),
        "get_room_connections": lambda room_id: room_connections(graph, room_id),
        "search_entities": lambda query, entity_types=None, limit=10: search.search_engine(graph.latest(), query, entity_types, limit),
        "create_entity": lambda **a: created_entity(graph, **a),
        "create_relationship": lambda from_id, to_id, relationship_type: checked_relationship(graph, from_id, to_id, relationship_type),
        "find_path": lambda from_id, to_id, max_depth=10: path_between(graph, from_id, to_id, max_depth),
        "get_entity_details": lambda entity_id: entity_details(graph, entity_id),
        "find_similar_entities": lambda entity_id, threshold=0.7, limit=10: similarity.similar_engine(graph.latest(), entity_id, threshold, limit),
        "get_procedures_for_device": lambda device_id: procedures_for_device(graph, device_id),
        "get_automations_in_room": lambda room_id: automations_in_room(graph, room_id),
        "update_entity": lambda **a: updated_entity(graph, **a),
    }
    if name not in tools:
        raise ValueError(f"unknown tool {name}")
    for kind in arguments.get("entity_types") or []:
        if kind not in ENTITY_TYPES:
            raise ValueError(f"unknown entity type {kind}")
    return tools[name](**arguments)

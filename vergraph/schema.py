"""Vocabulary of the versioned property graph."""

from __future__ import annotations

# The names of the graph's data model.
ENTITY_TYPES = ("home", "room", "device", "zone", "door", "window", "procedure", "manual", "note", "schedule", "automation", "app")
RELATIONSHIP_TYPES = ("located_in", "controls", "connects_to", "part_of", "manages", "documented_by", "procedure_for", "triggered_by", "depends_on", "contained_in", "monitors", "automates", "controlled_by_app", "has_blob")
#: Edges of these types point from child to parent; all others from parent to child.
CHILD_TO_PARENT = ("part_of", "located_in", "contained_in")
#: Endpoint types that each edge type allows; types without an entry are never valid.
VALID_ENDPOINTS = {
    "located_in": (("device", "room"), ("device", "zone"), ("room", "zone"), ("room", "home"), ("zone", "home")),
    "controls": (("device", "device"), ("automation", "device"), ("schedule", "device"), ("schedule", "automation")),
    "connects_to": (("room", "room"), ("door", "room"), ("window", "room"), ("zone", "zone")),
    "part_of": (("room", "home"), ("zone", "home"), ("device", "zone")),
    "documented_by": (("device", "manual"), ("device", "procedure"), ("home", "manual"), ("room", "note")),
    "procedure_for": (("procedure", "device"), ("procedure", "home")),
    "triggered_by": (("automation", "device"), ("automation", "schedule")),
    "manages": (("automation", "device"), ("schedule", "automation")),
    "monitors": (("device", "room"), ("device", "zone"), ("automation", "device")),
    "automates": (("automation", "device"), ("automation", "room"), ("automation", "zone")),
    "controlled_by_app": (("device", "app"), ("home", "app"), ("automation", "app")),
    "has_blob": (("device", "note"), ("manual", "note"), ("app", "note"), ("home", "note")),
}

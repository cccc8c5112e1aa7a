"""Wordings of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: wording of an edge type from its source and from its target
EDGE_LABELS = {
    "prime_agent_for": ("prime agent for", "has prime agent"),
    "operational_executor_agent_for": ("operational executor agent for", "has operational executor agent"),
    "operational_facilitator_for": ("operational facilitator for", "has operational facilitator"),
    "core_facilitator_for": ("core facilitator for", "has core facilitator"),
    "operational_govops_for": ("operational govops for", "has operational govops"),
    "core_govops_for": ("core govops for", "has core govops"),
    "aligned_delegate_for": ("aligned delegate for", "has aligned delegate"),
    "ranked_delegate_for": ("ranked delegate for", "has ranked delegate"),
    "holds_role_for": ("holds role for", "has role-holder"),
    "comprises": ("comprises", "part of"),
    "ecosystem_accord": ("binds", "party to"),
    "defines_entity": ("defines", "defined by"),
    "erg_member_for": ("ERG member of", "has ERG member"),
    "responsible_party_for": ("responsible party for", "has responsible party"),
    "has_address": ("has address", "owned by"),
    "mentions": ("mentions", "mentioned in"),
    "proxies_to": ("proxies to", "implementation of"),
    "parent_of": ("parent of", "child of"),
    "annotates": ("annotates", "annotated by"),
    "active_data_for": ("active data for", "has active data"),
    "cites": ("cites", "cited by"),
    "implements": ("implements", "implemented by"),
    "instance_of": ("instance of", "has instance"),
    "invoked_by": ("invoked by", "invoked"),
    "located_at": ("located at", "location of"),
    "has_status": ("has status", "status of"),
}


def edge_label(edge_type: Column, outbound: Column) -> Column:
    """The wording of an edge in a direction; the type itself if it has none."""
    label = lambda k: F.create_map(*[F.lit(x) for t, pair in EDGE_LABELS.items() for x in (t, pair[k])])[edge_type]
    return F.coalesce(F.when(outbound, label(0)).otherwise(label(1)), edge_type)

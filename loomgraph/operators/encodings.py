"""Visual encodings and settings: what a viewer shall show, kept with the graph."""

from __future__ import annotations

from typing import Any

from loomgraph.errors import SchemaProblem

NODE_KINDS = ("point_color", "point_size", "point_opacity", "point_label", "point_title", "point_icon", "point_badge")
EDGE_KINDS = ("edge_color", "edge_size", "edge_weight", "edge_opacity", "edge_label", "edge_title", "edge_icon", "edge_badge")


def encoding(kind: str):
    """``encode_KIND(column, ...)``: the column must be there; a mapping of values or a palette goes with it."""

    def run(g, column: str, **options: Any):
        table = g.with_nodes().nodes if kind in NODE_KINDS else g.edges
        if column not in table.columns:
            raise SchemaProblem(f"there is no column {column!r} to encode; columns: {', '.join(table.columns)}")
        if options.get("as_categorical") and options.get("as_continuous"):
            raise SchemaProblem("an encoding is categorical or continuous, not both")
        return setting(g, f"encode_{kind}", {"column": column} | {k: v for k, v in options.items() if v is not None})

    run.__name__ = f"encode_{kind}"
    return run


def setting(g, name: str, value: Any):
    return g.replace(settings=(g.settings or {}) | {name: value})


ENCODINGS = {f"encode_{k}": encoding(k) for k in (*NODE_KINDS, *EDGE_KINDS)} | {
    "encode_axis": lambda g, rows: setting(g, "axis", list(rows)), "name": lambda g, name: setting(g, "name", name), "description": lambda g, description: setting(g, "description", description),
    "style": lambda g, **options: setting(g, "style", ((g.settings or {}).get("style") or {}) | options), "settings": lambda g, **options: setting(g, "url_params", ((g.settings or {}).get("url_params") or {}) | options),
    "collections": lambda g, collections: setting(g, "collections", list(collections)),
}

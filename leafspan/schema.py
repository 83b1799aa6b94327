"""Column types of the token and node tables."""

from __future__ import annotations

ATTRS = "array<struct<name:string,value:string>>"
TOKENS = f"tok_no int, type string, name string, self_closing boolean, attrs {ATTRS}, data string"
NODES = (
    f"node_id int, parent_id int, sub_end int, depth int, child_no int, kind string, node_name string, local_name string, attrs {ATTRS}, content string, "
    "public_id string, system_id string, flags bigint, ns string, template_of int, ancestors array<int>, src_pos int"
)
NODE_STRUCT = "struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in NODES.split(", ")) + ">"

"""The canonical tables: one row per object, one row per data element."""

from __future__ import annotations

import re

PATH = "array<struct<tag:string,item:int>>"
ELEMENT = (
    "ordinal long, path " + PATH + ", path_text string, depth int, is_meta boolean, tag string, vr string, value_length long, is_complete boolean, "
    "str string, strs array<string>, ints array<bigint>, dbls array<double>, bin binary, bulk_uri string, is_bulk boolean, bulk_offset long"
)
ELEMENTS = "instance_id string, " + ELEMENT
ELEMENT_NAMES = tuple(x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", ELEMENT))
ELEMENT_STRUCT = "struct<" + ",".join(f"{n}:{x.strip().split(' ', 1)[1]}" for n, x in zip(ELEMENT_NAMES, re.split(r",(?![^<]*>)", ELEMENT), strict=True)) + ">"
#: A whole object in a row: its place among the objects of its source, and its elements in order. An object that does not parse has a message and no elements.
PARSED = f"instance_id string, seen string, transfer_syntax_uid string, error_message string, elements array<{ELEMENT_STRUCT}>"
OBJECTS = "instance_id string, source_uri string, part_no int, content_type string, content binary"
FRAMES = "instance_id string, frame_index int, rows int, columns int, samples int, bits int, photometric string, bytes binary"
CONCERNS = "instance_id string, ordinal long, severity string, code string, message string, event string, path_text string, tag string"

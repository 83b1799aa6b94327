"""What a parse keeps: options and token filters, evaluated inside the parser."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class ParseOptions:
    """Options of tokenizer and tree builder.

    ``keep_attrs``: names kept on every element, or a map from element name to names,
    or a predicate (element, attribute); None keeps all. ``merge_text`` joins adjacent
    text as the standard has it; without it each run is a node of its own.
    ``reference_flags`` makes the builder treat as special what the reference's table
    marks so, instead of the standard's category. ``strict``, ``frames_off``,
    ``embedded``, ``custom_elements_everywhere`` exist to be rejected clearly."""

    skip_script_text: bool = False
    skip_raw_text: bool = False
    skip_plaintext: bool = False
    skip_rcdata_text: bool = False
    skip_cdata: bool = False
    skip_data_text: bool = False
    skip_comments: bool = False
    skip_processing_instructions: bool = False
    processing_instructions: bool = False
    keep_attrs: object = None
    decode_entities: bool = True
    scripting: bool = False
    preserve_attr_case: bool = False
    emit_whitespace: bool = False
    merge_text: bool = True
    positions: bool = False
    reference_flags: bool = False
    strict: bool = False
    frames_off: bool = False
    embedded: bool = False
    custom_elements_everywhere: bool = False

    def __post_init__(self):
        for name in ("strict", "frames_off", "embedded", "custom_elements_everywhere"):
            if getattr(self, name):
                raise NotImplementedError(f"option {name} is not supported")

    def keeps(self, element: str) -> Callable[[str], bool] | None:
        """Which attributes of an element are kept; None for all."""
        k = self.keep_attrs
        if k is None:
            return None
        if callable(k):
            return lambda a: k(element, a)
        if isinstance(k, dict):
            k = k.get(element, ())
        return frozenset(k).__contains__


@dataclass(frozen=True)
class TokenFilter:
    """Keeps the first element that a start tag opens for which ``starts`` holds, and what
    is in it: from that tag on until as many tags have closed as opened. Its own end tag
    is not kept. ``void_aware`` doesn't count elements that have no end tag; without
    it they count as any other, so that the kept part runs past the element's end."""

    starts: Callable[[str, list[tuple[str, str]]], bool]
    void_aware: bool = False


def first_tag(tag: str, void_aware: bool = False) -> TokenFilter:
    return TokenFilter(lambda name, attrs: name == tag, void_aware)


def element_with_id(tag: str, ident: str, void_aware: bool = False) -> TokenFilter:
    return TokenFilter(lambda name, attrs: name == tag and ("id", ident) in attrs, void_aware)

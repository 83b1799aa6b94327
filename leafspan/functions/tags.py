"""Element categories of the public HTML parsing standard, and the flag table of the
reference's element factory, which differs from it in places."""

from __future__ import annotations


def _w(text: str) -> frozenset[str]:
    return frozenset(text.split())


# ------------------------------------------------------------------ fixed values
VOID = _w("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAWTEXT = _w("style xmp iframe noembed noframes")
RCDATA = _w("title textarea")
HEADINGS = _w("h1 h2 h3 h4 h5 h6")
FORMATTING = _w("a b big code em font i nobr s small strike strong tt u")
SPECIAL = _w(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
)
IMPLIED_END = _w("dd dt li optgroup option p rb rp rt rtc")
THOROUGH_END = IMPLIED_END | _w("caption colgroup tbody td tfoot th thead tr")
SCOPE = _w("applet caption html table td th marquee object template")
LIST_SCOPE = SCOPE | _w("ol ul")
BUTTON_SCOPE = SCOPE | _w("button")
TABLE_SCOPE = _w("html table template")
MATH_TIPS = _w("mi mo mn ms mtext")
MATH_SCOPED = MATH_TIPS | {"annotation-xml"}
SVG_TIPS = _w("foreignObject desc title")
CLOSES_P = _w("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
BREAKS_OUT = _w("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
SVG_NAMES = {
    n.lower(): n
    for n in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()
}
SVG_ATTRS = {
    n.lower(): n
    for n in "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()
}
QUIRKY_PUBLIC = tuple(
    "-//w3c//dtd html 3.2|-//w3c//dtd html 4.0 transitional//|-//w3c//dtd html 4.0 frameset//|-//ietf//dtd html|-//w3c//dtd html experimental|-//w3o//dtd w3 html|-//netscape comm. corp.//dtd|-//microsoft//dtd internet explorer|-//softquad".split("|")
)

#: Bits of the flags column.
FLAG_BITS = {
    name: 1 << i
    for i, name in enumerate(
        "Special LiteralText LineTolerance ImplicitlyClosed ImpliedEnd Scoped HtmlTableScoped HtmlTableSectionScoped HtmlListScoped HtmlSelectScoped HtmlFormatting SelfClosing HtmlMember SvgMember MathMember HtmlTip MathTip".split()
    )
}
#: The reference's table: the elements that carry each set of flags. Others carry none.
REFERENCE_FLAGS = {
    "Special": _w("address dl details dir div frameset head isindex menu noscript colgroup time title h1 h2 h3 h4 h5 h6 blockquote main summary center listing nav article aside figcaption figure section footer header hgroup form"),
    "Special SelfClosing": _w("area base basefont bgsound br embed hr img link menuitem meta param source col track wbr"),
    "HtmlFormatting": FORMATTING,
    "Special LiteralText": _w("noembed noframes script style xmp plaintext"),
    "Special ImplicitlyClosed ImpliedEnd": _w("p li dd dt"),
    "ImplicitlyClosed ImpliedEnd": _w("rb rp rtc rt"),
    "Special Scoped": _w("applet marquee caption"),
    "SelfClosing": _w("frame input keygen"),
    "Special ImplicitlyClosed HtmlTableSectionScoped": _w("tbody tfoot thead"),
    "Special ImplicitlyClosed": _w("body tr"),
    "ImplicitlyClosed ImpliedEnd HtmlSelectScoped": _w("option optgroup"),
    "Special HtmlListScoped": _w("ol ul"),
    "Special Scoped HtmlTableScoped HtmlTableSectionScoped": _w("table template"),
    "Special ImplicitlyClosed Scoped HtmlTableScoped HtmlTableSectionScoped": _w("html"),
    "LiteralText": _w("iframe"),
    "Scoped": _w("object"),
    "Special LineTolerance": _w("pre"),
    "LineTolerance": _w("textarea"),
}
# ------------------------------------------------------------------------------


def _bits(names: str) -> int:
    return sum(FLAG_BITS[n] for n in names.split())


_FLAGS_OF = {tag: _bits(flags) for flags, tags in REFERENCE_FLAGS.items() for tag in tags}
REFERENCE_SPECIAL = frozenset(t for t, b in _FLAGS_OF.items() if b & FLAG_BITS["Special"])


def flags_of(name: str, ns: str = "html") -> int:
    """The flags column of an element (the document counts as an HTML element)."""
    if ns == "svg":
        return FLAG_BITS["SvgMember"] | (_bits("HtmlTip Special Scoped") if name in SVG_TIPS else 0)
    if ns == "math":
        return FLAG_BITS["MathMember"] | (_bits("MathTip Special Scoped") if name in MATH_TIPS else _bits("Special Scoped") if name == "annotation-xml" else 0)
    return FLAG_BITS["HtmlMember"] | _FLAGS_OF.get(name, 0)

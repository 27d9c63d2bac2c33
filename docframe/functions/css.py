"""Style values: lengths, colours, shorthands, presentational attributes."""

from __future__ import annotations

import re

# Units in pixels, the sixteen basic colours, sides
UNITS = {"px": 1.0, "pt": 1.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pc": 12.0}
COLOURS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff",
    "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff",
}
SIDES = ("top", "right", "bottom", "left")
STYLES = frozenset("none hidden dotted dashed solid double groove ridge inset outset".split())


def length(text: str) -> tuple[float, str] | None:
    """(value, unit): absolute units in px, em, rem and % as they are; 0 needs no unit."""
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))(px|pt|in|cm|mm|pc|em|rem|%)?", text.strip().lower())
    if m is None or (m[2] is None and float(m[1]) != 0):
        return None
    return (float(m[1]) * UNITS[m[2] or "px"], "px") if (m[2] or "px") in UNITS else (float(m[1]), m[2])


def colour(text: str) -> str | None:
    """Six lower-case digits, from a name, #rgb, #rrggbb or rgb()."""
    t = text.strip().lower()
    if t in COLOURS:
        return COLOURS[t]
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", t):
        return m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
    if m := re.fullmatch(r"rgba?\(\s*([\d.]+%?)[\s,]+([\d.]+%?)[\s,]+([\d.]+%?)\s*(?:[,/]\s*[\d.]+%?\s*)?\)", t):
        values = [min(255, round(float(v[:-1]) * 2.55 if v.endswith("%") else float(v))) for v in m.groups()]
        return "".join(f"{v:02x}" for v in values)
    return None


def box(text: str) -> tuple[str, str, str, str] | None:
    """One to four values as top, right, bottom, left."""
    v = text.split()
    return tuple(v[i] for i in {1: (0, 0, 0, 0), 2: (0, 1, 0, 1), 3: (0, 1, 2, 1), 4: (0, 1, 2, 3)}[len(v)]) if 1 <= len(v) <= 4 else None


def expand(name: str, value: str) -> list[tuple[str, str]]:
    """A declaration as longhands; what is none stays itself, what cannot be read is left out."""
    if name in ("margin", "padding"):
        sides = box(value)
        return [(f"{name}-{s}", v) for s, v in zip(SIDES, sides)] if sides else []
    if name in ("border-width", "border-style", "border-color"):
        sides, part = box(value), name.partition("-")[2]
        return [(f"border-{s}-{part}", v) for s, v in zip(SIDES, sides)] if sides else []
    if name == "border" or name in [f"border-{s}" for s in SIDES]:
        found = {"width": "medium", "style": "none", "color": "currentcolor"}
        for v in value.split():
            kind = "style" if v.lower() in STYLES else "width" if length(v) or v in ("thin", "medium", "thick") else "color"
            found[kind] = v
        own = SIDES if name == "border" else [name.partition("-")[2]]
        return [(f"border-{s}-{k}", v) for s in own for k, v in found.items()]
    if name == "gap":
        v = value.split()
        return [("row-gap", v[0]), ("column-gap", v[-1])] if 1 <= len(v) <= 2 else []
    if name in ("place-items", "place-content", "place-self"):
        v, part = value.split(), name.partition("-")[2]
        return [(f"align-{part}", v[0]), (f"justify-{part}", v[-1])] if 1 <= len(v) <= 2 else []
    if name == "flex":
        words = {"none": ("0", "0", "auto"), "auto": ("1", "1", "auto"), "initial": ("0", "1", "auto")}
        if value in words:
            return list(zip(("flex-grow", "flex-shrink", "flex-basis"), words[value]))
        numbers = [v for v in value.split() if re.fullmatch(r"\d+\.?\d*|\.\d+", v)]
        basis = next((v for v in value.split() if v not in numbers), "0px" if numbers else None)
        return [("flex-grow", numbers[0] if numbers else "1"), ("flex-shrink", numbers[1] if len(numbers) > 1 else "1"), ("flex-basis", basis)] if basis else []
    if name == "list-style":
        v = value.split()
        kinds = [x for x in v if x not in ("inside", "outside") and not x.startswith("url(")]
        return [("list-style-type", kinds[0] if kinds else "disc"), ("list-style-position", next((x for x in v if x in ("inside", "outside")), "outside"))]
    if name == "font":
        m = re.fullmatch(r"((?:(?:italic|oblique|normal|small-caps|bold|bolder|lighter|[1-9]00)\s+)*)(\S+?)(?:\s*/\s*(\S+))?\s+(.+)", value)
        if m is None or length(m[2]) is None:
            return []
        words = m[1].split()
        style = next((w for w in words if w in ("italic", "oblique")), "normal")
        weight = next((w for w in words if w.startswith("b") or w == "lighter" or w[0].isdigit()), "normal")
        return [("font-style", style), ("font-weight", weight), ("font-size", m[2]), ("line-height", m[3] or "normal"), ("font-family", m[4])]
    return [(name, value)]


def hints(tag: str, attrs: dict[str, str]) -> list[tuple[str, str]]:
    """Declarations that old attributes stand for; they rank above the user agent's and below the author's."""
    out = []
    if (c := colour(attrs.get("bgcolor", ""))) and tag in ("body", "table", "tr", "td", "th"):
        out.append(("background-color", f"#{c}"))
    if (c := colour(attrs.get("color", ""))) and tag == "font":
        out.append(("color", f"#{c}"))
    align = attrs.get("align", "").lower()
    if tag in ("img", "table") and align in ("left", "right"):
        out.append(("float", align))
    elif align in ("left", "right", "center", "justify") and tag not in ("img", "table"):
        out.append(("text-align", align))
    if tag in ("td", "th", "tr") and (v := attrs.get("valign", "").lower()) in ("top", "middle", "bottom", "baseline"):
        out.append(("vertical-align", v))
    for side in ("width", "height"):
        if tag in ("img", "table", "td", "th") and (m := re.fullmatch(r"(\d+)(%?)", attrs.get(side, "").strip())):
            out.append((side, f"{m[1]}{m[2] or 'px'}"))
    kinds = {"1": "decimal", "a": "lower-alpha", "A": "upper-alpha", "i": "lower-roman", "I": "upper-roman"}
    if tag in ("ol", "ul", "li") and attrs.get("type"):
        out.append(("list-style-type", kinds.get(attrs["type"], attrs["type"].lower())))
    if tag == "center":
        out.append(("text-align", "center"))
    return out

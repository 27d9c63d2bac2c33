"""Style cascade as joins and windows; selectors are parsed on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docframe.functions.css import expand

# Origins, properties that children inherit, the weight that inline important declarations get
ORIGINS = {"ua": 0, "hint": 1, "author": 2}
INHERITED = ("color", "font-family", "font-size", "font-style", "font-weight", "line-height", "list-style-type", "text-align", "text-decoration", "text-indent", "text-transform", "visibility", "white-space", "direction", "letter-spacing", "word-spacing", "quotes")
INLINE_WEIGHT = 1 << 20
#: A test that no element passes.
NEVER = (4, 0, -1)


@dataclass(frozen=True)
class Simple:
    """A compound selector: an element name (empty: any), ids, classes, and tests of place (pseudo-classes)."""

    tag: str = ""
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    pseudos: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selector:
    """Compounds joined by descendant combinators, the subject last."""

    parts: tuple[Simple, ...] = field(default_factory=tuple)

    @property
    def specificity(self) -> tuple[int, int, int]:
        return (
            sum(len(p.ids) for p in self.parts),
            sum(len(p.classes) + len(p.pseudos) for p in self.parts),
            sum(p.tag not in ("", "*") for p in self.parts),
        )


PIECE = re.compile(r"([#.]?)((?:[\w-]|[^\x00-\x7f]|\\.)+|\*)|:(:?[\w-]+(?:\([^)]*\))?)")
NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


def parse_selectors(text: str) -> list[Selector]:
    """A comma list; groups that hold what is not understood (:not, :is, pseudo-elements) are left out."""
    out = []
    for group in text.split(","):
        parts = []
        for word in group.split():
            tag, ids, classes, pseudos, at = "", [], [], [], 0
            while at < len(word):
                m = PIECE.match(word, at)
                if m is None:  # other signs stand as a name that no element has
                    tag, at = word, len(word)
                    break
                at = m.end()
                if m[3]:
                    pseudos.append(m[3].lower())
                elif m[1] == "#":
                    ids.append(m[2])
                elif m[1] == ".":
                    classes.append(m[2])
                else:
                    tag = m[2].lower()
            parts.append(Simple("" if tag == "*" else tag, tuple(ids), tuple(classes), tuple(pseudos)))
        unknown = any(p.startswith((":", "not(", "is(", "before", "after")) for s in parts for p in s.pseudos)
        if parts and not unknown:
            out.append(Selector(tuple(parts)))
    return out


def nth(text: str) -> tuple[int, int] | None:
    """a and b of an+b."""
    m = NTH.match(text)
    if m is None:
        return None
    if m[1]:
        return 2, int(m[1].lower() == "odd")
    if m[5]:
        return 0, int(m[5])
    a = {"": 1, "+": 1, "-": -1}.get(m[2])
    return (int(m[2]) if a is None else a), (int(m[4]) * (-1 if m[3] == "-" else 1) if m[4] else 0)


def with_places(nodes: DataFrame) -> DataFrame:
    """Elements with `places`: from the front and the end among their sibling elements, and among those of their own tag; then whether they are a root, a link with a target."""
    own = nodes.where("tag <> '#text'")
    w, t = Window.partitionBy("doc_id", "parent_id"), Window.partitionBy("doc_id", "parent_id", "tag")
    first, first_of_type = F.row_number().over(w.orderBy("pre")), F.row_number().over(t.orderBy("pre"))
    link = F.col("tag").isin("a", "area", "link") & (F.coalesce(F.element_at("attrs", F.lit("href")), F.lit("")) != "")
    ranked = own.withColumn("_a", first).withColumn("_b", F.count("*").over(w) - F.col("_a") + 1).withColumn("_c", first_of_type).withColumn("_d", F.count("*").over(t) - F.col("_c") + 1)
    places = F.array(*[F.col(c).cast("long") for c in ("_a", "_b", "_c", "_d")], F.col("parent_id").isNull().cast("long"), link.cast("long"))
    return ranked.withColumn("places", places).drop("_a", "_b", "_c", "_d")


def place_tests(pseudo: str) -> list[tuple[int, int, int]]:
    """(place, a, b): that place must be a*n + b for some n of 0 or more. Dynamic and unknown pseudo-classes never hold."""
    name, _, inside = pseudo.rstrip(")").partition("(")
    ends = {"child": (0, 1), "of-type": (2, 3)}
    for kind, (front, back) in ends.items():
        if name in (f"nth-{kind}", f"nth-last-{kind}"):
            ab = nth(inside)
            return [(back if "last" in name else front, *ab)] if ab else [NEVER]
        if name in (f"first-{kind}", f"last-{kind}"):
            return [(front if name.startswith("first") else back, 0, 1)]
        if name == f"only-{kind}":
            return [(front, 0, 1), (back, 0, 1)]
    return {"root": [(4, 0, 1)], "link": [(5, 0, 1)], "any-link": [(5, 0, 1)]}.get(name, [NEVER])


COMPOUNDS = "sheet int, sel int, part int, last boolean, key string, tag string, ids array<string>, classes array<string>, tests array<struct<place: int, a: long, b: long>>"
DECLARATIONS = "sheet int, sel int, origin int, ids int, classes int, types int, seq long, prop string, value string, important boolean"


def rules_of(sheet: str, origin: str = "author", order: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Rows of COMPOUNDS and DECLARATIONS of a style sheet; media rules for print are left out. A compound's key is the rarest thing it asks for: an id, a class, a tag, or nothing."""
    sheet = re.sub(r"(?s)/\*.*?\*/", "", sheet)
    sheet = re.sub(r"(?is)@media\s+print\s*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", sheet)
    sheet = re.sub(r"(?is)@media\s+(?:all|screen)\s*\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\}", r"\1", sheet)
    compounds: list[tuple] = []
    declared: list[tuple] = []
    number = 0
    for m in re.finditer(r"(?s)([^{}@;]+)\{([^{}]*)\}", sheet):
        own = declarations(m[2])
        for s in parse_selectors(m[1]):
            for part, c in enumerate(s.parts):
                key = f"#{c.ids[0]}" if c.ids else f".{c.classes[0]}" if c.classes else c.tag or "*"
                tests = [t for p in c.pseudos for t in place_tests(p)]
                compounds.append((order, number, part, part == len(s.parts) - 1, key, c.tag, list(c.ids), list(c.classes), tests))
            declared += [(order, number, ORIGINS[origin], *s.specificity, (order << 40) + (number << 20) + k, prop, value, important) for k, (prop, value, important) in enumerate(own)]
            number += 1
    return compounds, declared


def matched_compounds(nodes: DataFrame, compounds: DataFrame) -> DataFrame:
    """(doc_id, node_id, pre, post, sheet, sel, part, last): elements that fit compounds, found by their ids, classes and tags in one join, whatever the number of selectors.

    compounds may have a doc_id: they then hold for that document's elements only. Without one they
    are the driver's own sheets, and are broadcast.
    """
    names = F.filter(F.split(F.coalesce(F.element_at("attrs", F.lit("class")), F.lit("")), r"[ \t\n\r\f]+"), lambda c: c != "")
    own = with_places(nodes).withColumn("_id", F.coalesce(F.element_at("attrs", F.lit("id")), F.lit(""))).withColumn("_classes", names)
    keys = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag"), F.concat(F.lit("#"), F.col("_id"))), F.transform("_classes", lambda c: F.concat(F.lit("."), c))))
    keyed = own.select("doc_id", "node_id", "pre", "post", F.col("tag").alias("_tag"), "_id", "_classes", "places", F.explode(keys).alias("key"))
    met = keyed.join(compounds, ["doc_id", "key"]) if "doc_id" in compounds.columns else keyed.join(F.broadcast(compounds), "key")

    def holds(t):
        place = F.get("places", t["place"])
        ahead = place - t["b"]
        return F.when(t["a"] == 0, ahead == 0).otherwise((F.pmod(ahead, F.abs(t["a"])) == 0) & (ahead * F.signum(t["a"].cast("double")) >= 0))

    fits = F.col("tag").isin("") | (F.col("tag") == F.col("_tag"))
    fits = fits & F.forall("ids", lambda i: i == F.col("_id")) & (F.size(F.array_except("classes", "_classes")) == 0) & F.forall("tests", lambda t: F.coalesce(holds(t), F.lit(False)))
    return met.where(fits).select("doc_id", "node_id", "pre", "post", "sheet", "sel", "part", "last")


def matches(nodes: DataFrame, compounds: DataFrame, parts: int) -> DataFrame:
    """(doc_id, node_id, sheet, sel) of the elements that selectors of `parts` compounds at most match; an ancestor is found by its interval of pre and post numbers."""
    fits = matched_compounds(nodes, compounds)
    found = fits.where("part = 0")
    out = found.where("last")
    for part in range(1, parts):
        a, b = fits.where(F.col("part") == part).alias("a"), found.alias("b")
        inside = (F.col("b.pre") < F.col("a.pre")) & (F.col("b.post") > F.col("a.post"))
        for c in ("doc_id", "sheet", "sel"):
            inside = inside & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        found = a.join(b, inside, "left_semi")
        out = out.unionByName(found.where("last"))
    return out.select("doc_id", "node_id", "sheet", "sel")


def selected(nodes: DataFrame, selector: str) -> DataFrame:
    """(doc_id, node_id) of the elements that a selector list matches."""
    compounds, _ = rules_of(selector + "{x: y}")
    table = nodes.sparkSession.createDataFrame(compounds, COMPOUNDS)
    return matches(nodes, table, max((c[2] for c in compounds), default=0) + 1).select("doc_id", "node_id").distinct()


def declarations(text: str) -> list[tuple[str, str, bool]]:
    out = []
    for d in text.split(";"):
        name, colon, value = d.partition(":")
        if colon and name.strip() and value.strip():
            plain = re.sub(r"(?i)\s*!\s*important\s*$", "", value.strip())
            out += [(k, v, plain != value.strip()) for k, v in expand(name.strip().lower(), plain)]
    return out


def cascade(matched: DataFrame) -> DataFrame:
    """The winning declaration of each node and property.

    matched: doc_id, node_id, prop, value, origin (0 user agent, 1 hint, 2 author), ids, classes,
    types, seq, important, inline. Normal: origin, then inline, then specificity, then order.
    Important ones beat all normal ones; there the author's yield to the user agent's.
    """
    w = Window.partitionBy("doc_id", "node_id", "prop").orderBy(
        F.desc("important"),
        F.desc(F.when(F.col("important"), F.when(F.col("origin") == 0, 4).otherwise(3)).otherwise(F.when(F.col("inline"), 3).otherwise(F.col("origin")))),
        F.desc(F.when(F.col("inline"), F.col("ids") + INLINE_WEIGHT).otherwise(F.col("ids"))),
        F.desc("classes"),
        F.desc("types"),
        F.desc("seq"),
    )
    return matched.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def inherit(nodes: DataFrame, winners: DataFrame) -> DataFrame:
    """(doc_id, node_id, prop, value): own values, and inherited properties from the nearest ancestor that has one."""
    own = winners.select("doc_id", "node_id", "prop", "value")
    held = winners.where(F.col("prop").isin(*INHERITED)).join(nodes.select("doc_id", "node_id", "pre", "post", "depth"), ["doc_id", "node_id"])
    a, n = held.alias("a"), nodes.alias("n")
    below = (F.col("a.doc_id") == F.col("n.doc_id")) & (F.col("a.pre") < F.col("n.pre")) & (F.col("a.post") > F.col("n.post"))
    passed = n.join(a, below).groupBy("n.doc_id", "n.node_id", "a.prop").agg(F.max_by("a.value", "a.depth").alias("value"))
    return own.unionByName(passed.join(own, ["doc_id", "node_id", "prop"], "left_anti").select("doc_id", "node_id", "prop", "value"))


def apply_sheets(spark: SparkSession, nodes: DataFrame, sheets: list[tuple[str, str]]) -> DataFrame:
    """Winning declarations of nodes under style sheets (origin, text) and their own style attributes. The plan grows with the compounds of the longest selector only."""
    read = [rules_of(text, origin, i) for i, (origin, text) in enumerate(sheets)]
    compounds, declared = [c for own, _ in read for c in own], [d for _, own in read for d in own]
    inline = inline_styles(nodes)
    if not compounds:
        return cascade(inline)
    found = matches(nodes, spark.createDataFrame(compounds, COMPOUNDS), max(c[2] for c in compounds) + 1)
    rows = found.join(F.broadcast(spark.createDataFrame(declared, DECLARATIONS)), ["sheet", "sel"])
    return cascade(as_matched(rows).unionByName(inline))


def as_matched(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "node_id", "prop", "value", "origin", "ids", "classes", "types", "seq", "important", F.lit(False).alias("inline"))


def document_sheets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COMPOUNDS and DECLARATIONS, each with doc_id, of the style elements of every document, in their order."""
    style, text = nodes.where("tag = 'style'").alias("s"), nodes.where("tag = '#text'").alias("t")
    own = style.join(text, (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("s.node_id") == F.col("t.parent_id"))).select("s.doc_id", F.col("s.pre").cast("int").alias("sheet"), "t.text")

    def rows(which: int, schema: str) -> DataFrame:
        kind = to_arrow_schema(_parse_datatype_string(f"doc_id long, {schema}"))
        names = kind.names[1:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [{"doc_id": doc} | dict(zip(names, r)) for doc, sheet, text in zip(*(c.to_pylist() for c in batch.columns)) for r in rules_of(text or "", "author", sheet)[which]]
                for r in out:
                    if "tests" in r:
                        r["tests"] = [dict(zip(("place", "a", "b"), t)) for t in r["tests"]]
                yield from pa.Table.from_pylist(out, kind).to_batches()

        return own.mapInArrow(run, f"doc_id long, {schema}")

    return rows(0, COMPOUNDS), rows(1, DECLARATIONS)


def apply_own_sheets(nodes: DataFrame) -> DataFrame:
    """As apply_sheets(), under each document's own style elements."""
    compounds, declared = document_sheets(nodes)
    parts = compounds.agg(F.max("part")).first()[0]
    inline = inline_styles(nodes)
    if parts is None:
        return cascade(inline)
    found = matches(nodes, compounds, parts + 1)
    return cascade(as_matched(found.join(declared, ["doc_id", "sheet", "sel"])).unionByName(inline))


def inline_styles(nodes: DataFrame) -> DataFrame:
    each = nodes.select("doc_id", "node_id", F.posexplode(F.split(F.coalesce(F.element_at("attrs", F.lit("style")), F.lit("")), ";")).alias("seq", "d"))
    name, value = F.lower(F.trim(F.substring_index("d", ":", 1))), F.trim(F.expr("substring(d, instr(d, ':') + 1)"))
    important = value.rlike(r"(?i)!\s*important\s*$")
    plain = F.trim(F.regexp_replace(value, r"(?i)\s*!\s*important\s*$", ""))
    rows = each.where(F.expr("instr(d, ':') > 1")).select("doc_id", "node_id", name.alias("prop"), plain.alias("value"), F.lit(2).alias("origin"), F.lit(0).alias("ids"), F.lit(0).alias("classes"), F.lit(0).alias("types"), F.col("seq").cast("long").alias("seq"), important.alias("important"), F.lit(True).alias("inline"))
    return rows.where("prop <> '' and value <> ''")

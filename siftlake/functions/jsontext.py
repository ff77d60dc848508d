"""JSON arrays in noisy text: strict validity, recovery and decoding, all as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.text import column, spaced, trim_all

# Closes the wrapping array in `_wrapped`; must not occur in real data.
SENTINEL = "@@siftlake-end@@"
OBJECT_ARRAY = "array<variant>"
PAYLOAD = "map<string,variant>"
FENCE = "```"
# Spark holds no longer value in one variant.
VARIANT_LIMIT_BYTES = 128 * 1024 * 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_long(value: Column | str) -> Column:
    """Like `trim_all`, for long texts: looks at the ends first, which are rarely other than spaces."""

    def edges(t: Column) -> Column:
        return F.when(spaced(t), trim_all(t)).otherwise(t)

    return let(F.trim(column(value)), edges)


def _wrapped(text: Column) -> Column:
    """[text, sentinel] as a variant.

    The lenient parser ignores what follows a complete value, so the text is
    exactly one JSON value only when the sentinel is found right behind it.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{SENTINEL}"]')))


def over_limit(text: Column) -> Column:
    """Whether a text with its wrapping may be too long for one variant."""
    return F.octet_length(text) > VARIANT_LIMIT_BYTES - 64


def _streamed(text: Column, fields: str) -> Column:
    """`fields` of {"a": text, "z": sentinel}, read in one pass by the streaming parser.

    A field that isn't asked for is checked and skipped, and every element of an array is a value of its own, so
    texts beyond the variant limit can be read. `z` is there only when the text is exactly one JSON value.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.from_json(F.concat(F.lit('{"a":'), text, F.lit(f',"z":"{SENTINEL}"}}')), fields, strict)


def _closed(doc: Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$[1]", "string") == SENTINEL, F.lit(False))


# How a JSON value starts: these texts only are parsed.
_STARTS = {
    "[": r'^\[[ \t\n\r]*+(?:\z|["\[{\]0-9-]|t(?:r|\z)|f(?:a|\z)|n(?:u|\z))',
    "{": r'^\{[ \t\n\r]*+(?:\z|["}])',
    "": r'^(?:"|-?[0-9]|true$|false$|null$)',
}
_HEAD = 40


def _could_be_json(text: Column) -> Column:
    """Cheap test of the ends: a failed parse costs far more than a successful one."""

    def judged(head: Column) -> Column:
        starts = {opener: head.rlike(pattern) for opener, pattern in _STARTS.items()}
        return (
            F.when(head.startswith("["), text.endswith("]") & starts["["])
            .when(head.startswith("{"), text.endswith("}") & starts["{"])
            .otherwise(starts[""])
        )

    return let(F.left(text, F.lit(_HEAD)), judged)


def valid_json(value: Column | str) -> Column:
    """True when the whole text is exactly one JSON value."""


    def judged(text: Column) -> Column:
        whole = F.coalesce(_streamed(text, "z string")["z"] == SENTINEL, F.lit(False))
        return F.when(over_limit(text), whole).otherwise(_closed(_wrapped(text)))

    return let(F.when(_could_be_json(column(value)), column(value)), judged)


def is_object(value: Column) -> Column:
    # The cast looks at no field; a schema would describe all of them.
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def _top_array(text: Column) -> Column:
    """Elements of a text that is exactly one JSON array, else null."""
    short = let(_wrapped(text), lambda d: F.when(_closed(d), F.try_variant_get(d, "$[0]", OBJECT_ARRAY)))
    long = let(_streamed(text, f"a {OBJECT_ARRAY}, z string"), lambda d: F.when(d["z"] == SENTINEL, d["a"]))
    return F.when(over_limit(text), long).otherwise(short)


def has_long_element(text: Column) -> Column:
    """Whether a text over the limit is an array with one element that is."""
    listed = F.when(over_limit(text) & text.startswith("["), _streamed(text, "a array<string>")["a"])
    return F.coalesce(F.exists(listed, over_limit), F.lit(False))


def _objects_only(items: Column) -> Column:
    return let(items, lambda xs: F.when(F.forall(xs, lambda x: F.is_variant_null(x) | is_object(x)), xs))


class Reader(NamedTuple):
    """How the elements of an array of objects (or nulls) are read: the type of the array, what is taken from
    [array, ...] or from elements, the type of that, and how it becomes the array. The last step stands once in a plan."""

    type: str
    of_doc: Callable[[Column], Column]
    of_items: Callable[[Column], Column]
    taken: str
    finish: Callable[[Column], Column]


def _variants(doc: Column) -> Column:
    return _objects_only(F.try_variant_get(doc, "$[0]", OBJECT_ARRAY))


VARIANTS = Reader(OBJECT_ARRAY, _variants, _objects_only, OBJECT_ARRAY, lambda items: items)


def texts(paths: list[str], objects: bool = True, skipped: list[str] | None = None) -> Reader:
    """Elements as (t, hollow): the printed forms of some fields in `t`, nested as the paths say, null or '' when absent.

    All fields come from one walk over the element, where each variant taken out of another one is built anew. `hollow`
    names the fields that hold an empty list or object. Elements that may hold such or a double are read field by field.
    Without `objects`, elements of any kind are taken; those that are no objects have no fields. With `skipped`, `fields` has
    all other fields that print as more than '', as (key, said, value): the printed form, and the variant where that may be
    of a list, an object or a double.
    """
    variants = _variants if objects else ANY.of_doc
    checked = _objects_only if objects else ANY.of_items
    tree: dict[str, list[str]] = {}
    for path in dict.fromkeys(paths):
        top, _, leaf = path.partition(".")
        tree.setdefault(top, []).extend([leaf] if leaf else [])
    kinds = {top: f"struct<{', '.join(f'{x}: string' for x in leaves)}>" if leaves else "string" for top, leaves in tree.items()}
    shape = f"struct<{', '.join(f'{top}: {kind}' for top, kind in kinds.items())}>"
    whole = f"array<struct<t: {shape}, hollow: array<string>>>"
    if skipped is not None:
        return _with_fields(texts(paths, objects), shape, skipped)

    def plain(ts: Column) -> Column:
        """Whether all elements are objects and no text is one that several values print as.

        The array is printed whole, which costs one expression; its own brackets may only send a document to the exact reading.
        """
        said = F.when(F.forall(ts, lambda t: t.isNotNull()), ts.cast("string"))
        odd = let(said, lambda s: F.contains(s, F.lit(".0")) | F.contains(s, F.lit("[]")) | F.contains(s, F.lit("{}")))
        return F.coalesce((F.size(ts) == 0) | ~odd, F.lit(False))

    def exact(item: Column) -> Column:
        fields = [
            F.struct(*[text_at(item, f"{top}.{x}").alias(x) for x in leaves]).alias(top) if leaves else text_at(item, top).alias(top)
            for top, leaves in tree.items()
        ]

        def with_hollow(t: Column) -> Column:
            names = [
                F.when(t[top].isin("[]", "{}") & ~meaningful(F.try_variant_get(item, f"$.{top}", "variant")), F.lit(top))
                for top in tree
                if not tree[top]
            ]
            return F.struct(t.alias("t"), F.array_compact(F.array(*names)).alias("hollow"))

        return let(F.struct(*fields), with_hollow)

    def taken(ts: Column, items: Column) -> Column:
        return F.when(ts.isNotNull() | items.isNotNull(), F.struct(ts.alias("ts"), items.alias("items")))

    def of_items(items: Column) -> Column:
        return let(checked(items), lambda xs: taken(F.lit(None).cast(f"array<{shape}>"), xs))

    def of_doc(doc: Column) -> Column:
        def judged(ts: Column) -> Column:
            def read(whole: Column) -> Column:
                return taken(F.when(whole, ts), F.when(~whole, variants(doc)))

            return F.when(ts.isNotNull(), let(plain(ts), read))

        return let(F.try_variant_get(doc, "$[0]", f"array<{shape}>"), judged)

    def finish(value: Column) -> Column:
        none = F.lit(None).cast("array<string>")

        def joined(v: Column) -> Column:
            simple = F.transform(v["ts"], lambda t: F.struct(t.alias("t"), none.alias("hollow")))
            return F.when(v["ts"].isNotNull(), simple).otherwise(F.transform(v["items"], exact).cast(whole))

        return let(value, joined)

    return Reader(whole, of_doc, of_items, f"struct<ts: array<{shape}>, items: {OBJECT_ARRAY}>", finish)


def _with_fields(read: Reader, shape: str, skipped: list[str]) -> Reader:
    """Elements of a reader of `texts`, each with its other fields."""
    whole = f"array<struct<t: {shape}, hollow: array<string>, fields: array<struct<key: string, said: string, value: variant>>>>"

    def unclear(said: Column) -> Column:
        return said.startswith("[") | said.startswith("{") | said.endswith(".0")

    def fields(item: Column) -> Column:
        def named(said: Column) -> Column:
            unsure = F.exists(said, lambda e: unclear(e["value"]))

            def with_values(values: Column) -> Column:
                def field(e: Column) -> Column:
                    value = F.when(unclear(e["value"]), F.try_element_at(values, e["key"]))
                    return F.struct(e["key"].alias("key"), e["value"].alias("said"), value.alias("value"))

                return F.transform(said, field)

            return let(F.when(unsure, F.try_variant_get(item, "$", PAYLOAD)), with_values)

        all_fields = F.map_entries(F.try_variant_get(item, "$", "map<string,string>"))
        return let(F.filter(all_fields, lambda e: (e["value"] != "") & ~e["key"].isin(skipped)), named)

    def both(shown: Column, items: Column) -> Column:
        return let(items, lambda xs: F.when(xs.isNotNull(), F.struct(shown.alias("shown"), xs.alias("items"))))

    def of_doc(doc: Column) -> Column:
        return both(read.of_doc(doc), _variants(doc))

    def of_items(items: Column) -> Column:
        return both(read.of_items(items), _objects_only(items))

    def finish(value: Column) -> Column:
        def each(x: Column, item: Column) -> Column:
            return F.struct(x["t"].alias("t"), x["hollow"].alias("hollow"), fields(item).alias("fields"))

        return let(value, lambda v: F.zip_with(read.finish(v["shown"]), v["items"], each).cast(whole))

    return Reader(whole, of_doc, of_items, f"struct<shown: {read.taken}, items: {OBJECT_ARRAY}>", finish)


def shown_at(item: Column, path: str) -> Column:
    """`text_at` of an element read by `texts`."""
    value = item["t"]
    for name in path.split("."):
        value = value[name]
    return F.coalesce(value, F.lit(""))


def decode_array(value: Column | str, read: Reader = VARIANTS) -> Column:
    """array<variant> when the text is a JSON array of objects (or nulls), else null."""

    # Only text that looks like an array from its ends is parsed.
    def parsed(text: Column) -> Column:
        return _listed(F.when(_could_be_json(text) & text.startswith("["), text), read)

    return let(trim_long(value), parsed)


def _listed(text: Column, read: Reader) -> Column:
    short = let(_wrapped(text), lambda d: F.when(_closed(d), read.of_doc(d)))
    return F.when(over_limit(text), read.of_items(_top_array(text))).otherwise(short)


def _decoded(candidate: Column, read: Reader) -> Column:
    """A struct of `items`, as `decode_array` gives them, where the text is exactly one JSON value; else null.

    Validity and elements come from one parse.
    """

    def judged(text: Column) -> Column:
        def closed(d: Column) -> Column:
            return F.when(_closed(d), F.struct(read.of_doc(d).alias("items")))

        listed = F.when(text.startswith("["), text)
        long = F.when(valid_json(text), F.struct(read.of_items(_top_array(listed)).alias("items")))
        return F.when(over_limit(text), long).otherwise(let(_wrapped(text), closed))

    return let(candidate, lambda c: F.when(_could_be_json(c), judged(c)))


def last_index(text: Column, needle: str) -> Column:
    """1-based position of the last occurrence, 0 when absent."""
    after = F.length(F.substring_index(text, needle, -1))
    return F.when(F.contains(text, F.lit(needle)), F.length(text) - after - len(needle) + 1).otherwise(0)


def slice_between(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to the last closer, null unless in that order."""
    ends = F.struct(F.locate(opener, text).alias("start"), last_index(text, closer).alias("end"))
    return let(
        ends,
        lambda e: F.when(
            (e["start"] > 0) & (e["end"] > e["start"]), F.substring(text, e["start"], e["end"] - e["start"] + 1)
        ),
    )


def fenced_block(text: Column) -> Column:
    """What stands between the first and the last code fence, without the json tag."""
    ends = F.struct(F.locate(FENCE, text).alias("start"), last_index(text, FENCE).alias("end"))

    def between(e: Column) -> Column:
        return F.when(
            (e["start"] > 0) & (e["end"] > e["start"]),
            trim_long(F.substring(text, e["start"] + 3, e["end"] - e["start"] - 3)),
        )

    def untagged(inner: Column) -> Column:
        return F.when(inner.startswith("json"), trim_long(F.substring(inner, F.lit(5), F.length(inner)))).otherwise(inner)

    return let(F.when(F.contains(text, F.lit(FENCE)), let(ends, between)), untagged)


def _if_valid(candidate: Column) -> Column:
    return let(candidate, lambda c: F.when(valid_json(c), c))


def extract_json_block(value: Column | str) -> Column:
    """First valid of: the text, its fenced block, its `[...]`, its `{...}`; else the text."""
    return let(
        trim_long(value),
        lambda text: F.coalesce(
            _if_valid(text),
            _if_valid(fenced_block(text)),
            _if_valid(slice_between(text, "[", "]")),
            _if_valid(slice_between(text, "{", "}")),
            text,
        ),
    )


def block_items(value: Column | str, read: Reader = VARIANTS) -> Column:
    """`decode_array` of `extract_json_block`, parsing each candidate once; an object never gives items."""
    return let(
        trim_long(value),
        lambda text: F.coalesce(
            _decoded(text, read), _decoded(fenced_block(text), read), _decoded(slice_between(text, "[", "]"), read)
        ),
    )["items"]


def _first_valid(candidates: Column) -> Column:
    """First candidate that is valid JSON; later ones are not parsed any more."""
    none = F.lit(None).cast("string")
    return F.aggregate(candidates, none, lambda found, c: F.coalesce(found, F.when(valid_json(c), c)))


# In reversed text: a quote that no backslash escapes.
_QUOTE_BACKWARDS = r'"(?!(?:\\\\)*+\\(?!\\))'


def _matched_slice(text: Column, opener: str, closer: str) -> Column:
    """From the opener that the last closer closes up to that closer, null where there is none.

    Only this slice can be valid JSON up to the last closer: brackets of a valid value match outside its
    strings, and walking back from its end tells strings from what is between them. One pass over the quotes and brackets
    with a counter finds it, whatever the number of openers.
    """
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        # A part starts with its bracket, if it has one.
        depth = (
            F.when(part.startswith(closer), acc["depth"] + 1)
            .when(part.startswith(opener), acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        here = part.startswith(opener) & (acc["depth"] == 1) & (acc["found"] == 0)
        found = F.when(here, acc["at"] + 1).otherwise(acc["found"])
        return F.struct(depth.alias("depth"), (acc["at"] + F.length(part)).alias("at"), found.alias("found"))

    def walk(upto: Column) -> Column:
        pieces = F.split(F.reverse(upto), _QUOTE_BACKWARDS)
        start = F.struct(none.alias("walk"), F.lit(False).alias("inside"))

        def over(acc: Column, piece: Column) -> Column:
            skipped = F.struct(
                acc["walk"]["depth"].alias("depth"),
                (acc["walk"]["at"] + F.length(piece)).alias("at"),
                acc["walk"]["found"].alias("found"),
            )
            bare = ~(F.contains(piece, F.lit(opener)) | F.contains(piece, F.lit(closer)))
            parts = F.split(piece, f"(?=[\\{opener}\\{closer}])")
            walked = F.when(acc["inside"] | bare | (acc["walk"]["found"] > 0), skipped).otherwise(
                F.aggregate(parts, acc["walk"], step)
            )

            def behind_quote(w: Column) -> Column:
                at = (w["at"] + 1).alias("at")
                return F.struct(F.struct(w["depth"].alias("depth"), at, w["found"].alias("found")).alias("walk"), (~acc["inside"]).alias("inside"))

            return let(walked, behind_quote)

        found = F.aggregate(pieces, start, over, lambda acc: acc["walk"]["found"])
        return let(found, lambda n: F.when(n > 0, F.substring(upto, F.length(upto) - n + 1, n)))

    return let(F.substring(text, F.lit(1), last_index(text, closer)), walk)


# Fixed value: the form of a fenced block, up to the first closer before a fence. Runs without a closer are taken whole.
_BLOCK = (
    r"```(?:json)?\s*(\[[^\]]*+(?:\](?!\s*```)[^\]]*+)*+\]"
    r"|\{[^}]*+(?:\}(?!\s*```)[^}]*+)*+\})\s*```"
)


def _blocks(text: Column) -> Column:
    """Fenced blocks, last to first."""
    return F.when(F.contains(text, F.lit(FENCE)), F.reverse(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))))


def extract_json_best(value: Column | str) -> Column:
    """Like `extract_json_block`, but tries fenced blocks last to first and every opener."""

    def best(text: Column) -> Column:
        # The slice from the first opener is the matched one if it is valid, and found without a walk.
        return F.coalesce(
            _if_valid(text),
            _first_valid(_blocks(text)),
            _if_valid(slice_between(text, "[", "]")),
            _if_valid(_matched_slice(text, "[", "]")),
            _if_valid(slice_between(text, "{", "}")),
            _if_valid(_matched_slice(text, "{", "}")),
            text,
        )

    return let(trim_long(value), best)


def best_items(value: Column | str, read: Reader = VARIANTS) -> Column:
    """A struct of `items`, as `decode_array` gives them of `extract_json_best`; null where that is no JSON.

    Each candidate is parsed once.
    """
    none = F.lit(None).cast(f"struct<items: {read.taken}>")

    def best(text: Column) -> Column:
        return F.coalesce(
            _decoded(text, read),
            F.aggregate(_blocks(text), none, lambda found, c: F.coalesce(found, _decoded(c, read))),
            _decoded(slice_between(text, "[", "]"), read),
            _decoded(_matched_slice(text, "[", "]"), read),
            _decoded(slice_between(text, "{", "}"), read),
            _decoded(_matched_slice(text, "{", "}"), read),
        )

    return let(trim_long(value), best)


def parse_result_array(value: Column | str) -> Column:
    """The user interface's reading: strip one leading fence, slice the outer array, parse."""
    return let(let(trim_long(value), result_array_text), lambda t: _top_array(t))


def result_array_text(trimmed: Column) -> Column:
    """What `parse_result_array` parses of a trimmed text, null where it can't be an array."""

    def unfenced(text: Column) -> Column:
        opened = F.regexp_replace(text, r"^```(?:json)?\s*", "")
        return F.when(text.startswith(FENCE), F.regexp_replace(opened, r"\s*```$", "")).otherwise(text)

    def sliced(body: Column) -> Column:
        # A text with these ends is its own slice.
        return F.when(_bracketed(body), body).otherwise(F.coalesce(slice_between(body, "[", "]"), body))

    def listed(body: Column) -> Column:
        return F.when(_bracketed(body) & F.left(body, F.lit(_HEAD)).rlike(_STARTS["["]), body)

    elsewhere = let(let(unfenced(trimmed), sliced), listed)
    return F.when(_bracketed(trimmed), listed(trimmed)).otherwise(elsewhere)


def _bracketed(text: Column) -> Column:
    return text.startswith("[") & text.endswith("]")


def result_items(text: Column, read: Reader) -> Column:
    """The elements of a text of `result_array_text` as `read.finish` takes them, null unless it is an array."""
    return _listed(text, read)


def _sizes(doc: Column) -> Column:
    # Elements that are no objects become null, so nothing is copied and the size stays.
    return F.try_variant_get(doc, "$[0]", "array<struct<>>")


# For sizes alone: elements of any kind, without content.
SIZES = Reader(
    "array<struct<>>",
    _sizes,
    lambda items: F.transform(items, lambda x: F.try_variant_get(x, "$", "struct<>")),
    "array<struct<>>",
    lambda items: items,
)



def _fields_of_doc(doc: Column) -> Column:
    def judged(ts: Column) -> Column:
        # A null is a null element or one that is no object.
        exact = F.transform(_variants(doc), lambda x: F.coalesce(F.try_variant_get(x, "$", FIELD_MAP), F.create_map().cast(FIELD_MAP)))
        return F.when(F.forall(ts, lambda t: t.isNotNull()), ts).otherwise(exact)

    return let(F.try_variant_get(doc, "$[0]", f"array<{FIELD_MAP}>"), judged)


# All fields of elements in their printed forms, null for a JSON null; doubles keep their `.0`. A null element has no fields.
FIELD_MAP = "map<string,string>"
FIELDS = Reader(
    f"array<{FIELD_MAP}>",
    _fields_of_doc,
    lambda items: F.transform(
        _objects_only(items), lambda x: F.coalesce(F.try_variant_get(x, "$", FIELD_MAP), F.create_map().cast(FIELD_MAP))
    ),
    f"array<{FIELD_MAP}>",
    lambda items: items,
)
# Elements of any kind, where `VARIANTS` takes objects and nulls.
ANY = Reader(
    OBJECT_ARRAY, lambda doc: F.try_variant_get(doc, "$[0]", OBJECT_ARRAY), lambda items: items, OBJECT_ARRAY, lambda items: items
)


def payload(item: Column | str) -> Column:
    """One array element as map<string,variant>; a null element is an empty map."""
    return F.coalesce(
        F.try_variant_get(column(item), "$", PAYLOAD), F.create_map().cast(PAYLOAD)
    )


def to_text(value: Column | str) -> Column:
    """Printed form of a variant: null '', string as is, 88 / 88.0 / "88" all `88`."""
    v = column(value)
    text = F.try_variant_get(v, "$", "string")
    whole = F.when(
        text.endswith(".0") & (F.schema_of_variant(v) == "DOUBLE"), F.regexp_replace(text, r"\.0$", "")
    )
    return F.coalesce(whole, text, F.lit(""))


def text_at(item: Column | str, path: str) -> Column:
    """Printed form of a field of a variant object, '' when absent."""
    v = column(item)
    text = F.try_variant_get(v, f"$.{path}", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    whole = F.when(text.endswith(".0") & (kind == "DOUBLE"), F.regexp_replace(text, r"\.0$", ""))
    return F.coalesce(whole, text, F.lit(""))


def string_variant(value: Column) -> Column:
    return value.cast("variant")


def meaningful(value: Column | str) -> Column:
    """Non-null, non-blank string, non-empty list or object; any number or boolean."""
    v = column(value)

    def judged(printed: Column) -> Column:
        # Of all values only a text can print as `[]` or `{}` and hold something.
        empty = F.when(printed.isin("[]", "{}"), F.schema_of_variant(v) != "STRING").otherwise(trim_all(printed) == "")
        return F.when(v.isNull() | F.is_variant_null(v), False).otherwise(~empty)

    return let(F.try_variant_get(v, "$", "string"), judged)

"""Finding algebra: normalise, sign, de-duplicate, merge and review.

Rows are (keys, stage, pos, f): `f` is the finding as map<string,variant>, `pos`
its place in the document, and `keys` name the document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import jsontext, labels, text
from siftlake.functions.jsontext import let, meaningful, shown_at, text_at, to_text
from siftlake.operators.findings import parse_findings, where_parsed
from siftlake.session import written_table


def field(f: Column | str, key: str) -> Column:
    """Printed form of a finding's top-level field."""
    return to_text(F.try_element_at(text.column(f), F.lit(key)))


def with_fields(f: Column, updates: dict[str, Column], drop: dict[str, Column] | None = None) -> Column:
    """The map with fields set (a null update leaves the field alone) or dropped where the condition holds."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    value.isNotNull(),
                    F.struct(F.lit(key).alias("key"), jsontext.string_variant(value).alias("value")),
                )
                for key, value in updates.items()
            ]
        )
    )

    dropped = F.array_compact(F.array(*[F.when(condition, F.lit(key)) for key, condition in (drop or {}).items()]))

    def apply(new: Column) -> Column:
        gone = F.transform(new, lambda e: e["key"])
        if drop:
            gone = F.concat(gone, dropped)
        kept = let(gone, lambda keys: F.map_filter(f, lambda k, _: ~F.array_contains(keys, k)))
        return F.map_concat(kept, F.map_from_entries(new))

    return let(entries, apply)


def _normalized(f: Column, stage: Column, origin: Column) -> Column:
    audited = stage != "init"
    stage_type = labels.stage_type(stage)

    def severity(key: str) -> Column:
        return let(field(f, key), lambda s: F.when(~text.blank(s), labels.norm_severity(s)))

    def with_status(status: Column) -> Column:
        updates = {
            "type": F.when(audited & text.blank(field(f, "type")), F.nullif(stage_type, F.lit(""))),
            "severity": severity("severity"),
            "reviewed_severity": severity("reviewed_severity"),
            "origin": F.when(audited, let(field(f, "origin"), lambda o: text.or_default(o, origin))),
            "verification_status": F.when(audited, status),
        }
        no_reason = audited & (status == "unreviewed") & text.blank(field(f, "verification_reason"))
        return with_fields(f, updates, {"verification_reason": no_reason})

    return let(let(field(f, "verification_status"), labels.verification_status), with_status)


def normalize_findings(
    rows: DataFrame, default_origin: Column | str = "initial", fields: list[str] | None = None
) -> DataFrame:
    """Default the type by stage, normalise severities, origin and review status.

    With `fields` the rows have an `item` of `text_reader(fields)`; these fields' texts come instead of it.
    """
    origin = F.lit(default_origin) if isinstance(default_origin, str) else default_origin
    if fields is not None:
        shown = [_normal_texts(F.col("item"), F.col("stage"), origin, name)[0] for name in fields]
        return rows.select(
            *[c for c in rows.columns if c != "item"], *[F.coalesce(t, F.lit("")).alias(n) for n, t in zip(fields, shown)]
        )
    return rows.withColumn("f", let(F.col("f"), lambda f: _normalized(f, F.col("stage"), origin)))


def _joined_signature(parts: list[Column], description: Column) -> Column:
    fallback = F.lower(text.trim_all(description))
    return let(
        F.concat_ws("|", *parts), lambda s: F.when(F.btrim(s, F.lit("|")) != "", s).otherwise(fallback)
    )


def _signature(kind: Column, subtype: Column, location: Column, trigger: Column, description: Column) -> Column:
    places = [text_at(location, x) for x in ("file", "line", "function")]
    return _signature_of(kind, subtype, *places, *[text_at(trigger, x) for x in ("method", "path", "parameter")], description)


def _signature_of(
    kind: Column, subtype: Column, file: Column, line: Column, function: Column,
    method: Column, path: Column, parameter: Column, description: Column,
) -> Column:
    return _joined_signature(
        [
            F.lower(text.trim_all(kind)),
            F.lower(text.trim_all(subtype)),
            F.lower(text.trim_all(file)),
            text.trim_all(line),
            F.lower(text.trim_all(function)),
            F.upper(text.trim_all(method)),
            text.trim_all(path),
            text.trim_all(parameter),
        ],
        description,
    )


def finding_signature(f: Column | str) -> Column:
    """Text that two findings share when they are the same finding."""
    f = text.column(f)
    return _signature(
        field(f, "type"),
        field(f, "subtype"),
        F.try_element_at(f, F.lit("location")),
        F.try_element_at(f, F.lit("trigger")),
        field(f, "description"),
    )


def item_signature(item: Column, stage: Column) -> Column:
    """Signature of an array element as it will be after normalisation."""
    kind = let(
        text_at(item, "type"),
        lambda t: F.when(text.blank(t) & (stage != "init"), labels.stage_type(stage)).otherwise(t),
    )
    return _signature(
        kind,
        text_at(item, "subtype"),
        F.try_variant_get(item, "$.location", "variant"),
        F.try_variant_get(item, "$.trigger", "variant"),
        text_at(item, "description"),
    )


# ---- findings as texts: of a few fields only, read in one walk over each element ----

SIGNED = [
    "type", "subtype", "location.file", "location.line", "location.function",
    "trigger.method", "trigger.path", "trigger.parameter", "description",
]


def text_reader(fields: list[str]) -> jsontext.Reader:
    """Reader of elements for signatures and these top-level fields, for the operators' `fields`."""
    return jsontext.texts([*SIGNED, "verification_status", *fields])


def text_signature(item: Column, stage: Column) -> Column:
    """`item_signature` of an element read by `text_reader`."""
    own, *others = [shown_at(item, path) for path in SIGNED]
    kind = F.when(text.blank(own) & (stage != "init"), labels.stage_type(stage)).otherwise(own)
    return _signature_of(kind, *others)


def _normal_texts(item: Column, stage: Column, origin: Column, name: str) -> tuple[Column, Column]:
    """Text of a field after `_normalized`, and the same where it is meaningful, else null."""
    audited = stage != "init"
    own = item["t"][name]
    status = labels.verification_status(shown_at(item, "verification_status"))
    updates = {
        "type": F.when(audited & text.blank(own), F.nullif(labels.stage_type(stage), F.lit(""))),
        "severity": F.when(~text.blank(own), labels.norm_severity(own)),
        "reviewed_severity": F.when(~text.blank(own), labels.norm_severity(own)),
        "origin": F.when(audited, text.or_default(own, origin)),
        "verification_status": F.when(audited, status),
    }
    hollow = F.coalesce(F.array_contains(item["hollow"], name), F.lit(False))
    said = F.when(~text.blank(own) & ~hollow, own)
    if name in updates:
        return F.coalesce(updates[name], own), F.coalesce(updates[name], said)
    if name == "verification_reason":
        return F.when(audited & (status == "unreviewed") & text.blank(own), None).otherwise(own), said
    return own, said


def folded_texts(
    rows: DataFrame, kept: list[str], members: Column, fields: list[str], member: Callable[[Column], tuple[Column, Column]]
) -> DataFrame:
    """`kept` and the fields of all members as one finding, as `folded` and `field` give them.

    `member` names the element of a member and its default origin.
    """

    def values(m: Column, which: int) -> list[Column]:
        return [_normal_texts(*member(m)[:1], F.col("stage"), member(m)[1], name)[which] for name in fields]

    def struct(columns: list[Column]) -> Column:
        return F.struct(*[c.alias(name) for name, c in zip(fields, columns)])

    def overlaid(acc: Column, m: Column) -> Column:
        return struct([F.coalesce(new, acc[name]) for name, new in zip(fields, values(m, 1))])

    rows = rows.withColumn("_members", members)
    first = struct(values(F.get("_members", F.lit(0)), 0))
    rest = F.slice("_members", F.lit(2), F.size("_members"))
    several = F.when(F.size("_members") > 1, F.aggregate(rest, first, overlaid))
    rows = rows.withColumn("_several", several)
    # A single member is read without a lambda, whose body is not compiled.
    for name, alone in zip(fields, values(F.get("_members", F.lit(0)), 0)):
        shown = F.when(F.col("_several").isNotNull(), F.col("_several")[name]).otherwise(alone)
        rows = rows.withColumn(name, F.coalesce(shown, F.lit("")))
    return rows.select(*kept, *fields)


def item_route_signature(item: Column, _stage: Column) -> Column:
    return F.concat_ws(
        "|",
        F.upper(text.trim_all(text_at(item, "method"))),
        text.trim_all(text_at(item, "path")),
        text.trim_all(text_at(item, "source")),
    )


def merge_maps(base: Column, overlay: Column) -> Column:
    """Overlay's meaningful values replace or extend the base."""


    def apply(later: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(later, k)), later)

    return let(F.map_filter(overlay, lambda _, v: meaningful(v)), apply)


def _groups(items: Column, sigs: Column) -> Column:
    """Elements of one document grouped by signature: array of (pos, sig, members), members in order.

    Only signatures and places are sorted. Runs of equal signatures are marked by their first place and members taken
    between two marks, so the work is that of the sort; a document without repeats is taken as it is.
    """
    single = F.transform(
        F.arrays_zip(items.alias("items"), sigs.alias("sigs")),
        lambda z, i: F.struct(i.alias("pos"), z["sigs"].alias("sig"), F.array(z["items"]).alias("members")),
    )
    sorted_places = F.sort_array(F.transform(sigs, lambda s, i: F.struct(s.alias("sig"), i.alias("i"))))

    def grouped(pairs: Column) -> Column:
        def begins(p: Column, k: Column) -> Column:
            return (k == 0) | ~p["sig"].eqNullSafe(F.get(pairs, k - 1)["sig"])

        marked = F.transform(pairs, lambda p, k: F.when(begins(p, k), k))
        return jsontext.let(F.array_compact(marked), lambda starts: members_between(pairs, starts))

    def members_between(pairs: Column, starts: Column) -> Column:
        def run(start: Column, g: Column) -> Column:
            last = F.coalesce(F.get(starts, g + 1), F.size(pairs)) - 1
            first = F.get(pairs, start)
            members = F.transform(F.sequence(start, last), lambda k: F.get(items, F.get(pairs, k)["i"]))
            return F.struct(first["i"].alias("pos"), first["sig"].alias("sig"), members.alias("members"))

        return F.transform(starts, run)

    several = jsontext.let(sorted_places, grouped)
    return F.when(F.size(F.array_distinct(sigs)) < F.size(sigs), several).otherwise(single)


def signature_groups(docs: DataFrame, keys: list[str], signer) -> DataFrame:
    """Rows (keys, stage, pos, sig, members) of documents with an `items` column.

    A repeat never leaves its document, so repeats are brought together inside its row: each
    document is parsed once and nothing is shuffled.
    """
    signed = docs.select(
        *keys, "stage", "items", F.transform("items", lambda x: signer(x, F.col("stage"))).alias("sigs")
    )
    groups = signed.withColumn("groups", _groups(F.col("items"), F.col("sigs")))
    rows = groups.select(*keys, "stage", F.explode_outer("groups").alias("z"))
    return rows.filter(F.col("z").isNotNull()).select(*keys, "stage", "z.pos", "z.sig", "z.members")


def folded(members: Column, read: Callable[[Column], Column]) -> Column:
    """The maps of all members, later ones merged over earlier ones; null without members."""

    def merged(maps: Column) -> Column:
        rest = F.slice(maps, F.lit(2), F.size(maps))
        return F.aggregate(rest, F.get(maps, F.lit(0)), merge_maps)

    many = F.when(F.size(members) > 1, let(F.transform(members, read), merged))
    return F.coalesce(many, F.when(F.size(members) == 1, read(F.get(members, F.lit(0)))))


def document_findings(
    docs: DataFrame, keys: list[str], signer=item_signature, fields: list[str] | None = None
) -> DataFrame:
    """Rows (keys, stage, pos, sig, f): every element of documents with an `items` column.

    With `fields` the items are those of `text_reader(fields)`, and each stands as `item` in place of `f`.
    """
    # Signed after the explode, where the expression is compiled and left out if no one reads it.
    rows = docs.select(*keys, "stage", F.posexplode_outer("items").alias("pos", "item"))
    if fields is not None:
        return rows.filter(F.col("pos").isNotNull()).select(
            *keys, "stage", "pos", text_signature(F.col("item"), F.col("stage")).alias("sig"), "item"
        )
    return rows.filter(F.col("pos").isNotNull()).select(
        *keys, "stage", "pos", signer(F.col("item"), F.col("stage")).alias("sig"), jsontext.payload("item").alias("f")
    )


def fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merge all rows of a (keys, sig) group in position order into the first one.

    Folding overlays key by key means: the last meaningful value wins, and a
    value that is not meaningful stays only when the first row has it. Both are
    aggregates with partial results, so a group of any size is combined before
    the shuffle and never collected.
    """
    group = [*keys, "stage", "sig"]
    entries = rows.select(*group, "pos", F.explode_outer("f").alias("key", "value"))
    per_key = entries.groupBy(*group, "key").agg(
        F.min("pos").alias("key_pos"),
        F.min_by("value", "pos").alias("first_value"),
        F.max_by("value", F.when(meaningful("value"), F.col("pos"))).alias("last_value"),
    )
    # At most one entry per distinct field name is collected here.
    merged = per_key.groupBy(*group).agg(
        F.min("key_pos").alias("pos"),
        F.collect_list(F.struct("key", "key_pos", "first_value", "last_value")).alias("fields"),
    )
    kept = F.filter(
        "fields",
        lambda e: e["key"].isNotNull() & (e["last_value"].isNotNull() | (e["key_pos"] == F.col("pos"))),
    )
    pairs = F.transform(
        kept,
        lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["last_value"], e["first_value"]).alias("value")),
    )
    return merged.select(*group, "pos", F.map_from_entries(pairs).alias("f"))


def dedupe_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, sig) at its first position, later rows merged into it."""
    return fold(rows, keys).select(*keys, "stage", "sig", "pos", "f")


def by_repeats(
    docs: DataFrame,
    keys: list[str],
    alone: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame],
    all_keys: DataFrame | None = None,
) -> DataFrame:
    """`alone` of the documents whose keys no other document has, and `across` of the others.

    Repeats inside a document are met in its row, so only documents with repeated keys go through a shuffle. The keys
    that repeat are counted first, in `all_keys` if these are cheaper to read.
    """
    counted = (docs if all_keys is None else all_keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    repeated = written_table(counted.where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]), "repeated-keys")
    if repeated.isEmpty():
        return alone(docs)
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = alone(docs.join(repeated, same, "left_anti"))
    return rows.unionByName(across(docs.join(repeated, same, "left_semi")))


def fold_texts(rows: DataFrame, keys: list[str], fields: list[str], origin: str = "initial") -> DataFrame:
    """`fold` of normalised findings for rows with an `item` of `text_reader(fields)`: the fields' texts."""
    pairs = [_normal_texts(F.col("item"), F.col("stage"), F.lit(origin), name) for name in fields]
    own, said = ([f"_{kind}_{name}" for name in fields] for kind in ("own", "said"))
    flat = rows.select(
        *keys, "stage", "sig", "pos", *[p[0].alias(n) for n, p in zip(own, pairs)], *[p[1].alias(n) for n, p in zip(said, pairs)]
    )
    merged = flat.groupBy(*keys, "stage", "sig").agg(
        F.min("pos").alias("pos"),
        *[
            F.coalesce(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("pos"))), F.min_by(o, "pos"), F.lit("")).alias(name)
            for name, o, s in zip(fields, own, said)
        ],
    )
    return merged.select(*keys, "stage", "sig", "pos", *fields)


def dedupe_documents(docs: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """`dedupe_findings` of whole documents (keys, stage, items), normalised."""
    if fields is not None:
        return by_repeats(
            docs,
            keys,
            lambda d: initial_findings(d, keys, fields),
            lambda d: fold_texts(document_findings(d, keys, fields=fields), keys, fields),
        )
    return by_repeats(
        docs,
        keys,
        lambda d: initial_findings(d, keys),
        lambda d: dedupe_findings(normalize_findings(document_findings(d, keys)), keys).select(
            *keys, "stage", "sig", "pos", "f"
        ),
    )


def initial_findings(docs: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Findings of each document, normalised, repeats merged into the first.

    With `fields` the items are those of `text_reader(fields)`, and these fields' texts stand in place of `f`. So it is
    with all operators that take `fields`.
    """
    if fields is not None:
        rows = signature_groups(docs, keys, text_signature)
        return folded_texts(rows, [*keys, "stage", "sig", "pos"], F.col("members"), fields, lambda m: (m, F.lit("initial")))

    def read(item: Column) -> Column:
        return _normalized(jsontext.payload(item), F.col("stage"), F.lit("initial"))

    rows = signature_groups(docs, keys, item_signature)
    return rows.select(*keys, "stage", "sig", "pos", folded(F.col("members"), read).alias("f"))


def existing_findings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Stored findings, blank origins taken as initial."""
    return initial_findings(docs, keys)


def merge_routes(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and new route inventories as one, overlaid by route signature.

    Both take documents (keys, stage, items); new routes come after stored ones.
    """
    both = [
        document_findings(docs, keys, item_route_signature)
        .withColumn("pos", F.struct(F.lit(i).alias("run"), F.col("pos").alias("pos")))
        for i, docs in enumerate((existing, incoming))
    ]
    return fold(both[0].unionByName(both[1]), keys)


def _run_members(runs: DataFrame, keys: list[str], signer: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (keys, stage, pos, sig, members) of runs; members are (run, pos, item): run 0 is stored, 1 is an answer."""

    def tagged(name: str, run: int) -> Column:
        items = F.coalesce(name, F.array().cast(runs.schema[name].dataType))
        return F.transform(items, lambda x, i: F.struct(F.lit(run).alias("run"), i.alias("pos"), x.alias("item")))

    both = F.concat(tagged("stored_items", 0), tagged("answer_items", 1))
    return signature_groups(
        runs.select(*keys, "stage", both.alias("items")), keys, lambda z, stage: signer(z["item"], stage)
    )


def run_groups(runs: DataFrame, keys: list[str], signer: Callable[[Column, Column], Column] = item_signature) -> DataFrame:
    """Rows (keys, stage, sig, base, answers) of runs with `stored_items` and `answer_items`.

    Both lists are grouped by signature inside their row, so a run is parsed once and nothing is shuffled.
    """
    return _run_members(runs, keys, signer).select(
        *keys,
        "stage",
        "sig",
        F.filter("members", lambda m: m["run"] == 0).alias("base"),
        F.filter("members", lambda m: m["run"] == 1).alias("answers"),
    )


def _read(member: Column, origin: str) -> Column:
    return _normalized(jsontext.payload(member["item"]), F.col("stage"), F.lit(origin))


def _stored(groups: DataFrame) -> Column:
    """The stored findings of a signature as one, blank origins taken as initial."""
    return folded(F.col("base"), lambda m: _read(m, "initial"))


def _first_answer() -> Column:
    return F.get("answers", F.lit(0))


def _answer_first() -> Column:
    return F.slice("answers", 1, 1)


def _answer_last() -> Column:
    return F.slice("answers", F.greatest(F.size("answers"), F.lit(1)), F.lit(1))


def _run_texts(groups: DataFrame, kept: list[str], members: Column, fields: list[str], origin: str | Column) -> DataFrame:
    """`folded_texts` of members of runs; `origin` is the default of answers."""
    return folded_texts(
        groups, kept, members, fields, lambda m: (m["item"], F.when(m["run"] == 1, origin).otherwise("initial"))
    )


def unseen_candidates(groups: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """First candidate per signature that is not among the stored findings."""
    fresh = groups.filter((F.size("base") == 0) & (F.size("answers") > 0))
    if fields is not None:
        fresh = fresh.withColumn("pos", _first_answer()["pos"])
        return _run_texts(fresh, [*keys, "stage", "sig", "pos"], _answer_first(), fields, "gap_check")
    return fresh.select(
        *keys, "stage", "sig", _first_answer()["pos"].alias("pos"), _read(_first_answer(), "gap_check").alias("f")
    )


def gap_check_merge(
    groups: DataFrame, keys: list[str], enrich: bool = False, fields: list[str] | None = None
) -> DataFrame:
    """Stored findings and unseen candidates: (keys, stage, sig, run, pos, f), `run` 1 for the latter.

    A candidate that matches a stored finding is ignored; with `enrich` its
    meaningful values are merged in instead.
    """
    known = F.size("base") > 0
    first = F.coalesce(F.get("base", F.lit(0)), _first_answer())
    if fields is not None:
        members = F.concat("base", "answers") if enrich else F.when(known, F.col("base")).otherwise(_answer_first())
        placed = groups.withColumns({"run": first["run"], "pos": first["pos"]})
        return _run_texts(placed, [*keys, "stage", "sig", "run", "pos"], members, fields, "gap_check")
    if enrich:
        more = folded(F.col("answers"), lambda m: _read(m, "gap_check"))
        stored = _stored(groups)
        f = F.coalesce(let(more, lambda m: F.when(m.isNotNull() & known, merge_maps(stored, m))), stored, more)
    else:
        f = F.when(known, _stored(groups)).otherwise(_read(_first_answer(), "gap_check"))
    return groups.select(*keys, "stage", "sig", first["run"].alias("run"), first["pos"].alias("pos"), f.alias("f"))


def match_reviews(groups: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Stored findings with the last review of the same signature in `review` (null when none).

    With `fields`, only the review's texts are given: those are '' without a review, and `reviewed` tells.
    """
    last = F.get("answers", F.size("answers") - 1)
    if fields is not None:
        stored = groups.filter(F.size("base") > 0).withColumns(
            {"pos": F.get("base", F.lit(0))["pos"], "reviewed": F.size("answers") > 0}
        )
        rows = _run_texts(stored, [*keys, "stage", "sig", "pos", "reviewed"], _answer_last(), fields, "initial")
        return rows.withColumns({name: F.when(F.col("reviewed"), F.col(name)).otherwise("") for name in fields})
    return groups.filter(F.size("base") > 0).select(
        *keys,
        "stage",
        "sig",
        F.get("base", F.lit(0))["pos"].alias("pos"),
        _stored(groups).alias("f"),
        F.when(F.size("answers") > 0, _read(last, "initial")).alias("review"),
    )


def revalidation_merge(groups: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Reviews merged over the findings they match; reviews without a match are dropped.

    Reviews arrive normalised with origin `initial` and status `unreviewed` as
    defaults, so a review without them overwrites the stored values.
    """
    if fields is not None:
        stored = groups.filter(F.size("base") > 0).withColumn("pos", F.get("base", F.lit(0))["pos"])
        members = F.concat("base", _answer_last())
        return _run_texts(stored, [*keys, "stage", "sig", "pos"], members, fields, "initial")
    merged = F.when(F.col("review").isNotNull(), merge_maps(F.col("f"), F.col("review"))).otherwise(F.col("f"))
    return match_reviews(groups, keys).withColumn("f", merged).drop("review")


def review_counts(final: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Confirmed, uncertain and rejected findings per document, and more aggregates of them.

    Findings are maps `f` or have their `verification_status` as a text.
    """
    own = F.col("verification_status") if "verification_status" in final.columns else field("f", "verification_status")
    return (
        final.withColumn("_status", labels.verification_status(own))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_status") == "confirmed").alias("confirmed_count"),
            F.count_if(F.col("_status") == "uncertain").alias("uncertain_count"),
            F.count_if(F.col("_status") == "rejected").alias("rejected_count"),
            *more,
        )
    )


def revalidation_summary(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "review_summary",
        F.format_string(
            dims.SUMMARY_REVALIDATED,
            "confirmed_count",
            "uncertain_count",
            "rejected_count",
        ),
    )


def gap_check_summary(final: DataFrame, keys: list[str]) -> DataFrame:
    """Review counts plus how many findings the gap check added."""
    # One aggregate over one parse: a join of two would parse every run twice.
    counts = review_counts(final, keys, F.count_if(F.col("run") == 1).alias("added"))
    said = F.when(
        F.col("added") > 0,
        F.format_string(dims.SUMMARY_GAP_MERGED, "added"),
    ).otherwise(dims.SUMMARY_GAP_NONE)
    return counts.filter(_no_null(keys)).withColumn("review_summary", said)


def _no_null(keys: list[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def run_answers(stages: DataFrame, answers: DataFrame, read: jsontext.Reader = jsontext.VARIANTS) -> DataFrame:
    """Answers with their stage's stored items, the recovered items and an error, if any.

    `answers` has (stage_id, kind, content); stage `init` is the route inventory. A first run replaces what is
    stored, so its stored items are null.
    """
    # Texts meet before they are parsed: nothing parsed is shuffled, and what no run looks at isn't parsed.
    texts = stages.select("stage_id", F.col("name").alias("stage"), "result", "output_json")
    joined = answers.withColumn("kind", labels.norm_run_kind("kind")).join(texts, "stage_id")
    first_run = F.col("kind") == "initial"
    joined = parse_findings(
        joined.withColumns({c: F.when(~first_run, F.col(c)) for c in ("result", "output_json")}), read
    ).select(*answers.columns, "stage", F.col("items").alias("stored_items"))
    empty = F.array().cast(read.type)

    def judged(answer: Column) -> Column:
        valid, items = answer["valid"], answer["items"]
        error = (
            F.when(~valid & ~first_run, "invalid_json")
            .when((F.col("stage") == "init") & (F.col("kind") == "revalidate"), "no_revalidation")
            .when(~first_run & F.col("stored_items").isNull(), "no_structured_result")
            .when(valid & items.isNull(), "not_an_array")
        )
        return F.struct(error.alias("error"), F.when(valid, items).otherwise(empty).alias("answer_items"))

    answer = let(
        let(
            jsontext.best_items("content", read),
            lambda found: F.struct(found.isNotNull().alias("valid"), read.finish(found["items"]).alias("items")),
        ),
        judged,
    )
    return (
        joined.withColumn("_answer", answer)
        .withColumn("error", F.col("_answer.error"))
        .withColumn("answer_items", F.col("_answer.answer_items"))
        .drop("_answer")
    )


def finalize_run(runs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Findings after each run without an error: (stage_id, kind, stage, sig, run, pos, f).

    All kinds of runs in one pass over their documents, without a shuffle: a first run stores its answers, a
    gap check adds the first answer of every other signature (`run` 1), a revalidation overlays
    the last answer of the same signature.
    """
    keys = ["stage_id", "kind"]
    good = where_parsed(runs.filter(F.col("stage") != "init"), F.col("error").isNull())
    first_run = F.col("kind") == "initial"
    none = F.array().cast(runs.schema["answer_items"].dataType)
    good = good.select(
        *keys,
        "stage",
        F.when(first_run, F.col("answer_items")).otherwise(F.col("stored_items")).alias("stored_items"),
        F.when(first_run, none).otherwise(F.col("answer_items")).alias("answer_items"),
    )
    groups = run_groups(good, keys, item_signature if fields is None else text_signature)
    gap, review = F.col("kind") == "gap_check", F.col("kind") == "revalidate"
    known, answered = F.size("base") > 0, F.size("answers") > 0
    if fields is not None:
        first = F.coalesce(F.get("base", F.lit(0)), _first_answer())
        members = (
            F.when(known & answered & review, F.concat("base", _answer_last()))
            .when(known, F.col("base"))
            .otherwise(_answer_first())
        )
        placed = groups.filter(known | gap).withColumns({"run": first["run"], "pos": first["pos"]})
        return _run_texts(placed, [*keys, "stage", "sig", "run", "pos"], members, fields, F.when(gap, "gap_check").otherwise("initial"))
    stored, last = _stored(groups), F.get("answers", F.size("answers") - 1)
    f = (
        F.when(known & answered & review, let(_read(last, "initial"), lambda r: merge_maps(stored, r)))
        .when(known, stored)
        .otherwise(_read(_first_answer(), "gap_check"))
    )
    first = F.coalesce(F.get("base", F.lit(0)), _first_answer())
    return groups.filter(known | gap).select(
        *keys, "stage", "sig", first["run"].alias("run"), first["pos"].alias("pos"), f.alias("f")
    )


def finalize_routes(runs: DataFrame) -> DataFrame:
    """Route inventories after each `init` run without an error."""
    keys = ["stage_id", "kind"]
    good = where_parsed(runs.filter(F.col("stage") == "init"), F.col("error").isNull())
    first = good.filter(F.col("kind") == "initial").select(*keys, "stage", F.col("answer_items").alias("items"))
    # A first run stores what it found, repeats included.
    routes = document_findings(first, keys, item_route_signature).select(
        *keys, "stage", "sig", F.struct(F.lit(0).alias("run"), "pos").alias("pos"), "f"
    )

    def across(gap: DataFrame) -> DataFrame:
        merged = merge_routes(
            gap.select(*keys, "stage", F.col("stored_items").alias("items")),
            gap.select(*keys, "stage", F.col("answer_items").alias("items")),
            keys,
        )
        return merged.select(*routes.columns)

    def alone(gap: DataFrame) -> DataFrame:
        first_of = F.get("members", F.lit(0))
        return _run_members(gap, keys, item_route_signature).select(
            *keys,
            "stage",
            "sig",
            F.struct(first_of["run"].alias("run"), first_of["pos"].alias("pos")).alias("pos"),
            folded(F.col("members"), lambda m: jsontext.payload(m["item"])).alias("f"),
        )

    gap = F.col("kind") == "gap_check"
    checked = runs.filter((F.col("stage") == "init") & gap).select(*keys)
    return routes.unionByName(by_repeats(good.filter(gap), keys, alone, across, checked))

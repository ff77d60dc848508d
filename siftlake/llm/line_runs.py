"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import without, written

OUT = ["n_lines", "n_removed_lines", "removed_lines", "clean_text"]
DOC = ["doc_id", "_content"]


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: its document, number among such lines (`at`), place among all lines
    (`raw`), 96-bit hash and words. Rows that repeat id and text count once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(i.alias("raw"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), _words(x).alias("w")),
    )
    rows = docs.select("doc_id", F.xxhash64(text).alias("_content"), F.filter(lines, lambda x: x["w"] > 0).alias("_l"))
    rows = rows.dropDuplicates(DOC)
    return rows.select(*DOC, F.posexplode("_l").alias("at", "_x")).select(*DOC, "at", "_x.*")


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of distinct keys in their order over the whole table.

    Rows are dealt out by ranges of the keys and sorted; the running number of Spark
    rises with the partition and the row, so no rank passes through one task.
    """
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("_rank", F.monotonically_increasing_id()), "run-ranks")


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Suffix ranks of the positions whose line occurs more than once.

    `ranks[k]` orders the suffixes by their first 2^k lines: equal where these are equal. Lines that
    occur once end every run, so positions that hold them are left out and act as end marks.
    Doubling goes on while 2^(k+1) <= depth, as longer prefixes are told apart by two overlapping ranks.
    Returns the positions and the number of doublings.
    """
    # Counts are added up before their shuffle; the joins are inner, so a line in every
    # document is dealt to several tasks at run time.
    repeated = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", "g")
    first = _ranked(repeated, ["h", "g"])
    rows = lines.join(first, ["h", "g"]).select(*DOC, "at", "raw", "w", F.array("_rank").alias("ranks"))
    rows = written(rows, "run-rows")
    k = 0
    while 2 ** (k + 1) <= depth:
        order = Window.partitionBy(*DOC).orderBy("at")
        step = 2**k
        follows = F.lead("at", step).over(order) == F.col("at") + step
        rows = rows.withColumn("_a", F.get("ranks", F.lit(k)))
        # A suffix that ends before comes first, as a shorter word does.
        rows = rows.withColumn("_b", F.when(follows, F.lead("_a", step).over(order)).otherwise(F.lit(-1)))
        rows = written(rows, "run-pairs")
        classes = _ranked(rows.select("_a", "_b").distinct(), ["_a", "_b"])
        rows = rows.join(classes, ["_a", "_b"]).select(
            *DOC, "at", "raw", "w", F.array_append("ranks", F.col("_rank")).alias("ranks")
        )
        rows = written(rows, "run-rows")
        k += 1
    return rows, k


def _windows(rows: DataFrame, doublings: int, min_words: int) -> DataFrame:
    """The shortest runs of repeated lines with `min_words` words from each position on, and up
    to each position, with the two ranks that name their LCP interval.

    A run of L lines starts in the interval of all suffixes with its first L lines. That
    interval is where the ranks of 2^k lines at its start and 2^k lines before its end agree, 2^k <= L < 2^(k+1).
    """
    order = Window.partitionBy(*DOC).orderBy("at")
    entry = F.struct("at", "w", "raw", "ranks")
    rows = rows.withColumn("_fore", F.collect_list(entry).over(order.rowsBetween(0, min_words - 1)))
    rows = rows.withColumn("_back", F.reverse(F.collect_list(entry).over(order.rowsBetween(-(min_words - 1), 0))))

    def length(frame: str, sign: str) -> Column:
        # Adds lines up as long as each stands next to the one before and words are missing.
        return F.expr(
            f"aggregate({frame}, named_struct('n', 0, 's', 0L), (a, x) -> if(a.s >= {min_words} or "
            f"x.at != at {sign} a.n, a, named_struct('n', a.n + 1, 's', a.s + x.w)), a -> if(a.s >= {min_words}, a.n, 0))"
        )

    rows = rows.withColumn("_nf", length("_fore", "+")).withColumn("_nb", length("_back", "-"))
    power = "cast(floor(log2({n})) as int)"
    fore = (
        "named_struct('start', at, 'n', _nf, 'k', {k}, 'first', get(ranks, {k}), "
        "'last', get(get(_fore, _nf - cast(pow(2, {k}) as int)).ranks, {k}))"
    ).format(k=power.format(n="_nf"))
    back = (
        "named_struct('start', at - _nb + 1, 'n', _nb, 'k', {k}, 'first', get(get(_back, _nb - 1).ranks, {k}), "
        "'last', get(get(_back, cast(pow(2, {k}) as int) - 1).ranks, {k}))"
    ).format(k=power.format(n="_nb"))
    runs = F.expr(f"filter(array(if(_nf > 0, {fore}, null), if(_nb > 0, {back}, null)), x -> x is not null)")
    rows = rows.select(*DOC, F.explode(F.array_distinct(runs)).alias("_x"))
    return rows.select(*DOC, "_x.*").distinct()


def removed_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, _content, removed_lines): the lines of each document to delete, by place from 0.

    Null or empty texts have no lines with words and lose none; a null doc_id is one document's id; an empty table gives
    no rows.
    """
    lines = written(line_table(docs.select("doc_id", "text")), "run-lines")
    # Every line has a word, so no run needs more lines than words.
    rows, doublings = suffix_ranks(lines, min_words)
    runs = written(_windows(rows, doublings, min_words), "run-windows")
    key = ["n", "first", "last"]
    where = F.struct(*DOC, "start")
    # A table of its own, so that the join on a run that many documents share can be split.
    groups = written(
        runs.groupBy(*key)
        .agg(F.min(where).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .select(*key, "_first"),
        "run-groups",
    )
    later = runs.join(groups, key).where(~where.eqNullSafe(F.col("_first")))
    spans = later.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    places = rows.select(F.col("doc_id").alias("_d"), F.col("_content").alias("_c"), F.col("at").alias("_a"), "raw")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c")) & (F.col("at") == F.col("_a"))
    return (
        spans.join(places, same)
        .groupBy(*DOC)
        .agg(F.sort_array(F.collect_set("raw")).alias("removed_lines"))
    )


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Adds `n_lines`, `n_removed_lines`, `removed_lines` (places from 0) and `clean_text`.

    A run of consecutive lines is a repeat when an equal run stands earlier (by doc_id, then by text
    hash for equal ids, then by place) and it has at least `min_words` words. Every line of
    a repeat is deleted, so of each maximal repeated run the first copy stays. Runs may lie inside one document
    and overlap. Lines without a word are neither compared nor deleted. Line ids are 96-bit hashes
    of whole lines.

    A maximal repeated run is covered by the shortest runs with enough words from each of its
    lines on and up to each of its lines, so only their LCP intervals are looked up: at most two for
    each position, however long the run.

    Null or empty texts have no lines with words; a null doc_id comes first; rows that repeat id
    and text count as one document and get equal results; an empty table gives an empty result. Input columns
    with the names above give way.
    """
    docs = without(docs, OUT)
    removed = removed_lines(docs, min_words).select(
        F.col("doc_id").alias("_d"), F.col("_content").alias("_c"), "removed_lines"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_c"))
    out = docs.join(removed, same, "left").drop("_d", "_c")
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.expr("cast(array() as array<int>)")))
    out = out.withColumn("n_lines", F.size(F.split(text, "\n")).cast("long"))
    out = out.withColumn("n_removed_lines", F.size("removed_lines").cast("long"))
    return _rebuilt(out).select(*[F.col(f"`{c}`") for c in docs.columns], *OUT)


def _rebuilt(rows: DataFrame) -> DataFrame:
    """`clean_text`: the lines that stay, joined again."""
    rows = rows.withColumn("_all", F.when(F.col("n_removed_lines") > 0, F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("removed_lines"))
    rows = rows.withColumn("_stay", F.when(F.col("n_removed_lines") > 0, stay))
    joined = F.array_join(F.expr("transform(_stay, i -> get(_all, i))"), "\n")
    return rows.withColumn("clean_text", F.when(F.col("n_removed_lines") > 0, joined).otherwise(F.col("text")))

"""Schemas that drift between files.

Tagged-union inference: every value of every record is read with its tag (integer, decimal, boolean, text, array,
object), the tags of each path (file, field) are fused to the set of alternatives that occur there, and consecutive
files of a series are compared path by path. Conflicting alternatives become typed branches of one field plus a
canonical text that all branches convert to.

Scale: records meet once, by series and record number, to learn which of them the files before and after have too;
everything else is one aggregation per path with fixed-width states (a bit per tag, counts and order-free fingerprints), so
no pairs of records or fields are formed. Renames are equal fingerprints, on the records in both files, of a column that is
gone and one that is new.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAGS = ("integer", "decimal", "boolean", "text", "array", "object")
#: Texts that stand for a missing value.
MISSING = ("", "NA")
#: Field names are metadata; a table with more of them than this is refused when its names are fused.
MAX_FIELDS = 20_000


def literal_tag(value: Column) -> Column:
    """The tag of a text literal as it reads in a delimited file; null for a missing one."""
    return (
        F.when(value.isNull() | value.isin(*MISSING), F.lit(None))
        .when(value.rlike(r"\A(?:[Tt]rue|[Ff]alse)\z"), "boolean")
        .when(value.rlike(r"\A[+-]?[0-9]+\z"), "integer")
        .when(value.rlike(r"\A[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][+-]?[0-9]+)?\z"), "decimal")
        .when(value.rlike(r"(?s)\A\[.*\]\z") & F.try_parse_json(value).isNotNull(), "array")
        .when(value.rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json(value).isNotNull(), "object")
        .otherwise("text")
    )


def _variant_tag(kind: Column, text: Column) -> Column:
    return (
        F.when(kind.startswith("VOID") | text.isNull() | ((kind == "STRING") & text.isin(*MISSING)), F.lit(None))
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "decimal")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("text")
    )


def _records(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with their file's format and header; ``v`` is the parsed record of a json file."""
    f = files.select("file_id", F.lower("file_format").alias("file_format"), "header_line")
    r = rows.select("file_id", "line_no", "record_no", "payload").join(f, "file_id", "left")
    v = F.when(F.col("file_format") == "json", F.try_parse_json("payload"))
    return r.withColumn("v", v)


def _readable() -> Column:
    """Whether a row gives fields: a json object, or a line of a file that has a header."""
    return F.when(F.col("file_format") == "json", F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")).otherwise(F.col("file_format").isNotNull() & F.col("header_line").isNotNull())


def unread(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``file_id, line_no, record_no, reason`` of what ``tagged_values`` cannot take over.

    ``file`` (the row's file is unknown), ``header`` (its file has none), ``json`` (no JSON object), ``surplus`` (more
    values than the header has names; the values up to there are taken) and ``short`` (fewer; the rest counts as missing).
    """
    r = _records(files, rows)
    extra = F.size(F.split(F.coalesce("payload", F.lit("")), "\t", -1)) - F.size(F.split("header_line", "\t", -1))
    reason = (
        F.when(F.col("file_format").isNull(), "file")
        .when(~F.coalesce(_readable(), F.lit(False)), F.when(F.col("file_format") == "json", "json").otherwise("header"))
        .when((F.col("file_format") != "json") & (extra > 0), "surplus")
        .when((F.col("file_format") != "json") & (extra < 0), "short")
    )
    return r.select("file_id", "line_no", "record_no", reason.alias("reason")).where("reason is not null")


def tagged_values(files: DataFrame, rows: DataFrame, neighbours: bool = True) -> DataFrame:
    """``file_id, line_no, record_no, name, tag, value, in_prev, in_next`` of every field of every record.

    Tag and value are null if missing. ``in_prev`` and ``in_next`` tell whether the file before and the one after in the
    series have the record too; of repeated lines of one record in a file the first one carries them. They are left out
    without ``neighbours``. A record without fields gives one row without name. What cannot be read is listed by ``unread``.
    """
    r = _records(files, rows).where(_readable())
    marks = ["in_prev", "in_next"] if neighbours else []
    if neighbours:
        order = Window.partitionBy("export_table", "producer").orderBy("written_at", "file_id")
        turn = files.select("file_id", "export_table", "producer", F.row_number().over(order).alias("turn"))
        r = r.join(turn, "file_id")
        # rows without a record number meet nobody and are spread
        apart = F.when(F.col("record_no").isNull(), F.xxhash64("file_id", "line_no")).otherwise(0).alias("apart")
        r = r.select("*", apart)
        key = ["export_table", "producer", "record_no", "apart"]
        w = Window.partitionBy(*key).orderBy("turn", "line_no")
        run = Window.partitionBy(*key).orderBy("turn")
        known = F.col("record_no").isNotNull()
        r = r.withColumn("first", known & (F.coalesce(F.lag("turn").over(w), F.lit(0)) < F.col("turn")))
        before, after = F.count(F.lit(1)).over(run.rangeBetween(-1, -1)) > 0, F.count(F.lit(1)).over(run.rangeBetween(1, 1)) > 0
        r = r.withColumn("in_prev", F.col("first") & before).withColumn("in_next", F.col("first") & after)
    keep = ["file_id", "line_no", "record_no", *marks]
    json = r.where("file_format = 'json'").select(*keep, "v")
    each = json.lateralJoin(_explode_variant(json)).select(*keep, F.col("key").alias("name"), F.expr("schema_of_variant(value)").alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("text"))
    each = each.withColumn("tag", _variant_tag(F.col("kind"), F.col("text")))
    lines = r.where("file_format <> 'json'").select(*keep, F.posexplode(F.split("header_line", "\t", -1)).alias("at", "name"), F.split(F.coalesce("payload", F.lit("")), "\t", -1).alias("values"))
    flat = lines.withColumn("text", F.get("values", F.col("at"))).withColumn("tag", literal_tag(F.col("text")))
    out = ["file_id", "line_no", "record_no", "name", "tag", F.when(F.col("tag").isNotNull(), F.col("text")).alias("value"), *marks]
    return each.select(*out).unionByName(flat.select(*out))


def _explode_variant(df: DataFrame) -> DataFrame:
    return df.sparkSession.tvf.variant_explode_outer(F.col("v").outer())


def _fused_name(mask: Column) -> Column:
    """Alternatives of a bit mask as one text: integer and decimal are decimal, other mixtures are written with ``|``."""
    parts = []
    for t in sorted(TAGS):
        has = mask.bitwiseAND(F.lit(1 << TAGS.index(t))) != 0
        parts.append(F.when(has & (mask.bitwiseAND(F.lit(2)) == 0) if t == "integer" else has, F.lit(t)))
    return F.nullif(F.concat_ws("|", *parts), F.lit(""))


def _mask() -> Column:
    bit = F.lit(0)
    for k, t in enumerate(TAGS):
        bit = F.when(F.col("tag") == t, 1 << k).otherwise(bit)
    return F.coalesce(F.bit_or(bit.cast("int")), F.lit(0))


def fuse(tagged: DataFrame) -> DataFrame:
    """Per path ``file_id, name`` the sorted alternatives, their fused tag and the number of values.

    Integer and decimal fuse to decimal; other mixtures stay a union, written with ``|``. No value: null.
    """
    g = tagged.where("name is not null").groupBy("file_id", "name").agg(_mask().alias("mask"), F.count("value").alias("n_values"))
    alternatives = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << TAGS.index(t))) != 0, F.lit(t)) for t in sorted(TAGS)]))
    return g.select("file_id", "name", alternatives.alias("alternatives"), "n_values", _fused_name(F.col("mask")).alias("fused"))


def changes(files: DataFrame, tagged: DataFrame) -> DataFrame:
    """``file_id, change_kind, field_name, old_name, old_type, new_type`` of each file against the one before it.

    ``renamed`` (old_name set), ``added``, ``removed`` and ``retyped``. The first file of a series has no changes, nor
    has a file that is empty or follows an empty one any changes but added or removed fields. Names are compared exactly.
    A rename needs equal values, missing ones included, on at least one record in both files; columns with the same values as
    several others are matched in the order of their names. Values are compared by two fingerprints of 64 bits and their number.
    """
    order = Window.partitionBy("export_table", "producer").orderBy("written_at", "file_id")
    pairs = files.select("file_id", F.lag("file_id").over(order).alias("prev_id"), F.lead("file_id").over(order).alias("next_id"))
    aggs = [_mask().alias("mask")]
    for side in ("prev", "next"):
        here = F.col(f"in_{side}")
        given = here & F.col("value").isNotNull()
        h, h2 = F.xxhash64("record_no", "value"), F.xxhash64("value", "record_no", F.lit(1))
        aggs += [F.count_if(here).alias(f"c_{side}"), F.count_if(given).alias(f"n_{side}"), F.coalesce(F.bit_xor(F.when(given, h)), F.lit(0)).alias(f"h_{side}"), F.coalesce(F.bit_xor(F.when(given, h2)), F.lit(0)).alias(f"g_{side}")]
    paths = tagged.where("name is not null").groupBy("file_id", "name").agg(*aggs).join(pairs, "file_id")
    # every path twice: as the new side of its own file and as the old side of the next one
    sides = F.array(
        F.struct(F.when(F.col("prev_id").isNotNull(), F.col("file_id")).alias("pair"), F.lit(True).alias("new"), *[F.col(f"{x}_prev").alias(x) for x in "cnhg"]),
        F.struct(F.col("next_id").alias("pair"), F.lit(False).alias("new"), *[F.col(f"{x}_next").alias(x) for x in "cnhg"]),
    )
    both = paths.select("name", "mask", F.inline(sides)).where("pair is not null").repartition("pair")  # at most MAX_FIELDS names a pair; all that follows stays in place
    state = F.struct("mask", "c", "n", "h", "g")
    path = both.groupBy("pair", "name").agg(F.max(F.when(F.col("new"), state)).alias("now"), F.max(F.when(~F.col("new"), state)).alias("old"))
    whole = Window.partitionBy("pair")
    shared = (F.max("now.c").over(whole) > 0) & (F.max("old.c").over(whole) > 0)
    path = path.withColumn("moving", shared & (F.col("now").isNull() | F.col("old").isNull())).withColumn("side", F.col("now").isNull()).withColumn("fp", F.coalesce("now", "old"))
    alike = ["pair", "moving", "fp.n", "fp.h", "fp.g", "side"]
    path = path.withColumn("turn", F.row_number().over(Window.partitionBy(*alike).orderBy("name")))
    met = Window.partitionBy("pair", "moving", "fp.n", "fp.h", "fp.g", "turn")
    gone, come = F.max(F.when(F.col("moving") & F.col("side"), F.col("name"))).over(met), F.max(F.when(F.col("moving") & ~F.col("side"), F.col("name"))).over(met)
    path = path.withColumn("gone", gone).withColumn("moved", F.col("moving") & gone.isNotNull() & come.isNotNull())
    path = path.withColumn("new_type", _fused_name(F.col("now.mask"))).withColumn("old_type", _fused_name(F.col("old.mask")))
    kind = (
        F.when(F.col("moved"), F.when(F.col("old").isNull(), "renamed"))
        .when(F.col("now").isNull(), "removed").when(F.col("old").isNull(), "added")
        .when(F.nullif("new_type", F.lit("")) != F.nullif("old_type", F.lit("")), "retyped")
    )
    return path.withColumn("kind", kind).where("kind is not null").select(F.col("pair").alias("file_id"), F.col("kind").alias("change_kind"), F.col("name").alias("field_name"), F.when(F.col("kind") == "renamed", F.col("gone")).alias("old_name"), F.when(F.col("old").isNotNull(), F.col("old_type")).alias("old_type"), F.when(F.col("now").isNotNull(), F.col("new_type")).alias("new_type"))


def canonical_names(names: list[tuple[str, str, int]], moved: list[tuple[str, str, str]], known: list[str]) -> dict[tuple[str, str], str]:
    """The canonical name of each (producer, name). ``names`` are (producer, name, files that have it), ``moved`` (producer, old, new).

    Names of one producer that renames or equal letters and digits join form a group; what one producer calls a field says
    nothing about another's. A group takes the known column in it; one that has several known columns is not joined beyond equal letters. A
    group without any takes its most frequent name; groups of several producers meet by letters and digits, in the spelling most frequent over all.
    """
    if len(names) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} field names")

    def plain(x: str) -> str:
        return "".join(c for c in x.lower() if c.isalnum()) or x

    column = {plain(k): k for k in reversed(known)}
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x: tuple[str, str]) -> tuple[str, str]:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for p, n, _ in names:
        root((p, plain(n)))
    for p, a, b in moved:
        parent[root((p, plain(a)))] = root((p, plain(b)))
    groups: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for p, n, count in names:
        groups.setdefault(root((p, plain(n))), []).append((-count, n))
    total: Counter[str] = Counter()
    for _, n, count in names:
        total[n] += count
    spelling: dict[str, str] = {}
    for n in sorted(total, key=lambda n: (-total[n], n)):
        spelling.setdefault(plain(n), n)
    out: dict[tuple[str, str], str] = {}
    for (p, _), g in groups.items():
        own = {column[plain(n)] for _, n in g if plain(n) in column}
        common = min(g)[1]
        for _, n in g:
            out[p, n] = column.get(plain(n)) or (min(own) if len(own) == 1 else spelling[plain(n if own else common)])
    return out


def fused_table(files: DataFrame, tagged: DataFrame, moved: DataFrame, export_table: str, known: dict[str, str]) -> DataFrame:
    """All records of one export table as one table: ``file_id, line_no, record_no`` and a struct per canonical field.

    Each struct has the alternative that occurred (``tag``), its typed branches (``as_integer``, ``as_decimal``,
    ``as_boolean``, ``as_text``, ``as_nested``), the canonical text and ``others``: where several columns of one record
    are the same field, name and text of all but the first by name, the field's own name before all. ``known`` gives the
    expected columns; fields beyond them follow in order of name. Fields that are called as the record's own columns end in ``_value``. Records whose values are all missing are kept. Only field names come to the driver.
    """
    own = files.where(F.col("export_table") == export_table).select("file_id", F.coalesce("producer", F.lit("")).alias("producer"))
    mine = tagged.join(own, "file_id")
    names = [tuple(r) for r in mine.where("name is not null").groupBy("producer", "name").agg(F.count_distinct("file_id").alias("n")).limit(MAX_FIELDS + 1).collect()]
    links = [tuple(r) for r in moved.join(own, "file_id").select("producer", "old_name", "new_name").distinct().limit(MAX_FIELDS + 1).collect()]
    to = {k: f"{c}_value" if c.lower() in ("file_id", "line_no", "record_no") else c for k, c in canonical_names(names, links, list(known)).items()}
    fields = [*known, *sorted(set(to.values()) - set(known))]
    table = mine.sparkSession.createDataFrame([(p, n, c) for (p, n), c in to.items()] or [("", "", "")], "producer string, name string, field string")
    x = mine.join(F.broadcast(table), ["producer", "name"], "left")  # at most MAX_FIELDS names
    v, tag = F.col("value"), F.col("tag")
    branch = F.struct(
        (F.col("name") != F.col("field")).alias("other"), "name", tag.alias("tag"),
        F.when(tag == "integer", v.try_cast("long")).alias("as_integer"), F.when(tag.isin("integer", "decimal"), v.try_cast("double")).alias("as_decimal"),
        F.when(tag == "boolean", F.lower(v) == "true").alias("as_boolean"), F.when(tag == "text", v).alias("as_text"), F.when(tag.isin("array", "object"), v).alias("as_nested"),
        F.when(tag == "boolean", F.lower(v)).otherwise(v).alias("canonical"),
    )
    wide = x.withColumn("b", F.when(tag.isNotNull(), branch)).groupBy("file_id", "line_no", "record_no").pivot("field", fields).agg(F.array_sort(F.collect_list("b")))
    parts = ("tag", "as_integer", "as_decimal", "as_boolean", "as_text", "as_nested", "canonical")

    def first(field: str) -> Column:
        values = F.col("`" + field.replace("`", "``") + "`")
        b = F.get(values, F.lit(0))
        others = F.transform(F.slice(values, 2, MAX_FIELDS), lambda o: F.struct(o["name"].alias("name"), o["canonical"].alias("canonical")))
        return F.when(b.isNotNull(), F.struct(*[b[p].alias(p) for p in parts], others.alias("others"))).alias(field)

    return wide.select("file_id", "line_no", "record_no", *[first(f) for f in fields])

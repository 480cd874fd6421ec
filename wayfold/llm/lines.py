"""Removal of boilerplate lines by a log-template tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, may_have, meet, parallelism

#: Words that hold a digit are variable fields: numbers, dates, times, addresses, versions, ids.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
FIELD = "<*>"
#: Lines that do not meet by chance: from so many words on, so many different texts suffice.
LONG_WORDS = ((10, 4), (20, 2))
#: A line's words after the two leading ones are compared in so many fields at most (a power of two), of equal numbers of words (give or take one).
FIELDS = 16
#: A field varies among lines that share so many fixed fields, leading words included, beside it.
LEAST_SHARED = 2


def _template(line: Column) -> Column:
    """A line's words with single spaces between them, those with digits as variable fields; most lines need no pattern."""
    uneven = line.contains("\t") | line.contains("\r") | line.contains("  ")
    even = F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(even, VARIABLE, FIELD)).otherwise(even)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _keys(text: Column, doc_id: Column) -> list[Column]:
    """A row's id and two hashes of its text."""
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.xxhash64(F.lit(1), text).alias("content_2")]


def _variable(words: Column) -> Column:
    """Whether these words are variable fields alone."""
    return F.replace(F.replace(words, F.lit(FIELD), F.lit("")), F.lit(" "), F.lit("")) == ""


def line_templates(docs: DataFrame) -> DataFrame:
    """(doc_id, content, content_2, line_no, n_chars, n_words, fixed, path, fields array<long>, half, leaf) of every line with a word.

    path is the hash of the line's place in the tree: number of words and two leading words. fields holds a hash of each
    field of the other words and its place, 0 for those of variable words alone. A line's template in its leaf group is
    their exclusive or, leaf, so a field is made variable by leaving it out; half is that of the first half of them.
    fixed is the number of fields, leading words included, that are not variable.
    """
    own = docs.select(*_keys(_text(docs), docs["doc_id"]), _text(docs).alias("text"))
    lines = own.select("doc_id", "content", "content_2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Asked of the line, so that templates are made once.
    lines = lines.where(F.trim(F.col("line"), F.lit(" \t\r")) != "")
    lines = lines.select("doc_id", "content", "content_2", "line_no", F.char_length("line").alias("n_chars"), _template(F.col("line")).alias("template"))
    n = F.octet_length("template") - F.octet_length(F.replace(F.col("template"), F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n_words", n).withColumn("lead", F.substring_index("template", " ", 2)).withColumn("w", F.split("template", " "))
    # Most lines hold no variable word: then nothing is looked for in their fields.
    plain = ~F.col("template").contains(FIELD)
    edge = lambda i: F.shiftright(i * (F.col("n_words") - 2), FIELDS.bit_length() - 1)
    stretch = lambda i: F.slice("w", edge(i) + 3, edge(i + 1) - edge(i))
    blank = lambda words: ~F.col("plain") & _variable(words)
    none = F.lit(0).cast("long")
    word = F.transform(F.slice("w", 3, FIELDS), lambda x, i: F.when(blank(x), none).otherwise(F.xxhash64(x, i)))
    words = F.transform(F.sequence(F.lit(0), F.lit(FIELDS - 1)), lambda i: F.when(blank(F.array_join(stretch(i), " ")), none).otherwise(F.xxhash64(stretch(i), i)))
    each = F.when(F.col("n_words") <= 2, F.array().cast("array<bigint>")).when(F.col("n_words") <= FIELDS + 2, word).otherwise(words)
    lines = lines.withColumn("plain", plain).withColumn("fields", each)
    first = F.shiftright(F.size("fields") + 1, 1)
    leading = F.size(F.filter(F.split("lead", " "), lambda x: ~_variable(x)))
    fixed = F.when(F.col("plain"), F.least("n_words", F.lit(2)) + F.size("fields")).otherwise(leading + F.size(F.filter("fields", lambda x: x != 0)))
    lines = lines.select(
        "doc_id", "content", "content_2", "line_no", "n_chars", "n_words", fixed.alias("fixed"), F.xxhash64("n_words", "lead").alias("path"), "fields",
        _xor(F.slice("fields", F.lit(1), first)).alias("half"), _xor(F.slice("fields", first + 1, F.lit(FIELDS))).alias("other"),
    )
    return lines.withColumn("leaf", F.col("half").bitwiseXOR(F.col("other"))).drop("other")


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _met(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with found, which holds each key once and n, the number of rows that have it.

    Keys of more rows than a task's fair share are broadcast, and their rows stay where they are; these keys are fewer than
    there are shuffle partitions, since their rows are. The others meet in a join by key, where none is hot, and of rows
    only those that may have a key of found are moved.
    """
    parts = parallelism(found.sparkSession)
    fair = (found.agg(F.sum("n")).first()[0] or 0) / parts
    hot, rest = found.where(F.col("n") > fair).drop("n"), found.where(F.col("n") <= fair).drop("n")
    cold = meet(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti"), rest, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def variable_fields(lines: DataFrame, least_values: int) -> DataFrame:
    """(path, leaf, merged, n): templates (leaf, in the leaf group of path) with their variable fields left out, n lines each.

    A field is variable if `least_values` templates of its leaf group differ from each other in this field alone. Such
    templates share one whole half of their fields, so only those of a half that as many share are looked at field by field:
    two keys a line decide. Distinct pairs and counts are pre-aggregated, so that neither a frequent line nor a field of
    many values is one group.
    """
    other = F.col("half").bitwiseXOR(F.col("leaf"))
    wide = lines.where((F.col("fixed") > LEAST_SHARED) & (F.size("fields") > 0))
    sides = wide.select("path", "leaf", F.posexplode(F.array(F.xxhash64("path", F.lit(0), "half"), F.xxhash64("path", F.lit(1), other))).alias("part", "side"))
    sides = cut(sides.groupBy("side", "part", "path", "leaf").agg(F.count("*").alias("rows")), "sides")
    shared = cut(sides.groupBy("side").agg(F.count("*").alias("n")).where(F.col("n") >= least_values), "halves")
    asked = cut(_met(sides, shared, ["side"]).groupBy("path", "leaf").agg(F.max("rows").alias("n"), F.max(F.col("part") == 0).alias("front"), F.max(F.col("part") == 1).alias("back")), "asked")
    # Each template once, however many lines have it; of a template whose one half is shared the fields of the other one.
    once = _met(wide.select("path", "leaf", "fields"), asked, ["path", "leaf"]).select("path", "leaf", "fields", "front", "back").distinct()
    first = F.shiftright(F.size("fields") + 1, 1)
    looked_at = lambda x: (x["field"] != 0) & F.when(x["place"] < first, F.col("back")).otherwise(F.col("front"))
    places = F.filter(F.transform("fields", lambda x, i: F.struct(i.alias("place"), x.alias("field"))), looked_at)
    # A form is a leaf without one of its fields; with path and place in it, it is the same for templates of one leaf group alone.
    form = F.col("path").bitwiseXOR(F.col("leaf")).bitwiseXOR(F.col("field")).bitwiseXOR(F.xxhash64("place"))
    forms = cut(once.select("path", "leaf", F.inline(places)).select("path", "leaf", "field", form.alias("form")), "forms")
    many = cut(forms.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= least_values), "many")
    left = _met(forms, many, ["form"]).groupBy("path", "leaf").agg(F.bit_xor("field").alias("left"))
    return left.join(asked.select("path", "leaf", "n"), ["path", "leaf"]).select("path", "leaf", F.col("leaf").bitwiseXOR(F.col("left")).alias("merged"), "n")


def recurring_lines(docs: DataFrame, *, least_texts: int = 8, least_values: int = 8, long_words: tuple[tuple[int, int], ...] = LONG_WORDS) -> DataFrame:
    """(doc_id, content, content_2, line_no, n_chars) of the lines to drop; content and content_2 are hashes of the text.

    A template recurs when it stands in `least_texts` different texts at least, or in fewer where it is long: (words, texts)
    of `long_words` are the least words of a template and the texts that suffice then. Exact copies of a document count once, so
    that copies alone make no boilerplate. Its first place stays: the least (doc_id, line_no). Only hashes of the tree's
    paths and templates are grouped and joined; the minimum and the count of texts are pre-aggregated, and the lines of a
    template that a third of all lines have stay where they are.
    """
    need = F.lit(least_texts)
    for words, texts in long_words:
        need = F.when(F.col("n_words") >= words, F.least(need, F.lit(texts))).otherwise(need)
    parsed = cut(line_templates(docs), "lines")
    fields = cut(variable_fields(parsed, least_values), "fields")
    own = ["doc_id", "content", "content_2", "line_no", "n_chars", "n_words", "path"]
    lines = parsed.select(*own, "leaf")
    if not fields.isEmpty():
        lines = _met(lines, fields, ["path", "leaf"], "left").select(*own, F.coalesce("merged", "leaf").alias("leaf"))
    by_text = lines.groupBy("path", "leaf", "content", "content_2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first(need).alias("need"), F.count("*").alias("n"))
    nodes = by_text.groupBy("path", "leaf").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.first("need").alias("need"), F.sum("n").alias("n")).where("texts >= need")
    dropped = _met(lines, cut(nodes.select("path", "leaf", "first", "n"), "nodes"), ["path", "leaf"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return dropped.select("doc_id", "content", "content_2", "line_no", "n_chars")


def drop_recurring_lines(docs: DataFrame, *, least_texts: int = 8, least_values: int = 8, long_words: tuple[tuple[int, int], ...] = LONG_WORDS) -> DataFrame:
    """docs with text_kept, n_lines, n_dropped and dropped_chars.

    Fixed-depth tree: number of words, two leading words, then the line's template in the leaf, where words with digits
    are variable fields, and so are fields in which `least_values` templates of the leaf differ alone, where two fixed ones are
    left beside it. A field is a word in lines of up to FIELDS + 2 words, a stretch of words in longer ones: there are FIELDS
    of them at most. Lines of recurring templates go from every document but the first (see `recurring_lines`).
    Blank lines have no template and stay. Null texts count as empty (text_kept is empty); null ids and repeated rows are
    kept, rows with one doc_id each by its own text; an empty table stays empty; other columns pass through under any
    name, but for own columns with the names of the four results, which are replaced.
    """
    gone = recurring_lines(docs, least_texts=least_texts, least_values=least_values, long_words=long_words)
    per_doc = gone.distinct().groupBy("doc_id", "content", "content_2").agg(F.sort_array(F.collect_set("line_no")).alias("gone"), F.sum("n_chars").alias("gone_chars"))
    per_doc = cut(per_doc, "dropped").select(F.struct("doc_id", "content", "content_2").alias("of"), F.struct("gone", "gone_chars").alias("found"))
    results = ("text_kept", "n_lines", "n_dropped", "dropped_chars")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns if c not in results)).alias("row"), _text(docs).alias("text"), F.struct(*_keys(_text(docs), docs["doc_id"])).alias("key"))
    same = F.col("key.doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("key.content") == F.col("of.content")) & (F.col("key.content_2") == F.col("of.content_2"))
    lines = F.split("text", "\n")
    # What lies between the lines to drop, so that each line is looked at once.
    edge = F.concat(F.array(F.lit(-1)), F.col("found.gone"), F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size("found.gone") + 1), lambda k: F.slice(F.col("lines"), F.get(F.col("edge"), k - 1) + 2, F.get(F.col("edge"), k) - F.get(F.col("edge"), k - 1) - 1))
    # Only texts that lose lines meet these; the others stay where they are.
    key = lambda of: F.xxhash64(*(F.col(f"{of}.{c}") for c in ("doc_id", "content", "content_2")))
    own = may_have(own, per_doc, key("key"), key("of"))
    lost = own.where("maybe").join(per_doc.hint("shuffle_hash"), same, "left").select("row", "text", "found")
    joined = lost.unionByName(own.where("not maybe").select("row", "text"), allowMissingColumns=True)
    joined = joined.select("row", "text", "found", F.when(F.col("found").isNotNull(), lines).alias("lines"), F.when(F.col("found").isNotNull(), edge).alias("edge"))
    return joined.select(
        "row.*",
        F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n")).alias("text_kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("found.gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("found.gone_chars", F.lit(0)).cast("long").alias("dropped_chars"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", "dropped_chars", F.sha2("text_kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from d),
m as (select doc_id, text, line_no, line, trim(regexp_replace(regexp_replace(line, '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), '[ \t\r]+', ' ', 'g')) as masked from l),
u as (select masked, string_split(masked, ' ') as w from (select distinct masked from m where masked <> '')),
c as (select *, len(w) - 2 as rest, least(len(w) - 2, 16) as parts from u),
x as (select masked, w, list_transform(range(0, parts), lambda i: array_to_string(w[3 + (i * rest) // parts:2 + ((i + 1) * rest) // parts], ' ')) as chunks from c),
y as (select masked, w, len(w) || ' ' || w[1] || ' ' || coalesce(w[2], '') as path, list_transform(chunks, lambda s: case when replace(replace(s, '<*>', ''), ' ', '') = '' then '<*>' else s end) as f from x),
z as (select *, path || chr(9) || array_to_string(f, chr(9)) as whole, len(list_filter(f, lambda s: s <> '<*>')) + len(list_filter(w[1:2], lambda s: replace(s, '<*>', '') <> '')) as fixed from y),
p as (select distinct whole, path, f, unnest(range(1, len(f) + 1)) as k from z where fixed >= 3),
e as (select whole, k, path || chr(9) || k || chr(9) || array_to_string(list_concat(f[1:k - 1], ['<*>'], f[k + 1:]), chr(9)) as form from p where f[k] <> '<*>'),
v as (select whole, list(k) as ks from e join (select form from e group by form having count(distinct whole) >= 8) using (form) group by whole),
g as (select z.masked, len(w) as n_words, case when ks is null then z.whole else path || chr(9) || array_to_string(list_transform(range(1, len(f) + 1), lambda k: case when list_contains(ks, k) then '<*>' else f[k] end), chr(9)) end as template from z left join v on z.whole = v.whole),
t as (select m.*, coalesce(g.template, '') as template, n_words from m left join g on m.masked = g.masked),
n as (select template, count(distinct text) as texts, min(struct_pack(a := doc_id, b := line_no)) as first from t where template <> '' group by template having count(distinct text) >= case when min(n_words) >= 20 then 2 when min(n_words) >= 10 then 4 else 8 end),
r as (select t.*, n.template is not null and struct_pack(a := doc_id, b := line_no) <> n.first as gone from t left join n on t.template = n.template and t.template <> '')
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, cast(coalesce(sum(length(line)) filter (gone), 0) as bigint) as dropped_chars,
       sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '')) as kept_sha256
from r group by doc_id
"""

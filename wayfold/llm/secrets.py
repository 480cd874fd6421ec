"""Secret scanning with an incremental ledger of content-addressed blobs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut

#: Fixed values of the contract: kind, pattern, group that must reach the least length, least length.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A cheap test that holds wherever the rule can find something.
SCREENS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA", "hex": r"[0-9a-f]{16}"}
RULE_VERSION = "base-1"
#: Where a whole maximal run is one match, runs under the least length can be passed over by the pattern itself.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Matches whose lengths are summed one by one; longer lists are summed by runs.
RUN = 64
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches with code-point places.

    Split and extraction see the same matches, so the pieces between them and the matches, laid one after another, give
    every start. Lengths are summed in runs of RUN matches, so no list is copied for each match of a text with many.
    """
    pattern = _LONG.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    tail = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(whole.alias("whole"), tail.alias("tail"), F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"))
    length = lambda x: F.char_length(x).cast("bigint")
    rows = F.transform(zipped, lambda r: F.struct((length(r["gap"]) + length(r["whole"])).alias("step"), length(r["whole"]).alias("length"), (length(r["tail"]) >= least).alias("kept")))

    def spans(rows: Column) -> Column:
        run = lambda k: F.slice(rows, k * RUN + 1, F.lit(RUN))
        total = lambda own: F.aggregate(own, F.lit(0).cast("bigint"), lambda n, r: n + r["step"])
        grow = lambda acc, at, new: F.struct(at.alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))
        none = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        last = F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / RUN).cast("int")
        begins = F.aggregate(F.sequence(F.lit(0), last), none(F.lit(0).cast("bigint"), "array<struct<k:int,at:bigint>>"), lambda acc, k: grow(acc, acc["at"] + total(run(k)), F.struct(k.alias("k"), acc["at"].alias("at"))))["out"]

        def step(acc: Column, row: Column) -> Column:
            stop = acc["at"] + row["step"]
            return grow(acc, stop, F.struct((stop - row["length"]).alias("start"), stop.alias("stop"), row["kept"].alias("kept")))

        return F.flatten(F.transform(begins, lambda b: F.aggregate(run(b["k"]), none(b["at"], "array<struct<start:bigint,stop:bigint,kept:boolean>>"), step)["out"]))

    # As the only element of an array, the rows are made once and not for each run of them.
    placed = F.flatten(F.transform(F.array(rows), spans))
    found = F.transform(F.filter(placed, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))).cast(SPAN)
    return F.when(text.rlike(SCREENS[kind]), found).otherwise(F.array().cast(SPAN))


def versions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, text): each row is one historical version at a path; blob is the address of its content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, *, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger entries (blob, rule_version, spans) for blobs that this rule version has not seen.

    One text of each blob is scanned: of all rows with one address the least doc_id stands for it, which is found on
    addresses alone (pre-aggregated before the shuffle), so a blob with a third of all rows costs one scan. The join on
    (address, id) that leaves the others out moves every row's text once; no group of texts is kept.
    """
    reps = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"))
    if ledger is not None:
        reps = reps.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    own = paths.withColumn("rep", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # Two equal rows of one id would be scanned twice; the ledger takes each blob once.
    texts = own.join(reps.hint("shuffle_hash"), ["blob", "rep"], "left_semi").select("blob", "text")
    found = [spans_of(F.col("text"), *rule, rank) for rank, rule in enumerate(RULES)]
    scanned = texts.select("blob", F.array_sort(F.concat(*found)).alias("spans"))
    return scanned.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(paths: DataFrame, ledger: DataFrame, *, rule_version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans): the ledger's findings at every path that holds the blob, none as an empty list."""
    own = ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.select("doc_id", "blob").join(own, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, *, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings at every path, ledger with the new entries).

    A null text is empty and has no findings; null ids stay; repeated rows keep their rows; empty tables give empty
    results; other columns are ignored. Nothing is scanned that the given ledger holds for this rule version.
    """
    paths = versions(docs)
    new = cut(scan_unseen(paths, ledger, rule_version=rule_version), "ledger")
    whole = new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)
    return findings(paths, whole, rule_version=rule_version), whole


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = _digest("spans")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op10_conversation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, rule_version, spans, n_new): a conversation's turns as versions that come in one after another.

    First every conversation's first turn is scanned; then all turns against that ledger, so only unseen blobs are; then
    all of them by a new rule version. Turns of no conversation are those of one; a turn without a number is never a first one. spans are the findings at each path by each version, n_new the blobs its last scan took.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("first")).select(F.col("conv_id").alias("of"), "first")
    is_first = F.coalesce(F.col("turn") == F.col("first"), F.lit(False)).alias("is_first")
    paths = cut(turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).select(F.struct("conv_id", "turn").alias("path"), is_first, "text"), "turns")
    number = F.xxhash64("path.conv_id", "path.turn")
    rows = paths.select(number.alias("doc_id"), "text", "path", "is_first")
    _, ledger = scan_secrets(rows.where("is_first"))
    _, grown = scan_secrets(rows, ledger)
    n_old = grown.join(ledger.select("blob"), "blob", "left_anti").count()
    n_new = versions(rows).select("blob").distinct().count()
    _, both = scan_secrets(rows, grown, rule_version="base-2")
    own = paths.select("path.conv_id", "path.turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    marked = lambda v, n: own.join(both.where(F.col("rule_version") == v).groupBy("blob").agg(F.first("spans").alias("s")), "blob").select("conv_id", "turn", F.lit(v).alias("rule_version"), _digest("s").alias("spans"), F.lit(n).cast("long").alias("n_new"))
    return marked(RULE_VERSION, n_old).unionByName(marked("base-2", n_new))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _one(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
select doc_id, start, {rank} as rank, '{kind}' as kind, stop, tail from (
  select doc_id, unnest(ends) - length(unnest(ms)) as start, unnest(ends) as stop, unnest(tails) as tail from (
    select doc_id, ms, tails, list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ms[1:i] || ps[1:i], lambda s: length(s)))) as ends
    from (select doc_id, regexp_extract_all(text, '{p}', 0) as ms, regexp_extract_all(text, '{p}', {group}) as tails, regexp_split_to_array(text, '{p}') as ps
          from d where regexp_matches(text, '{SCREENS[kind]}'))
  ))
where length(tail) >= {least}"""


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as ({' union all '.join(_one(k, _LONG.get(k, p), g, n, i) for i, (k, p, g, n) in enumerate(RULES))}),
s as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) as spans from m group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s on s.doc_id = d.doc_id
"""

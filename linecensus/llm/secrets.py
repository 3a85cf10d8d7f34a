"""Secret scan with corpus-wide ownership frequency.

Main path: DataFrame functions only. Spans come from the pieces between matches: a split
by the pattern gives the texts between, the extraction gives the matches, and running
lengths give code point offsets. Candidates (values of the base spans, and long mixed
generic strings outside them) are aggregated by their hash to distinct owners and distinct
repositories, first over (hash, owner, repository), then (hash, owner), then hash, so that
a value copied into a third of all rows is pre-aggregated before it meets. A value that
many owners hold, or that reads as a placeholder, is an example; one that stays with its
owner looks live. Generic strings become spans only where they look live.

Defined results: a null or empty text has no spans (base_sha256 is that of the empty
string, spans is ""); null owners or repositories count as one owner, one repository;
repeated rows each give a row. Texts of any length are scanned whole; spans of one start
come in the order of their kinds. The tables here have no repository: `lang` stands in for
it, and `source` for the owner. Nothing but id, text, owner and repository columns is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

# The base patterns and least lengths of the contract, in its order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: The method's own candidates.
GENERIC = ("generic", r"[A-Za-z0-9_+/-]{28,}={0,2}", 0, 28)
RANKS = {"assign": 0, "access": 1, "hex": 2, "generic": 3}
OWNERS, REPOS = 3, 6  # held by so many: an example
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|(.)\1{5}|012345|abcdef"
MARK = "[SECRET]"

SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches whose group has `least` characters."""
    none = F.array().cast(f"array<{SPAN}>")
    # Runs of one class: {n,} finds the same runs as + and a test of the length, with far fewer matches.
    tight = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(tight), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(tight), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, tight, -1), 1, F.size(whole)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(RANKS[kind]).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(tight), F.aggregate(zipped, start, step)["out"]).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "lang", mark: bool = False) -> DataFrame:
    """Per row: doc_id, base and generic candidate spans, and whom the row belongs to; saved. mark: adds xxhash64 of the text."""
    text = text_of(text_col)
    cols = [F.col(id_col).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo")]
    cols += [F.xxhash64(F.col(text_col)).alias("mark")] if mark else []
    found = docs.select(*cols, *[_spans(text, *b).alias(b[0]) for b in BASE], _spans(text, *GENERIC).alias("generic"))
    mixed = F.filter("generic", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & s["value"].rlike("[G-Zg-z]"))
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    apart = F.filter(mixed, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    found = found.withColumn("generic", apart).withColumn("row", F.monotonically_increasing_id())
    kept = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return save(found.select("row", "doc_id", "owner", "repo", *(["mark"] if mark else []), *kept, "base", "generic"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """digest of a candidate's value -> n_owners, n_repos, live."""
    values = found.select("owner", "repo", F.explode(F.concat("base", "generic")).alias("s")).select("owner", "repo", F.sha2(F.col("s.value"), 256).alias("digest"), F.col("s.value").rlike(PLACEHOLDER).cast("int").alias("fake"))
    by_repo = values.groupBy("digest", "owner", "repo").agg(F.max("fake").alias("fake"), F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.max("fake").alias("fake"), F.sum("n").alias("n"))
    by_value = by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("fake").alias("fake"), F.sum("n").alias("n_places"))
    return by_value.withColumn("live", (F.col("fake") == 0) & (F.col("n_owners") < OWNERS) & (F.col("n_repos") < REPOS))


def verdicts(found: DataFrame) -> DataFrame:
    """Per row that has candidates: its spans with their verdicts (array of struct span, live), in span order."""
    spans = found.select("row", F.explode(F.concat("base", "generic")).alias("span")).withColumn("digest", F.sha2(F.col("span.value"), 256))
    judged = spans.join(ownership(found).select("digest", "live"), "digest")
    return judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("span", "live"))).alias("judged"))


def secret_rows(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    found = scan(docs, **names)
    out = found.join(verdicts(found), "row", "left")
    judged = F.coalesce("judged", F.array().cast(f"array<struct<span:{SPAN},live:boolean>>"))
    shown = F.filter(judged, lambda x: (x["span"]["rank"] < 3) | x["live"])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.transform(shown, lambda x: x["span"])).alias("spans"),
        F.size(F.filter(judged, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter(judged, lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "lang") -> DataFrame:
    """docs with each live-looking secret replaced by MARK; examples and everything else stay. n_chars, if there, follows the text."""
    own = {k: f"{k}__of_cut" for k in ("id", "mark", "cuts", "text")}  # apart from any column of docs
    found = scan(docs, id_col, text_col, owner, repo, mark=True)
    live = F.filter("judged", lambda x: x["live"])
    runs = "array<struct<start:int,stop:int>>"

    def merge(acc: Column, x: Column) -> Column:
        s, last = x["span"], F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        fresh = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
        return F.when((F.size(acc) > 0) & (s["start"] < last["stop"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(fresh)

    cuts = verdicts(found).withColumn("cuts", F.reverse(F.aggregate(live, F.array().cast(runs), merge))).filter(F.size("cuts") > 0)
    cuts = found.select("row", "doc_id", "mark").join(cuts, "row").groupBy(F.col("doc_id").alias(own["id"]), F.col("mark").alias(own["mark"])).agg(F.first("cuts").alias(own["cuts"]))

    def cut(text: Column, s: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), s["start"]), F.lit(MARK), F.substring(text, s["stop"] + 1, F.length(text)))

    clean = F.when(F.col(own["cuts"]).isNull(), docs[text_col]).otherwise(F.aggregate(own["cuts"], docs[text_col], cut))
    out = docs.join(cuts, docs[id_col].eqNullSafe(cuts[own["id"]]) & (F.xxhash64(docs[text_col]) == cuts[own["mark"]]), "left").withColumn(own["text"], clean)
    return out.select(*[F.col(own["text"]).alias(c) if c == text_col else F.when(docs[c].isNotNull(), F.length(own["text"]).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])

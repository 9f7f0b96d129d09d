"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

All work on executors is DataFrame and SQL functions. Offsets come from splitting a text at a pattern: the lengths of the
pieces and matches before a match sum to its start (code points), in time linear in the text.

Sanitisation: a term's disclosure of a protected entity is the share of the entity's information that the term gives away,
    log2(n_et * N / (n_t * n_e)) / log2(N / n_e)      over documents of the whole corpus,
where n_et counts documents with the entity and the term, wherever it stands, n_t those with the term, n_e those
with the entity. From GENERALISE on a term is replaced by its class, from REMOVE on it is removed, in the documents that
hold that entity. Only entities with SUPPORT distinct contexts (WINDOW characters on both sides, up to the next finding of the kind) can be judged, and
only terms that stand in documents with SUPPORT distinct contexts of the entity, so mere copies of one text reveal nothing. All four counts are of rows.

Defined results: null text counts as empty; empty texts have no spans; rows with a null id get their row and take part;
repeated rows each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no text makes them recurse or scan a run again: possessive, and tried only where a run or the rest after a match begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WINDOW, SUPPORT, GENERALISE, REMOVE = 120, 2, 0.8, 0.95
#: Most rows of a join side that are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_SPAN = "array<struct<start:int,end:int,value:string,c:bigint>>"
#: Matches whose places are summed together; the sums of blocks are added up, so that no array is built anew for every match.
STEP = 64


def _items(pieces: Column, matches: Column) -> Column:
    """Of each match: the characters between it and the one before, the match, and a hash of its context (WINDOW characters of the pieces on both sides)."""
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    after = F.zip_with(both, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, n: F.struct(
        F.length(x["p"]).alias("gap"), x["m"].alias("value"), F.xxhash64(F.right(x["p"], F.lit(WINDOW)), F.lit("\n"), F.left(n, F.lit(WINDOW))).alias("c")
    ))
    return F.filter(after, lambda x: x["value"].isNotNull())


def _placed(items: str) -> Column:
    """(start, end, value, c) of the matches in column `items`, by running sums in blocks of STEP. It must be a column: expressions in a lambda are computed again for every element."""
    one = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["c"].alias("c")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda k: F.aggregate(F.slice(items, k * STEP + 1, F.lit(STEP)), zero, one))
    shift = lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"),
        F.concat(acc["out"], F.array(F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"].alias("value"), x["c"].alias("c"))))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, start, shift, lambda acc: acc["out"]))).otherwise(F.array().cast(_SPAN))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _card_ok(x: Column) -> Column:
    return F.length(_digits(x["value"])).between(12, 19) & F.call_function("luhn_check", _digits(x["value"]))


def _ip_ok(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x["value"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _named(k: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["c"].alias("c"))


def base(own: DataFrame) -> DataFrame:
    """own(doc_id, text) with column spans: start, end, k (place in KINDS), kind, value, c (a hash of the context); in order of start, then kind."""
    none = F.array().cast("array<string>")
    cut_ = lambda p, when: _items(F.when(when, F.split("text", p, -1)).otherwise(none), F.when(when, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none))
    digit = F.col("text").rlike("[0-9]")
    cols = {"email": cut_(EMAIL, F.contains("text", F.lit("@"))), "ip": cut_(IP, digit), "card": cut_(CARD, digit), "phone": cut_(PHONE, F.contains("text", F.lit("+")))}
    df = own.withColumns({f"_i_{k}": c for k, c in cols.items()}).withColumns({f"_s_{k}": _placed(f"_i_{k}") for k in KINDS})
    found = {
        "email": F.col("_s_email"),
        "ip": F.filter("_s_ip", _ip_ok),
        "card": F.filter("_s_card", _card_ok),
        "phone": F.filter("_s_phone", lambda x: F.length(_digits(x["value"])).between(9, 15)),
    }
    named = [F.transform(found[kind], _named(k, kind)) for k, kind in enumerate(KINDS)]
    return df.select(*own.columns, F.array_sort(F.concat(*named)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _letters(text: Column) -> Column:
    """Distinct lower-case words of letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 2))


def disclosures(own: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, version, terms): the revealing terms of each document, with their disclosure. found: a table of doc_id, version, spans, words (of texts with spans)."""
    spark = own.sparkSession
    empty = spark.createDataFrame([], "doc_id long, version long, terms array<struct<term:string,share:double>>")
    mention = F.explode(F.transform("spans", lambda s: F.struct(F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"), s["c"].alias("c"))))
    mentions = found.where(F.size("spans") > 0).select("doc_id", "version", mention.alias("m")).select("doc_id", "version", "m.*")
    entities = cut(mentions.groupBy("entity").agg(F.count_distinct("c").alias("contexts")).where(F.col("contexts") >= SUPPORT).select("entity"), "entities")
    if entities.isEmpty():
        return empty
    total = own.count()
    # each row of found once for each of its entities, with the least context of the entity there
    rows = found.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "version", "words", "row", mention.alias("m")).select("doc_id", "version", "words", "row", "m.*")
    holders = rows.join(sized(entities, BROADCAST_ROWS), "entity").groupBy("row", "entity").agg(F.min("c").alias("c"), *(F.first(x).alias(x) for x in ("doc_id", "version", "words")))
    holders = cut(holders, "holders")
    terms = holders.select("entity", "c", F.explode("words").alias("term"))
    pairs = terms.groupBy("entity", "term", "c").agg(F.count("*").alias("x")).groupBy("entity", "term").agg(F.sum("x").alias("n_et"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    n_e = cut(holders.groupBy("entity").agg(F.count("*").alias("n_e")), "holder-counts")
    pairs = cut(pairs.join(sized(n_e, BROADCAST_ROWS), "entity"), "pairs")
    candidates = cut(pairs.select("term").distinct(), "terms")
    if candidates.isEmpty():
        return empty
    word = own.select(F.explode(_letters(F.col("text"))).alias("term"))
    few = candidates.count() <= BROADCAST_ROWS
    counts = word.join(F.broadcast(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")) if few else word.groupBy("term").agg(F.count("*").alias("n_t")).join(candidates, "term", "left_semi")
    information = F.log2(F.lit(float(total)) / F.col("n_e"))
    share = F.when(information > 0, F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e"))) / information).otherwise(0.0)
    flagged = cut(pairs.join(counts, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE), "flagged")
    shown = holders.select("doc_id", "version", "entity", F.explode("words").alias("term")).join(sized(flagged, BROADCAST_ROWS), ["entity", "term"])
    return shown.groupBy("doc_id", "version", "term").agg(F.max("share").alias("share")).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, spans, extra): base spans, and spans of revealing terms (kind `term` generalised, `removed` removed), for each row of docs. version is a hash of the text."""
    own = texts(docs).withColumn("version", F.xxhash64("text"))
    found = cut(base(own).select("doc_id", "version", "spans", F.when(F.size("spans") > 0, _letters(F.col("text"))).alias("words")), "spans")
    terms = cut(disclosures(own, found), "disclosures")
    if terms.isEmpty():
        return found.select("doc_id", "version", "spans", F.array().cast(found.schema["spans"].dataType).alias("extra"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    key = [F.col("o.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("o.version") == F.col("t.version")]
    hit = own.alias("o").join(sized(terms, BROADCAST_ROWS).alias("t"), key).select("o.doc_id", "o.version", "o.text", "t.terms").distinct().withColumn("_r", pattern)
    hit = hit.withColumn("_i", _items(F.split("text", F.col("_r"), -1), F.regexp_extract_all("text", F.col("_r"), F.lit(0)))).withColumn("_s", _placed("_i"))
    named = F.transform("_s", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), x["end"].alias("end"), F.when(F.exists("terms", lambda t: (t["term"] == F.lower(x["value"])) & (t["share"] >= REMOVE)), "removed").otherwise("term").alias("kind"), x["value"].alias("value"), x["c"].alias("c")))
    extra = hit.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), named.alias("extra"))
    both = found.join(extra, found.doc_id.eqNullSafe(F.col("_d")) & (found.version == F.col("_v")), "left")
    return both.select("doc_id", "version", "spans", F.coalesce("extra", F.array().cast(found.schema["spans"].dataType)).alias("extra"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    df = spans(docs)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("spans", "extra"))
    return df.select("doc_id", *map(n, KINDS), F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced: [EMAIL] and so on, [TERM] for a generalised term, nothing for a removed one. Overlapping spans are covered once."""
    found = spans(docs).where("size(spans) + size(extra) > 0").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.array_sort(F.concat("spans", "extra")).alias("s")).distinct()
    own = texts(docs).withColumn("version", F.xxhash64("text"))
    both = own.join(sized(cut(found, "replacements"), BROADCAST_ROWS), own.doc_id.eqNullSafe(F.col("_d")) & (own.version == F.col("_v")), "left")
    put = F.aggregate(
        "s", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return both.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(put).alias("text"))

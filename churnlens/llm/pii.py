"""Personal data by bootstrapped contextual extraction, in DataFrame operations.

Seeds are the base patterns (e-mail and IP addresses, card and phone numbers,
validated). The words around seeds are lexical patterns; other tokens with a
digit or an @ are candidate instances and have the same kinds of context. The
graph of patterns and instances is scored in rounds: a pattern's confidence
for a kind is the mean score of its distinct instances, an instance's score
combines the confident patterns it occurs in (seeds are 1). A pattern needs
``MIN_SEEDS`` distinct instances that are seeds or accepted by then, so accepted
candidates induce further patterns. Candidates whose score reaches ``ACCEPT``
are reported with the kind their patterns have. Context words are those around
a run of neighbouring matches (no letter or digit between them).

Matches carry no position in Spark SQL, so a text is parted by a pattern into
gaps and matches, and running lengths give the offsets. Only matches are
shuffled, never texts. The regular expressions are linear: possessive
repeats, and starts only where a run begins or a match has just ended.

Defined results: a null text counts as empty and has no span; rows with equal
id and text have equal results, one row each; rows with a null id are told
apart by their texts; other columns are ignored. Offsets count code points,
ends exclude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = 4
# The base patterns of the contract, written so that they match the same runs in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
DOMAIN = "[A-Za-z0-9-]++"
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}(?:\.{DOMAIN})++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    # a token with a digit or an @, begun at its first character
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
)
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CONTEXT = 80  # characters of a gap in which context words are looked for
MIN_SEEDS = 3  # distinct seeds or accepted instances that make a pattern
CONFIDENT = 0.6  # mean instance score of a pattern that spreads
ACCEPT = 0.8
ROUNDS = 3
MIN_SIGNS = 4  # digits of a candidate without an @


def _digits(column):
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    place = F.split(F.reverse(digits), "")
    double = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    values = F.transform(place, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind, text):
    """Whether a match of a base kind is one (candidates are)."""
    digits = _digits(text)
    n = F.char_length(digits)
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, text.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$"))
            .when(kind == 2, F.when(n.between(12, 19), luhn(digits)).otherwise(False))
            .when(kind == 3, n.between(9, 15)).otherwise(True))


PARTS = "array<struct<kind:int,i:int,gap:bigint,wordless:boolean,before:string,after:string,match:string>>"


def _parts(k: int):
    """Gap i stands before match i of pattern k; the gap after the last match closes the list."""
    return F.transform(F.col(f"g{k}"), lambda g, i: F.struct(
        F.lit(k).alias("kind"), i.alias("i"), F.char_length(g).cast("long").alias("gap"),
        (~g.rlike(r"[\p{L}\p{N}]")).alias("wordless"),
        F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(CONTEXT)).alias("after"),
        F.get(F.col(f"m{k}"), i).alias("match")))


def _matches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, match, before, after) of all matches of all patterns."""
    cheap = (F.contains("text", F.lit("@")), F.contains("text", F.lit(".")), None, F.contains("text", F.lit("+")), None)
    held = docs.where(F.col("text").rlike("[0-9@]"))
    for k, p in enumerate(PATTERNS):
        test = F.col("text").rlike(p) if cheap[k] is None else cheap[k] & F.col("text").rlike(p)
        held = held.withColumn(f"m{k}", F.when(test, F.regexp_extract_all("text", F.lit(p), F.lit(0))))
        held = held.withColumn(f"g{k}", F.when(F.col(f"m{k}").isNotNull(), F.split("text", p, -1)))
    rows = [F.coalesce(_parts(k), F.array().cast(PARTS)) for k in range(len(PATTERNS))]
    flat = held.select("doc_id", "h", F.explode(F.concat(*rows)).alias("p")).select("doc_id", "h", "p.*")
    flat = flat.dropDuplicates(["doc_id", "h", "kind", "i"])  # equal rows of the input
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("match").cast("long")
    flat = flat.withColumn("end", F.sum("gap").over(so_far) + F.sum(F.coalesce(length, F.lit(0))).over(so_far))
    # a run of neighbours has the text before its first and after its last match (read backwards, so frames only grow)
    flat = flat.withColumn("before", F.last(F.when((F.col("i") == 0) | ~F.col("wordless"), F.col("before")), True).over(so_far))
    later = Window.partitionBy("doc_id", "h", "kind").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("after", F.coalesce(F.last(F.when(~F.col("wordless"), F.col("after")), True).over(later), F.lit("")))
    flat = flat.where("match is not null")
    return flat.select("doc_id", "h", "kind", (F.col("end") - length).alias("start"), "end", "match", "before", "after")


def _word(text, at: int):
    """The at-th word from the end (negative) or start of a gap, lower case, without outer punctuation; '' if none."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    word = F.coalesce(F.get(words, F.size(words) + at) if at < 0 else F.get(words, F.lit(at)), F.lit(""))
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}:=]+$", "")


def _contexts(found: DataFrame) -> DataFrame:
    """One row per match and lexical pattern: two words before; one before and one after; two after."""
    b1, b2, a1, a2 = _word(F.col("before"), -1), _word(F.col("before"), -2), _word(F.col("after"), 0), _word(F.col("after"), 1)
    patterns = F.array(F.when((b1 != "") & (b2 != ""), F.concat_ws(" ", b2, b1, F.lit("_"))),
                       F.when((b1 != "") & (a1 != ""), F.concat_ws(" ", b1, F.lit("_"), a1)),
                       F.when((a1 != "") & (a2 != ""), F.concat_ws(" ", F.lit("_"), a1, a2)))
    return found.withColumn("pattern", F.explode(F.array_compact(patterns)))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT,
              accept: float = ACCEPT) -> DataFrame:
    """(instance, kind, score) of candidates the confident patterns discover.

    ``found`` has (kind, instance, pattern): kind null for candidates.
    """
    edges = stage(found.groupBy("pattern", "instance").agg(F.collect_set("kind").alias("kinds")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    sizes = stage(sizes.where(F.col("instances") >= min_seeds), "sizes")
    # a pattern with fewer distinct instances can never spread; any other may, once enough of them are accepted
    edges = stage(edges.join(sizes, "pattern", "left_semi").select("pattern", "instance", F.explode_outer("kinds").alias("kind")), "graph")
    scores = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = stage(scores, "scores")
    seeds = scores
    for _ in range(rounds):
        # the kind of an edge that a seed made is known; a candidate's is what its patterns said so far
        met = edges.where("kind is null").select("pattern", "instance").join(scores, "instance").select(
            "pattern", "kind", "score").unionByName(edges.where("kind is not null").select(
                "pattern", "kind", F.lit(1.0).alias("score")))
        mean = met.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= accept).alias("n"))
        mean = mean.where(F.col("n") >= min_seeds).join(sizes, "pattern")
        sure = mean.withColumn("confidence", F.col("s") / F.col("instances"))
        sure = stage(sure.where(F.col("confidence") >= confident).select("pattern", "kind", "confidence"), "patterns")
        gained = edges.where("kind is null").select("pattern", "instance").join(sure, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.95)))))).alias("score"))
        scores = stage(seeds.unionByName(gained).groupBy("instance", "kind").agg(F.max("score").alias("score")), "scores")
    best = scores.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    best = best.select("instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
    return stage(best.where(F.col("score") >= accept), "accepted")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans, n_discovered."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    found = stage(_matches(slim), "matches")
    base = stage(found.where(F.col("kind") != CANDIDATE).where(valid(F.col("kind"), F.col("match"))), "base")
    # candidates that no base span overlaps; outer punctuation is no part of an instance
    head = F.char_length(F.regexp_extract("match", r"^[^\p{L}\p{N}@+]*+", 0)).cast("long")
    core = F.regexp_replace("match", r"^[^\p{L}\p{N}@+]++|[^\p{L}\p{N}]++$", "")
    loose = found.where(F.col("kind") == CANDIDATE).withColumn("core", core).where(
        (F.char_length(_digits(F.col("core"))) >= MIN_SIGNS) | F.contains("core", F.lit("@")))
    loose = loose.withColumn("start", F.col("start") + head).withColumn("end", F.col("start") + F.char_length("core"))
    taken = base.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    loose = stage(loose.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
                             & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti"), "loose")
    contexts = _contexts(base.withColumn("instance", F.lower("match"))).select("pattern", "instance", "kind").unionByName(
        _contexts(loose.withColumn("instance", F.lower("core"))).select("pattern", "instance", F.lit(None).cast("int").alias("kind")))
    accepted = bootstrap(contexts, rounds)
    new = loose.withColumn("instance", F.lower("core")).drop("kind").join(accepted, "instance").select(
        "doc_id", "h", "kind", "start", "end", F.lit(False).alias("base"))
    spans = base.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base")).unionByName(new)
    spans = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("s"))
    spans = stage(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), "spans")
    rows = slim.select("doc_id", "h").join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    only = F.filter("s", lambda x: x["base"])
    render = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    count = lambda k: F.coalesce(F.size(F.filter(only, lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    held = F.col("s").isNotNull()
    return rows.select("doc_id", *[F.when(held, count(i)).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(render(only), 256).alias("base_sha256"), render(F.col("s")).alias("spans"),
                       F.when(held, F.size("s") - F.size(only)).otherwise(0).cast("long").alias("n_discovered"))

"""Personal data (op9): fixed patterns, and contextual extraction bootstrapped from them; DataFrame operations only.

1. Base spans by pattern and check (address parts, card digits and Luhn, phone digits). Places are running sums of the lengths
   of matches and of what splitting leaves between them, so a text is read once per pattern.
2. Seeds: base spans, and long hexadecimal runs as seeds of a further kind, ``secret`` (these are no spans by themselves).
   They induce lexical patterns (cues): the word before them with the signs and the quote between ("token=" and a quote), the
   two words before them on their line, and the word after them, each a pattern of its own. A pattern needs ``min_seeds``
   different seed values of its kind.
3. Pattern-instance graph: instances are seeds and other runs beside a pattern that overlap no base span, in its kind's alphabet
   or of four digits and more. For ``rounds`` rounds a pattern's confidence is the mean score of its instances (distinct
   values, one pseudo-count against). Seeds keep 1 for their kind and 0 for others; another value's score in a pattern is 1
   minus the product of (1 - confidence) over its other patterns, so no pattern vouches for its own finds.
4. Runs beside a pattern of confidence ``accept`` or more are new spans of its kind, unless they overlap a base span or lie
   inside another new one.

Defined cases: null text is empty; each row is searched on its own, repeated and null ids included; ties between kinds go to
the first listed; very long texts and many matches in one text take time in proportion; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, row_key, text_of, written

#: The kinds in order, each with its pattern (possessive and anchored, with the same matches).
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds of the kind that has no base pattern: hexadecimal keys of 128 to 512 bits, with digits and letters.
SECRET = r"(?<![A-Za-z0-9_+/.-])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9_+/-])"
ALL = [*KINDS, "secret"]
#: Other runs that may be identifiers. "": of any kind, no blanks, at least four digits. Else in the alphabet of a kind, for
#: its patterns alone: e-mails without a dot or with a bracketed "at", hexadecimal and other dotted addresses, groups of digits.
SHAPES = {
    "": r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*[0-9])[A-Za-z0-9+][A-Za-z0-9@._+-]{3,62}[A-Za-z0-9](?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[](?i:at)[)\]])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?<![A-Za-z0-9.:])(?:[0-9]++(?:\.[0-9]++){2,}+|[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+)(?![A-Za-z0-9:])",
    "secret": r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{12,128}+=*(?![A-Za-z0-9_+/-])",
    "card": r"(?<![A-Za-z0-9.])[0-9]++(?:[\x20-][0-9]++)*+(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+(.@-])\(?\+?[0-9]++(?:(?:\)[\x20-]?|\x20?\(|[\x20./-])[0-9]++)*+(?![A-Za-z0-9])",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FOUND = "array<struct<start:int,end:int,value:string,cues:array<string>>>"
SIGNS = r"\s*(?:[:=]|=>|->)?\s*[\"'(\[<{]?"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), let(_digits(value), luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def cues_of(before: Column, after: Column) -> Column:
    """The patterns around a run: "1 word", "2 word word" and "> word", each with the signs and the quote or bracket between."""
    tail = F.lower(before.substr(F.greatest(F.length(before) - 60, F.lit(0)) + 1, F.lit(61)))  # only the tail is context
    head = F.lower(after.substr(F.lit(1), F.lit(40)))
    words = {"1 ": (tail, rf"(\p{{L}}+)({SIGNS})\s*$"), "2 ": (tail, rf"(\p{{L}}+[:=,]?[\x20\t]+\p{{L}}+)({SIGNS})\s*$"), "> ": (head, r"^([\"')\]>}]?)\s+(\p{L}+)")}

    def cue(kind: str, t: Column, pattern: str) -> Column:
        word, signs = (2, 1) if kind == "> " else (1, 2)
        marks = F.regexp_replace(F.regexp_extract(t, pattern, signs), r"\s+", "")
        return let(F.regexp_replace(F.regexp_extract(t, pattern, word), r"\s+", " "), lambda x: F.when(x != "", F.concat(F.lit(kind), x, marks)))

    return F.array_compact(F.array(*[cue(k, t, p) for k, (t, p) in words.items()]))


def shaped(shape: str, value: Column) -> Column:
    """What a run of the shape must have besides its pattern."""
    n = F.length(_digits(value))
    if shape == "ip":  # hexadecimal ones have eight parts or leave some out
        return ~value.contains(":") | value.contains("::") | (F.length(F.regexp_replace(value, "[^:]", "")) == 7)
    if shape == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return {"": n >= 4, "card": n.between(12, 19), "phone": n.between(7, 15)}.get(shape, F.lit(True))


def running(values: Column, chunk: int = 1024) -> Column:
    """Running sums of an array. Appending copies an array, so sums run inside chunks, and over the chunks."""

    def sums(x: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(x, zero, lambda a, v: F.struct((a["n"] + v).alias("n"), F.concat(a["all"], F.array(a["n"] + v)).alias("all")))["all"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda c: sums(F.slice(values, c * chunk + 1, F.lit(chunk))))

    def joined(p: Column) -> Column:
        before = lambda ends, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))
        moved = lambda ends: F.transform(p, lambda x, i: let(before(ends, i), lambda n: F.transform(x, lambda v: v + n)))
        return F.flatten(let(sums(F.transform(p, lambda x: F.element_at(x, -1))), moved))

    return let(parts, joined)


def spans_of(text: Column, pattern: str) -> Column:
    """Every match with its place and the patterns around it, in order."""
    matches, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)

    def placed(m: Column, b: Column) -> Column:
        def one(ends: Column) -> Column:
            def at(value: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.length(value)).cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"), cues_of(F.get(b, i), F.get(b, i + 1)).alias("cues"))

            return F.transform(m, at)

        return let(running(F.transform(m, lambda x, i: (F.length(F.get(b, i)) + F.length(x)).cast("long"))), one)

    both = F.struct(matches.alias("m"), between.alias("b"))
    return let(both, lambda x: F.when(F.size(x["m"]) > 0, placed(x["m"], x["b"])).otherwise(F.array().cast(FOUND)))


def kept_spans(rank: int, kind: str) -> Column:
    """The matches of a kind (in the column of its name) that pass its check."""
    placed = lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["cues"].alias("cues")
    )
    return F.transform(F.filter(kind, lambda x: passes(kind, x["value"])), placed)


def runs_of(shape: str) -> Column:
    """The matches of a shape (in the column other_ of its name) that have what it must have, and a pattern beside them."""
    may = F.filter(f"other_{shape}", lambda x: shaped(shape, x["value"]) & (F.size(x["cues"]) > 0))
    return F.transform(may, lambda x: x.withField("shape", F.lit(shape)))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, secrets, other): base spans and secret seeds with kind and rank; other identifier-shaped runs."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), text_of().alias("text"))
    #: A text without what a pattern needs is not searched.
    none, digit = F.array().cast(FOUND), F.col("text").rlike("[0-9]")
    needs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    may = {"email": F.col("text").rlike(r"@|[(\[](?i:at)[)\]]"), "ip": digit | F.col("text").contains("::")}
    searched = lambda k, p, ask: F.when(ask.get(k, digit), spans_of(F.col("text"), p)).otherwise(none)
    seeds = [searched(k, p, needs).alias(k) for k, p in {**KINDS, "secret": SECRET}.items()]
    raw = rows.select("doc_id", "row_key", *seeds, *[searched(k, p, may).alias(f"other_{k}") for k, p in SHAPES.items()])
    base = [kept_spans(i, k) for i, k in enumerate(KINDS)]
    secrets = kept_spans(len(KINDS), "secret")
    return raw.select("doc_id", "row_key", F.array_sort(F.concat(*base)).alias("base"), secrets.alias("secrets"), F.concat(*[runs_of(k) for k in SHAPES]).alias("other"))


def free_runs(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, end, shape, cues, value): the other runs that overlap no base span. Overlaps are found in the order of
    places, not by comparing all with all."""
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("string").alias("shape"), F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("array<string>").alias("cues")))
    other = F.transform("other", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["shape"].alias("shape"), F.xxhash64(x["value"]).alias("value"), x["cues"].alias("cues")))
    rows = found.where(F.size("other") > 0).select("doc_id", "row_key", F.explode(F.concat(base, other)).alias("x")).select("doc_id", "row_key", "x.*")
    line = Window.partitionBy("doc_id", "row_key").orderBy("start")
    is_base = F.col("shape").isNull()
    before = F.max(F.when(is_base, F.col("end"))).over(line.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(line.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return rows.where(~is_base & clear).select("doc_id", "row_key", "start", "end", "shape", "value", "cues")


def confident(found: DataFrame, free: DataFrame, *, min_seeds: int, rounds: int, accept: float) -> DataFrame:
    """(cue, kind, confidence): patterns of confidence `accept` or more."""
    seeds = found.select(F.explode(F.concat("base", "secrets")).alias("x")).select(F.explode("x.cues").alias("cue"), F.col("x.kind").alias("is"), F.xxhash64("x.value").alias("value")).distinct()
    induced = seeds.groupBy("cue", F.col("is").alias("kind")).agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("cue", "kind")
    induced = written(induced, "pii-patterns")
    # Edges of the graph: (pattern, kind, value, seed: 1 for its kind, 0 for another kind's, null for no seed).
    own = seeds.join(induced, "cue").select("cue", "kind", "value", (F.col("is") == F.col("kind")).cast("double").alias("seed"))
    runs = free.select(F.explode("cues").alias("cue"), "shape", "value").distinct().join(induced, "cue").where(F.col("shape").isin("", F.col("kind")))
    edges = own.unionByName(runs.select("cue", "kind", "value", F.lit(None).cast("double").alias("seed")))
    edges = written(edges.groupBy("cue", "kind", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    scores = edges.withColumn("score", F.coalesce("seed", F.lit(0.0)))
    for k in range(rounds):
        patterns = scores.groupBy("cue", "kind").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"))
        doubt = F.log(1 - F.least("confidence", F.lit(0.999)))
        doubted = edges.join(patterns, ["cue", "kind"]).withColumn("doubt", doubt)
        values = doubted.where(F.col("seed").isNull()).groupBy("kind", "value").agg(F.sum("doubt").alias("sum"))
        scores = doubted.join(values, ["kind", "value"], "left").withColumn("score", F.coalesce("seed", 1 - F.exp(F.col("sum") - F.col("doubt"))))
        scores = written(scores.select("cue", "kind", "value", "seed", "score"), f"pii-scores{k}")
    return scores.groupBy("cue", "kind").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence")).where(F.col("confidence") >= accept)


def find(docs: DataFrame, *, min_seeds: int = 5, rounds: int = 3, accept: float = 0.7) -> DataFrame:
    """(doc_id, base, added): sorted spans (start, rank, end, kind) of every document."""
    found = written(base_spans(docs), "pii-base")
    free = written(free_runs(found), "pii-free")
    good = confident(found, free, min_seeds=min_seeds, rounds=rounds, accept=accept)
    rank = F.array_position(F.array(*[F.lit(k) for k in ALL]), F.col("kind")).cast("int") - 1
    good = written(good.select("cue", "kind", F.struct(-F.round("confidence", 9), rank.alias("rank"), "kind").alias("b")), "pii-good")
    runs = free.select("doc_id", "row_key", "start", "end", "shape", F.explode("cues").alias("cue"))
    # Of a run's patterns the most confident names its kind.
    added = runs.join(good, "cue").where(F.col("shape").isin("", F.col("kind"))).groupBy("doc_id", "row_key", "start", "end").agg(F.min("b").alias("b"))
    # A run inside another is part of it.
    line = Window.partitionBy("doc_id", "row_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("end").over(line)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    added = added.select("doc_id", "row_key", F.struct("start", "b.rank", "end", "b.kind").alias("s"))
    added = added.groupBy(F.col("doc_id").alias("a_id"), F.col("row_key").alias("a_key")).agg(F.array_sort(F.collect_list("s")).alias("added"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = found.select("doc_id", "row_key", base.alias("base"))
    rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("row_key") == F.col("a_key")), "left")
    return rows.select("doc_id", "base", F.coalesce("added", F.filter("base", lambda x: F.lit(False))).alias("added"))


def report(docs: DataFrame, **options) -> DataFrame:
    rows = find(docs, **options)
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.array_remove(F.col("base.kind"), k)).cast("long") for k in KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, KINDS)]
    n = (F.size("base") + F.size("added")).cast("long")
    spans = listed(F.array_sort(F.concat("base", "added")))
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"), n.alias("n_spans"), (n > 0).alias("personal"))

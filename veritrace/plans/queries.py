"""The registered queries of the screening engine over the test tables, with their DuckDB counterparts where SQL has the operations.

The tables hold no lists, so parts stand in for entities: each distinct part name is a record, with type, dates, papers and
countries made of its key and size. Jaro-Winkler, sound keys and folding beyond ASCII have no counterpart in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.config import Settings, Weights
from veritrace.functions import dates
from veritrace.functions.fold import country_keys, country_table, fold, form_of, identifier_form, message_shape, without_stop_words
from veritrace.functions.phonetics import agreement, sounds
from veritrace.functions.similarity import levenshtein_similarity, token_set, token_sort, tokens
from veritrace.operators import accuracy, changes, profile, screening, snapshots, sync
from veritrace.operators.rescreen import Rescreen
from veritrace.operators.scoring import birth_reason, identifier_reason, nationality_reason
from veritrace.schema import ENTITY, QUERY, conformed, primary_name
from veritrace.sources.remarks import composed
from veritrace.sources.treasury import program_codes, sub_lists
from veritrace.streaming.rescreening import event_counts as counted_events


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name once, by its least key."""
    return _t(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


def _day(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """A point as a partial date, made by built-in functions."""
    first = F.make_date(year, F.lit(1) if month is None else month, F.lit(1) if day is None else day)
    last = F.make_date(year, F.lit(12), F.lit(31)) if month is None else first if day is not None else F.last_day(first)
    none = F.lit(None).cast("int")
    parts = [year.cast("int").alias("year"), (none if month is None else month.cast("int")).alias("month"), (none if day is None else day.cast("int")).alias("day")]
    empty = F.lit(None).cast(dates.POINT)
    return F.struct(*parts, empty.alias("from"), empty.alias("to"), F.lit(False).alias("approximate"), first.alias("first_date"), last.alias("last_date"))


def _paper(kind: str, value: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), identifier_form(value).alias("normalized_value"), none.cast("string").alias("country"), none.cast(dates.PDATE).alias("issued_on"), none.cast(dates.PDATE).alias("expires_on"), none.cast("string").alias("note"))


COUNTRIES = ("Russia", "Egypt", "Iran", "Canada", "Atlantis")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed records. Everything but the name follows from the key k."""
    k = F.col("id")
    names = F.array(F.struct(F.col("name").alias("value"), F.lit("primary").alias("kind"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("script")))
    alias = F.struct(F.concat(F.lit("the "), F.reverse("name")).alias("value"), F.lit("aka").alias("kind"), F.when(k % 4 == 0, "low").alias("quality"), F.lit(None).cast("string").alias("script"))
    year = (F.lit(1950) + k % 40).cast("int")
    born = F.when(k % 3 == 0, F.array(_day(year))).when(k % 3 == 1, F.array(_day(year, (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int")))).otherwise(F.array().cast(ENTITY["dates_of_birth"].dataType))
    rows = _names(spark, sf_dir).select(
        F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "even").otherwise("odd").alias("source"), k.cast("string").alias("source_ref"), F.when(k % 5 == 0, "organization").otherwise("individual").alias("type"),
        F.when(k % 4 < 2, F.concat(names, F.array(alias))).otherwise(names).alias("names"), F.when(k % 6 == 0, F.array(_paper("passport", F.concat(F.lit("P-"), k.cast("string"), F.lit("/77"))))).alias("identifiers"), born.alias("dates_of_birth"),
        F.when(k % 2 == 0, F.array(F.get(F.array(*[F.lit(c) for c in COUNTRIES]), (k % 5).cast("int")))).alias("nationalities"), F.array(F.concat(F.lit("P"), (k % 3).cast("string"))).alias("programs"), F.when(k % 7 == 0, F.concat(F.lit("listed as "), F.col("name"))).alias("remarks"),
    )
    return conformed(rows)


def _asked(spark: SparkSession, sf_dir: str, threshold: float | None) -> DataFrame:
    """Every part name as a query, with a date of birth, a country and a paper of its key."""
    k = F.col("id")
    rows = _names(spark, sf_dir).select(
        k.cast("string").alias("qid"), F.col("name"), F.lit(None).cast("string").alias("type"), F.array(_day((F.lit(1950) + k % 40).cast("int"))).alias("dates_of_birth"), F.array(F.get(F.array(*[F.lit(c) for c in COUNTRIES]), (k % 4).cast("int"))).alias("nationalities"),
        F.array(_paper("other", F.concat(F.lit("p"), k.cast("string"), F.lit("77")))).alias("identifiers"), F.lit(None).cast("array<string>").alias("sources"), F.lit(threshold).cast("double").alias("threshold"), F.lit(10).alias("limit"),
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUERY.fields])


# Names


def screen_names(spark, sf_dir):
    n = _names(spark, sf_dir)
    return screening.screen(n, n, lambda a, b: 60 * token_set(a, b) + 40 * token_sort(a, b))


def postings_idf(spark, sf_dir):
    n = _names(spark, sf_dir)
    return screening.frequencies(screening.features(n), n.count()).select("space", "feature", "df", F.round("idf", 6).alias("idf"))


def index_stats(spark, sf_dir):
    n = _names(spark, sf_dir)
    posted = screening.features(n)
    return posted.groupBy("space").agg(F.countDistinct("feature").alias("features"), F.count("*").alias("postings"), F.countDistinct("id").alias("names"))


def postings_budget(spark, sf_dir):
    n = _names(spark, sf_dir)
    posted = screening.features(n)
    return screening.within_budget(posted, screening.frequencies(posted, n.count()), 60).groupBy("qid").agg(F.count("*").alias("walked"), F.sum("df").alias("postings"))


def cosine_candidates(spark, sf_dir):
    n = _names(spark, sf_dir)
    return screening.candidates(n, n)


def pair_similarities(spark, sf_dir):
    n = _names(spark, sf_dir)
    pairs = screening.candidates(n, n).join(n.withColumnRenamed("name", "b"), "id").join(n.withColumnsRenamed({"id": "qid", "name": "a"}), "qid")
    a, b = F.col("a"), F.col("b")
    return pairs.select("qid", "id", F.round(levenshtein_similarity(a, b), 6).alias("lev"), F.round(token_sort(a, b), 6).alias("tsort"), F.round(token_set(a, b), 6).alias("tset"))


def folded_names(spark, sf_dir):
    return _names(spark, sf_dir).select("id", fold(F.concat(F.upper("name"), F.lit(" - Co., (LTD)"))).alias("form"))


def stop_words(spark, sf_dir):
    kind = F.when(F.col("id") % 2 == 0, "organization").otherwise("individual")
    named = _names(spark, sf_dir).select("id", kind.alias("kind"), F.concat(F.lit("the joint stock company "), "name", F.lit(" co ltd dr")).alias("form"))
    return named.select("id", without_stop_words(F.col("form"), F.col("kind")).alias("form"))


def document_folds(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", form_of(F.substring("text", 1, 80), F.lit("organization")).alias("form"))


def sound_keys(spark, sf_dir):
    return _names(spark, sf_dir).select("id", sounds(tokens(F.col("name"))).alias("sounds"))


def sound_agreement(spark, sf_dir):
    n = _names(spark, sf_dir).select("id", "name", tokens(F.col("name")).alias("t"))
    n = n.select("*", sounds("t").alias("s"))
    pairs = screening.candidates(n.select("id", "name"), n.select("id", "name")).select("qid", "id")
    left = n.select(F.col("id").alias("qid"), F.col("t").alias("qt"), F.col("s").alias("qs"))
    return pairs.join(left, "qid").join(n.select("id", "t", "s"), "id").select("qid", "id", F.round(agreement(F.col("qt"), F.col("qs"), F.col("t"), F.col("s")), 6).alias("agreement"))


def identifier_forms(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", identifier_form(F.concat(F.col("c_name"), F.lit(" / No. "), F.col("c_custkey").cast("string"))).alias("form"))


def nation_countries(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", country_keys(F.array(F.initcap("n_name")), country_table(spark)).alias("k")).select("n_nationkey", F.col("k")[0]["key"].alias("key"), F.col("k")[0]["known"].alias("known"))


# Entities


def screen_entities(spark, sf_dir):
    """Screening with evidence: every name against all records."""
    matcher = screening.Matcher(spark, _entities(spark, sf_dir))
    out = matcher.screen_all(_asked(spark, sf_dir, 75.0))
    return out.select("qid", "rank", "source", "entity_id", "matched_name", "score", F.transform("explanation", lambda r: F.concat_ws(":", r["factor"], r["contribution"])).alias("reasons"))


def evidence(spark, sf_dir):
    """What papers, dates and countries add to each pair of a query and one of the records beside it by key."""
    weights, table = Weights(), country_table(spark)
    e = _entities(spark, sf_dir).select("id", "dates_of_birth", country_keys(F.col("nationalities"), table).alias("countries"), F.transform("identifiers", lambda x: x.withField("country_key", F.lit(None).cast("string"))).alias("papers"), F.row_number().over(_by("id")).alias("n"))
    q = _asked(spark, sf_dir, 0.0).select("qid", F.col("dates_of_birth").alias("q_dates"), country_keys(F.col("nationalities"), table).alias("q_countries"), F.transform("identifiers", lambda x: x.withField("country_key", F.lit(None).cast("string"))).alias("q_papers"), F.row_number().over(_by("name", "qid")).alias("m"))
    near = q.withColumn("n", F.explode(F.array(F.col("m"), F.col("m") + 1, F.col("m") + 2))).join(e, "n")
    own = q.withColumn("id", F.concat(F.lit("part:"), "qid")).drop("n").join(e.drop("n"), "id")
    pairs = near.drop("n", "m").unionByName(own.drop("m")).distinct()
    part = lambda c: F.coalesce(c["contribution"], F.lit(0.0))
    return pairs.select("qid", "id", part(identifier_reason(F.col("q_papers"), F.col("papers"), weights)).alias("identifier"), part(birth_reason(F.col("q_dates"), F.col("dates_of_birth"), weights)).alias("dob"), part(nationality_reason(F.col("q_countries"), F.col("countries"), weights)).alias("nationality"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def record_model(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return e.select("id", primary_name(F.col("names")).alias("primary_name"), F.size("names").alias("n_names"), F.size("identifiers").alias("n_papers"), F.coalesce(dates.date_text(F.get("dates_of_birth", F.lit(0))), F.lit("")).alias("born"))


def reassembled_records(spark, sf_dir):
    """The records taken apart into flat tables and put together again: what differs, which is nothing, beside how many there are."""
    e = _entities(spark, sf_dir)
    again = snapshots.reassembled(snapshots.normalised(e))
    differ = changes.entity_diff(e, again)
    return e.agg(F.count("*").alias("records")).crossJoin(differ.agg(F.count("*").alias("differ")))


def _versions_of_records(spark, sf_dir):
    e = _entities(spark, sf_dir)
    k = F.col("source_ref").cast("long")
    before = e.where(k % 7 != 0)
    after = e.where(k % 11 != 0).withColumn("names", F.when(k % 5 == 0, F.reverse("names")).when(k % 6 == 0, F.slice("names", 1, 1)).otherwise(F.col("names"))).withColumn("remarks", F.when(k % 9 == 0, "amended").otherwise(F.col("remarks")))
    return before, after


def record_changes(spark, sf_dir):
    out = changes.entity_diff(*_versions_of_records(spark, sf_dir))
    return out.select("id", "change", F.array_join("fields", ",").alias("fields"))


def rescreen_alerts(spark, sf_dir):
    """Every name as a subject of a book against the records that changed."""
    moved = changes.entity_diff(*_versions_of_records(spark, sf_dir))
    found = Rescreen(spark, moved, "new", "old", Settings(threshold=80.0)).alerts(_asked(spark, sf_dir, None))
    return found.select("subject_id", "change", "entity_id", "score", "previous_score", F.array_join("fields", ",").alias("fields"))


def snapshot_checksum(spark, sf_dir):
    flat = _t(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey")
    return spark.createDataFrame([("nation", snapshots.checksum(flat, "nation"), snapshots.checksum(flat.orderBy(F.desc("n_name")), "nation"))], "source string, checksum string, other_order string").withColumn("same", F.col("checksum") == F.col("other_order")).select("source", "checksum", "same")


def composed_remarks(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return o.select("o_orderkey", composed(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" "))), {"Status": F.array(status), "Priority": F.array(F.col("o_orderpriority"), F.lit(" "))}).alias("remarks"))


def sub_list_names(spark, sf_dir):
    codes = ("SDGT", "NS-PLC", "UKRAINE-EO13662", "CAPTA", "FSE-IR")
    k = F.col("p_partkey")
    program = F.concat(F.lit("["), F.get(F.array(*[F.lit(c) for c in codes]), (k % 5).cast("int")), F.lit("] [RUSSIA-EO14024]"))
    codes_of = program_codes(program)
    return _t(spark, sf_dir, "part").select("p_partkey", codes_of.alias("c")).select("p_partkey", F.array_join("c", "|").alias("programs"), F.array_join(sub_lists(F.col("c")), "|").alias("lists"))


# Joins, differences, profiles


def nested_left_join(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    out = changes.nested_left_join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", "l_linenumber", "lines")
    return out.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["l_linenumber"].cast("string")), ","), F.lit("")).alias("line_numbers"))


def orphan_customers(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = _t(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return changes.orphans(urgent, _t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


def _versions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = o.where(F.col("o_orderkey") % 7 != 0)
    after = o.where(F.col("o_orderkey") % 11 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return before, after.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderpriority")))


def snapshot_diff(spark, sf_dir):
    return changes.diff(*_versions(spark, sf_dir), "o_orderkey")


def snapshot_churn(spark, sf_dir):
    before, after = _versions(spark, sf_dir)
    return changes.churn(changes.diff(before, after, "o_orderkey"), before)


def fill_profile(spark, sf_dir):
    labelled = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labelled, "doc_id", "left")
    return changes.fill_rates(docs, "lang", {"source_rate": F.col("source").isNotNull(), "label_rate": F.col("has").isNotNull()})


def record_profile(spark, sf_dir):
    return profile.measure(_entities(spark, sf_dir), "parts").select("kind", "name", F.round("value", 4).alias("value"), "size")


def checkup_findings(spark, sf_dir):
    """What a checkup finds between the two versions of the records."""
    before, after = _versions_of_records(spark, sf_dir)
    now = after.withColumn("programs", F.array().cast("array<string>")).where(F.col("source_ref").cast("long") % 3 != 0)
    return profile.findings(profile.measure(now, "parts", orphans={"alt": 3}), profile.measure(before, "parts")).select("severity", "check", "message")


def column_shape(spark, sf_dir):
    return changes.column_shape(_t(spark, sf_dir, "events"), F.col("event_type"), allowing=["view", "signup", "purchase", "click"]).select("checked", "matched", "blank", "ratio", "ok", F.array_join("sample", "|").alias("sample"))


def warning_shapes(spark, sf_dir):
    return changes.shapes(_t(spark, sf_dir, "events"), F.col("props"))


def top_warnings(spark, sf_dir):
    return changes.top_shapes(_t(spark, sf_dir, "orders"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of  "), F.col("o_orderpriority")))


def long_shapes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", message_shape(F.get(F.split("text", "\n"), F.lit(0))).alias("shape"))


# Dates, rates, times


def interval_overlap(spark, sf_dir):
    """Of each order with its lines: whether the order's month overlaps a line's month, and whether both show one day."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("s"))
    month, day = (lambda d: _day(F.year(d), F.month(d))), (lambda d: _day(F.year(d), F.month(d), F.day(d)))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", month(F.col("d")).alias("a"), month(F.col("s")).alias("b"), day(F.col("d")).alias("x"), day(F.col("s")).alias("y"))
    return rows.select("o_orderkey", "l_linenumber", dates.overlaps(F.col("a"), F.col("b")).alias("overlap"), dates.same_day(F.col("x"), F.col("y")).alias("same_day"), dates.date_text(F.col("a")).alias("month"))


def partial_dates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("circa "), F.date_format("d", "yyyy"))).otherwise(F.date_format("d", "MMM yyyy"))
    d = dates.partial_date(spelled)
    return o.select("o_orderkey", d.alias("p")).select("o_orderkey", dates.date_text(F.col("p")).alias("date"), F.col("p.first_date").alias("first_date"), F.col("p.last_date").alias("last_date"), dates.precision(F.col("p")).alias("precision"))


def serial_dates(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", dates.serial_date(F.col("p_partkey").cast("int")).alias("d"))


def threshold_sweep(spark, sf_dir):
    scored = _t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("positive"), F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") * 37 % 101).cast("double")).alias("score"))
    return accuracy.threshold_sweep(scored.where(F.col("positive").isNotNull()))


def price_percentiles(spark, sf_dir):
    return accuracy.percentile_by_rank(_t(spark, sf_dir, "orders"), F.col("o_totalprice"), [0.5, 0.95, 0.99])


def event_counts(spark, sf_dir):
    return counted_events(_t(spark, sf_dir, "events").select("ts", "event_type")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def sync_tallies(spark, sf_dir):
    import datetime as dt

    status = F.get(F.array(F.lit("updated"), F.lit("unchanged"), F.lit("failed")), (F.col("o_orderkey") % 3).cast("int"))
    results = _t(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_custkey").alias("record_count"), F.to_timestamp("o_orderdate").alias("fetched_at"))
    return sync.tallies(results, dt.datetime(2030, 1, 1, tzinfo=dt.UTC))


QUERIES = {
    f.__name__: f
    for f in (
        screen_names, screen_entities, postings_idf, index_stats, postings_budget, cosine_candidates, pair_similarities, folded_names, stop_words, document_folds, sound_keys, sound_agreement, identifier_forms, nation_countries, evidence, record_model,
        reassembled_records, record_changes, rescreen_alerts, snapshot_checksum, composed_remarks, sub_list_names, nested_left_join, orphan_customers, snapshot_diff, snapshot_churn, fill_profile, record_profile, checkup_findings, column_shape,
        warning_shapes, top_warnings, long_shapes, interval_overlap, partial_dates, serial_dates, threshold_sweep, price_percentiles, event_counts, sync_tallies,
    )
}

_NAMES = "names AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1)"
_FEATURES = _NAMES + """, toks AS (SELECT id, t FROM (SELECT id, unnest(string_split(name, ' ')) AS t FROM names) WHERE t <> ''),
    posted AS (SELECT DISTINCT id, 'token' AS space, t AS feature FROM toks UNION
        SELECT id, 'trigram', substr(' ' || t || ' ', i::BIGINT, 3) FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM toks)),
    idf AS (SELECT space, feature, count(*) AS df, ln(1 + (SELECT count(*) FROM names) / count(*)) AS idf FROM posted GROUP BY ALL)"""
_CANDIDATES = _FEATURES + """, n AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM posted JOIN idf USING (space, feature) GROUP BY id),
    w AS (SELECT id AS qid, space, feature, df, idf, row_number() OVER o AS rn, sum(df) OVER o AS cum FROM posted JOIN idf USING (space, feature) WINDOW o AS (PARTITION BY id ORDER BY df, space, feature ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT * FROM w WHERE rn = 1 OR cum <= 5000), qn AS (SELECT qid, sqrt(sum(idf * idf)) AS q FROM k GROUP BY qid),
    p AS (SELECT qid, id, least(1.0, sum(k.idf * k.idf) / (any_value(norm) * any_value(q))) AS c FROM k JOIN posted USING (space, feature) JOIN n USING (id) JOIN qn USING (qid) GROUP BY qid, id),
    best AS (SELECT qid, id, round(c, 6) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(c, 12) DESC, id) <= 200)"""


def _lev(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


_PAIRS = _CANDIDATES + f""", sorted AS (SELECT id, name, list_sort(list_filter(string_split(name, ' '), lambda x: x <> '')) AS s FROM names),
    j AS (SELECT best.qid, best.id, a.name AS a, b.name AS b, array_to_string(a.s, ' ') AS ta, array_to_string(b.s, ' ') AS tb,
        list_sort(list_distinct(list_filter(a.s, lambda x: list_contains(b.s, x)))) AS sh, list_sort(list_distinct(list_filter(a.s, lambda x: NOT list_contains(b.s, x)))) AS da, list_sort(list_distinct(list_filter(b.s, lambda x: NOT list_contains(a.s, x)))) AS db
        FROM best JOIN sorted a ON a.id = best.qid JOIN sorted b ON b.id = best.id),
    r AS (SELECT qid, id, a, b, ta, tb, array_to_string(sh, ' ') AS s0, array_to_string(list_concat(sh, da), ' ') AS s1, array_to_string(list_concat(sh, db), ' ') AS s2 FROM j),
    m AS (SELECT qid, id, {_lev('a', 'b')} AS lev, {_lev('ta', 'tb')} AS tsort, greatest({_lev('s0', 's1')}, {_lev('s0', 's2')}, {_lev('s1', 's2')}) AS tset FROM r)"""
_VERSIONS = """b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0),
    a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0),
    d AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, concat_ws(',', CASE WHEN b.o_orderstatus IS DISTINCT FROM a.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_orderpriority IS DISTINCT FROM a.o_orderpriority THEN 'o_orderpriority' END) AS moved,
        CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN moved <> '' THEN 'modified' END AS change, CASE WHEN change = 'modified' THEN moved ELSE '' END AS fields
        FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey)"""
_COUNTRY = "list_extract(['Russia', 'Egypt', 'Iran', 'Canada', 'Atlantis'], (id % {n} + 1)::INT)"
_RECORDS = _NAMES + """, e AS (SELECT id AS k, name, 'part:' || id AS id, 1950 + id % 40 AS y, CASE WHEN id % 4 < 2 THEN 2 ELSE 1 END AS n_names, CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS n_papers,
    CASE WHEN id % 5 = 0 THEN 'organization' ELSE 'individual' END AS type, id % 3 < 2 AS has_date, id % 2 = 0 AS has_nation, id % 7 = 0 AS has_remarks FROM names)"""
_SHAPE = r"CASE WHEN length({m}) > 100 THEN substr({m}, 1, 100) || '...' ELSE {m} END"


def _masked(line: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({line}, '[0-9]', '#', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


ORACLES = {
    "screen_names": f"WITH {_PAIRS} SELECT qid, id, round(60 * tset + 40 * tsort, 1) AS score FROM m WHERE round(60 * tset + 40 * tsort, 1) >= 75 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(60 * tset + 40 * tsort, 1) DESC, id) <= 10",
    "postings_idf": f"WITH {_FEATURES} SELECT space, feature, df, round(idf, 6) AS idf FROM idf",
    "index_stats": f"WITH {_FEATURES} SELECT space, count(DISTINCT feature) AS features, count(*) AS postings, count(DISTINCT id) AS names FROM posted GROUP BY space",
    "postings_budget": f"WITH {_FEATURES}, w AS (SELECT id AS qid, df, row_number() OVER o AS rn, sum(df) OVER o AS cum FROM posted JOIN idf USING (space, feature) WINDOW o AS (PARTITION BY id ORDER BY df, space, feature ROWS UNBOUNDED PRECEDING)) SELECT qid, count(*) AS walked, sum(df)::BIGINT AS postings FROM w WHERE rn = 1 OR cum <= 60 GROUP BY qid",
    "cosine_candidates": f"WITH {_CANDIDATES} SELECT qid, id, weight FROM best",
    "pair_similarities": f"WITH {_PAIRS} SELECT qid, id, round(lev, 6) AS lev, round(tsort, 6) AS tsort, round(tset, 6) AS tset FROM m",
    "folded_names": f"WITH {_NAMES} SELECT id, trim(regexp_replace(name || ' co ltd', '[^a-z0-9]+', ' ', 'g')) AS form FROM names",
    "stop_words": f"WITH {_NAMES} SELECT id, CASE WHEN id % 2 = 0 THEN name || ' dr' ELSE 'the joint stock company ' || name || ' co ltd' END AS form FROM names",
    "identifier_forms": "SELECT c_custkey, regexp_replace(lower(c_name || ' / No. ' || c_custkey), '[^a-z0-9]+', '', 'g') AS form FROM customer",
    "evidence": f"""WITH {_NAMES}, e AS (SELECT id AS k, 'part:' || id AS id, row_number() OVER (ORDER BY 'part:' || id) AS n FROM names), q AS (SELECT id AS k, id::VARCHAR AS qid, row_number() OVER (ORDER BY name, id::VARCHAR) AS m FROM names),
        pairs AS (SELECT q.k AS qk, qid, e.k AS ek, e.id FROM q JOIN e ON e.n BETWEEN q.m AND q.m + 2 UNION SELECT q.k, qid, e.k, e.id FROM q JOIN e ON e.k = q.k)
        SELECT qid, id, CASE WHEN ek % 6 = 0 AND qk = ek AND length('p' || qk || '77') >= 4 THEN 40.0 ELSE 0.0 END AS identifier,
            CASE WHEN ek % 3 = 2 THEN 0.0 WHEN 1950 + qk % 40 = 1950 + ek % 40 THEN 6.0 ELSE -35.0 END AS dob,
            CASE WHEN ek % 2 = 1 THEN 0.0 WHEN qk % 4 = ek % 5 THEN 6.0 WHEN ek % 5 = 4 THEN 0.0 ELSE -12.0 END AS nationality FROM pairs""",
    "record_model": f"WITH {_RECORDS} SELECT id, name AS primary_name, n_names::INT AS n_names, n_papers::INT AS n_papers, CASE WHEN k % 3 = 0 THEN y::VARCHAR WHEN k % 3 = 1 THEN printf('%04d-%02d-%02d', y, k % 12 + 1, k % 28 + 1) ELSE '' END AS born FROM e",
    "reassembled_records": f"WITH {_NAMES} SELECT count(*) AS records, 0::BIGINT AS differ FROM names",
    "record_changes": f"""WITH {_RECORDS} SELECT id, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' ELSE 'modified' END AS change,
        CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 6 = 0 AND k % 5 <> 0 AND n_names = 2 THEN 'names' END, CASE WHEN k % 9 = 0 THEN 'remarks' END) END AS fields
        FROM e WHERE (k % 7 = 0) <> (k % 11 = 0) OR (k % 7 <> 0 AND k % 11 <> 0 AND (k % 9 = 0 OR (k % 6 = 0 AND k % 5 <> 0 AND n_names = 2)))""",
    "composed_remarks": "SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey END, '[source fields] ' || concat_ws('; ', CASE WHEN o_orderkey % 3 <> 0 THEN 'Status: ' || o_orderstatus END, 'Priority: ' || o_orderpriority)) AS remarks FROM orders",
    "sub_list_names": """SELECT p_partkey, list_extract(['SDGT', 'NS-PLC', 'UKRAINE-EO13662', 'CAPTA', 'FSE-IR'], (p_partkey % 5 + 1)::INT) || '|RUSSIA-EO14024' AS programs,
        list_extract(['Non-SDN Menu-Based Sanctions List', 'Non-SDN Palestinian Legislative Council List|Non-SDN Menu-Based Sanctions List', 'Sectoral Sanctions Identifications List', 'CAPTA List|Non-SDN Menu-Based Sanctions List', 'FSE List|Non-SDN Menu-Based Sanctions List'], (p_partkey % 5 + 1)::INT) AS lists FROM part""",
    "nested_left_join": "SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS line_numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "orphan_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "snapshot_diff": f"WITH {_VERSIONS} SELECT o_orderkey, change, fields FROM d WHERE change IS NOT NULL",
    "snapshot_churn": f"WITH {_VERSIONS} SELECT count(*) AS changed, (SELECT count(*) FROM b) AS previous, round(count(*) / (SELECT count(*) FROM b), 6) AS churn FROM d WHERE change IS NOT NULL",
    "fill_profile": "SELECT coalesce(lang, 'all') AS cohort, count(*) AS n, round(avg((source IS NOT NULL)::INT), 4) AS source_rate, round(avg((l.doc_id IS NOT NULL)::INT), 4) AS label_rate FROM (SELECT doc_id, coalesce(lang, '') AS lang, source FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ROLLUP (lang)",
    "record_profile": f"""WITH {_RECORDS}, s AS (SELECT count(*) AS n, count(*) FILTER (type = 'individual') AS i, count(*) FILTER (type = 'organization') AS o, count(*) FILTER (n_names > 1) AS al, count(*) FILTER (n_papers > 0) AS pa, count(*) FILTER (has_remarks) AS re,
        count(*) FILTER (has_date AND type = 'individual') AS da, count(*) FILTER (has_nation AND type = 'individual') AS na FROM e)
        SELECT unnest([{{'kind': 'count', 'name': 'all', 'value': n::DOUBLE, 'size': n}}, {{'kind': 'count', 'name': 'individual', 'value': i::DOUBLE, 'size': n}}, {{'kind': 'count', 'name': 'organization', 'value': o::DOUBLE, 'size': n}}, {{'kind': 'count', 'name': 'vessel', 'value': 0.0, 'size': n}}, {{'kind': 'count', 'name': 'aircraft', 'value': 0.0, 'size': n}},
            {{'kind': 'fill', 'name': 'names', 'value': 1.0, 'size': n}}, {{'kind': 'fill', 'name': 'aliases', 'value': round(al / n, 4), 'size': n}}, {{'kind': 'fill', 'name': 'addresses', 'value': 0.0, 'size': n}}, {{'kind': 'fill', 'name': 'identifiers', 'value': round(pa / n, 4), 'size': n}}, {{'kind': 'fill', 'name': 'programs', 'value': 1.0, 'size': n}},
            {{'kind': 'fill', 'name': 'remarks', 'value': round(re / n, 4), 'size': n}}, {{'kind': 'fill', 'name': 'dates_of_birth', 'value': round(da / i, 4), 'size': i}}, {{'kind': 'fill', 'name': 'nationalities', 'value': round(na / i, 4), 'size': i}}], recursive := true) FROM s""",
    "column_shape": """WITH s AS (SELECT count(event_type) AS checked, count(*) FILTER (event_type IN ('view', 'signup', 'purchase', 'click')) AS matched, count(*) FILTER (event_type IS NULL) AS blank FROM events)
        SELECT checked, matched, blank, round(matched / checked, 4) AS ratio, matched / checked >= 0.99 AS ok, (SELECT coalesce(string_agg(t, '|' ORDER BY t), '') FROM (SELECT event_type AS t FROM events WHERE event_type NOT IN ('view', 'signup', 'purchase', 'click') ORDER BY t LIMIT 3)) AS sample FROM s""",
    "warning_shapes": f"SELECT {_SHAPE.format(m='m')} AS shape, count(*) AS n FROM (SELECT {_masked('props')} AS m FROM events) GROUP BY 1",
    "top_warnings": f"""SELECT shape, n FROM (SELECT {_SHAPE.format(m='m')} AS shape, count(*) AS n FROM (SELECT {_masked("'order ' || o_orderkey || ' of  ' || o_orderpriority")} AS m FROM orders) GROUP BY 1) ORDER BY n DESC, shape LIMIT 5""",
    "long_shapes": f"SELECT doc_id, {_SHAPE.format(m='m')} AS shape FROM (SELECT doc_id, {_masked('string_split(text, chr(10))[1]')} AS m FROM documents)",
    "interval_overlap": "SELECT o_orderkey, l_linenumber, date_trunc('month', o_orderdate) = date_trunc('month', l_shipdate) AS overlap, o_orderdate::DATE = l_shipdate::DATE AS same_day, strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "partial_dates": """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 3 AS r FROM orders) SELECT o_orderkey, CASE r WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN 'circa ' || strftime(d, '%Y') ELSE strftime(d, '%Y-%m') END AS date,
        CASE r WHEN 0 THEN d WHEN 1 THEN make_date(year(d), 1, 1) ELSE date_trunc('month', d)::DATE END AS first_date, CASE r WHEN 0 THEN d WHEN 1 THEN make_date(year(d), 12, 31) ELSE last_day(d) END AS last_date, CASE r WHEN 0 THEN 'day' WHEN 1 THEN 'year' ELSE 'month' END AS precision FROM d""",
    "serial_dates": "SELECT p_partkey, CASE WHEN p_partkey = 60 THEN NULL WHEN p_partkey < 60 THEN (DATE '1899-12-31' + p_partkey::INT)::DATE ELSE (DATE '1899-12-30' + p_partkey::INT)::DATE END AS d FROM part",
    "threshold_sweep": """WITH s AS (SELECT quality = 1 AS positive, CASE WHEN doc_id % 9 <> 0 THEN doc_id * 37 % 101 END AS score FROM labels WHERE quality IS NOT NULL), t AS (SELECT unnest(range(0, 100, 5))::INT AS threshold),
        c AS (SELECT threshold, count(*) FILTER (positive AND score >= threshold) AS found, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive AND score >= threshold) AS false_alerts FROM t, s GROUP BY threshold),
        r AS (SELECT *, CASE WHEN found + false_alerts > 0 THEN found / (found + false_alerts) END AS pr, CASE WHEN p > 0 THEN found / p END AS re FROM c)
        SELECT threshold, found, p - found AS missed, false_alerts, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END, 6) AS f1 FROM r""",
    "price_percentiles": "WITH l AS (SELECT list_sort(list(o_totalprice)) AS v FROM orders) SELECT s::DOUBLE AS share, v[least(floor(s * len(v)), len(v) - 1)::INT + 1] AS value FROM l, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS s)",
    "event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sync_tallies": "SELECT count(*) FILTER (o_orderkey % 3 = 0) AS updated, count(*) FILTER (o_orderkey % 3 = 1) AS unchanged, count(*) FILTER (o_orderkey % 3 = 2) AS failed, sum(o_custkey)::BIGINT AS record_count, max(epoch(TIMESTAMP '2030-01-01 00:00:00') - floor(epoch(o_orderdate)))::BIGINT AS max_age_seconds FROM orders",
}

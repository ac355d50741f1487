"""Scoring, evidence, queries and screening, held to published numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritrace.config import Settings, Weights, threshold_of
from veritrace.errors import InvalidArgument, QueryError
from veritrace.functions import dates, fold, phonetics, similarity
from veritrace.operators import queries
from veritrace.operators.screening import Matcher
from veritrace.schema import ENTITY, conformed, invalid, primary_name


def entity(id, names, type="individual", source="a", **more):
    named = [n if isinstance(n, dict) else {"value": n, "kind": "primary" if not k else "aka"} for k, n in enumerate(names)]
    papers = [{"kind": "other", **p} for p in more.pop("identifiers", [])]
    born = [dates.parse_date(d) for d in more.pop("dates_of_birth", [])]
    return {"id": id, "source": source, "type": type, "names": named, "identifiers": papers, "dates_of_birth": born, **more}


@pytest.fixture(scope="module")
def matcher(spark):
    rows = [
        entity("1", ["ABBAS, Abu"], dates_of_birth=["1948-12-10"], nationalities=["Russia"], identifiers=[{"kind": "passport", "value": "AB123456", "country": "Russia"}]),
        entity("2", ["Vladimir Putin", {"value": "Vlad", "kind": "aka", "quality": "low"}], nationalities=["RUS"], dates_of_birth=["circa 1952"]),
        entity("3", ["JSC Rosneft Oil Company"], type="organization", source="b"),
        entity("4", ["Sea Star"], type="vessel", source="b", identifiers=[{"kind": "registration_number", "value": "IMO 9187629"}]),
        entity("5", ["Nobody", "Mohammed Al Zawahiri"], nationalities=["Atlantis"]),
        entity("6", ["---"], source="b"),
    ]
    return Matcher(spark, conformed(spark.createDataFrame(rows, ENTITY)), settings=Settings(threshold=0.0))


def one(matcher, name, id, **fields):
    rows = [r for r in matcher.screen({"name": name, "threshold": 0, "limit": 50, **fields}).collect() if r["entity_id"] == id]
    return rows[0] if rows else None


def factors(row):
    return {r["factor"]: r["contribution"] for r in row["explanation"]}


@pytest.mark.parametrize("a,b,score", [("ABBAS, Abu", "Abu Abbas", 90.4), ("putin vladimir vladimirovich", "vladimir putin", 76.2), ("kim jong un", "kim yong chol", 54.8), ("QADHAFI, Muammar", "Muammar Gaddafi", 58.75), ("GADDAFI, Muammar", "Muammar Gaddafi", 84.75)])
def test_name_scores(spark, a, b, score):
    names = spark.createDataFrame([(a, b)], "a string, b string").select(fold.fold("a").alias("a"), fold.fold("b").alias("b"))
    names = names.select("a", "b", phonetics.sounds(F.split("a", " ")).alias("p"), phonetics.sounds(F.split("b", " ")).alias("q")).cache()
    assert names.select(similarity.name_score(F.col("a"), F.col("b"), F.col("p"), F.col("q")).alias("s")).first()["s"] == pytest.approx(score, abs=0.051)


@pytest.mark.parametrize("word,key", [(w, k) for k, words in {"MHMT": "mohammed muhammad mohamad mohamed", "ASF": "yusuf yousef youssef jusuf", "KTF": "qaddafi gaddafi kadafi qadhafi", "APTL": "abdul abdel abdal", "XK": "shaykh sheikh shaikh", "HSN": "hussein hussain husain"}.items() for w in words.split()])
def test_sound_keys(word, key):
    assert key in phonetics.sound_keys(word)


def test_sound_keys_of_odd_words():
    assert phonetics.sound_keys("") == () and phonetics.sound_keys("путин") == () and phonetics.sound_keys("knight") == ("NT",) and phonetics.sound_keys("Xavier")[0].startswith("S")
    assert phonetics.sound_keys("thomas") == ("TMS",) and phonetics.sound_keys("smith") == ("SM0", "XMT") and phonetics.sound_keys("filipowicz") == ("FLPTS", "FLPFX")


@pytest.mark.parametrize("a,b,share", [("kim jong un", "kim yong chol", 2 / 3), ("mohammed", "mohammed al zawahiri", 1.0), ("smith", "brown", 0.0), ("", "smith", 0.0)])
def test_phonetic_agreement(spark, a, b, share):
    df = spark.createDataFrame([(a.split(), b.split())], "x array<string>, y array<string>").select("*", phonetics.sounds("x").alias("p"), phonetics.sounds("y").alias("q")).cache()
    got = df.select(phonetics.agreement(F.col("x"), F.col("p"), F.col("y"), F.col("q")).alias("s")).first()["s"]
    assert got == pytest.approx(share)


def test_folds(spark):
    names = {"Straße": "strasse", "İSTANBUL": "istanbul", "AERO-CARIBBEAN": "aero caribbean", "Bank 131 (JSC)": "bank 131 jsc", "ПУТИН": "путин", "---": "", "Əliyev Ŀ": "eliyev l", "O'Brien": "o brien", "ʿAlī": "ali"}
    df = spark.createDataFrame([*names.items(), (None, None)], "n string, want string")
    assert all(r["f"] == r["want"] for r in df.select("want", fold.fold("n").alias("f")).collect())
    kinds = [("JSC Rosneft Oil Company", "organization", "rosneft oil"), ("JSC Rosneft Oil Company", None, "jsc rosneft oil company"), ("The Company", "organization", "the company"), ("Sheikh Dr Omar", "individual", "omar"), ("Al Shabaab Group", "organization", "al shabaab group"), ("Open Joint Stock Company X", "organization", "x"), ("The Sea", "vessel", "the sea")]
    df = spark.createDataFrame(kinds, "n string, k string, want string")
    assert all(r["f"] == r["want"] for r in df.select("want", fold.form_of(F.col("n"), F.col("k")).alias("f")).collect())
    more = fold.DEFAULT.merge(legal_forms=["GRUPA"])
    assert spark.range(1).select(fold.form_of(F.lit("Grupa Azoty"), F.lit("organization"), more).alias("f")).first()["f"] == "azoty"
    with pytest.raises(ValueError):
        fold.DEFAULT.merge(nonsense=["x"])


DATES = {
    "1962": "1962", "1962-03": "1962-03", "1962-03-01": "1962-03-01", "01 Mar 1962": "1962-03-01", "1 March 1962": "1962-03-01", "March 1, 1962": "1962-03-01", "Mar 1st 1962": "1962-03-01", "Mar 1962": "1962-03", "Sept 1962": "1962-09",
    "circa 1962": "circa 1962", "ca. 1962": "circa 1962", "~1962": "circa 1962", "1962 to 1964": "1962 to 1964", "between 1962 and 1964": "1962 to 1964", "1962-1964": "1962 to 1964", "1962 – 1964": "1962 to 1964", "1962-03-01Z": "1962-03-01",
    "": None, "1972-02-31": None, "1972-13": None, "Smarch 1938": None, "n/a": None, "1973 to 1971": None,
}


def test_partial_dates(spark):
    df = spark.createDataFrame([*DATES.items(), (None, None)], "t string, want string")
    got = df.select("t", "want", dates.date_text(dates.partial_date("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == [(r["t"], r["want"]) for r in got]


@pytest.mark.parametrize("a,b,near", [("1962", "1962-05-01", True), ("1962-05", "1962-06", False), ("circa 1962", "1963", True), ("circa 1962", "1964", False), ("1960 to 1962", "1962-12-31", True), ("2024-02-29", "2024-02-29", True)])
def test_overlaps(spark, a, b, near):
    x, y = (dates.partial_date(F.lit(v)) for v in (a, b))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select(dates.overlaps(F.col("x"), F.col("y")).alias("o"), dates.conflicts(F.col("x"), F.col("y")).alias("c"), dates.conflicts(F.col("x"), F.lit(None).cast(dates.PDATE)).alias("n")).first()
    assert (r["o"], r["c"], r["n"]) == (near, not near, False)


def test_serial_dates(spark):
    df = spark.createDataFrame([(1,), (59,), (60,), (61,), (45000,)], "n int")
    assert [r["d"] for r in df.orderBy("n").select(dates.serial_date(F.col("n")).alias("d")).collect()] == [dt.date(1900, 1, 1), dt.date(1900, 2, 28), None, dt.date(1900, 3, 1), dt.date(2023, 3, 15)]


def test_evidence(matcher):
    base = one(matcher, "Abu Abbas", "1")
    assert base["score"] == 90.4 and base["matched_name"] == "ABBAS, Abu" and factors(base) == {"name": 90.4}
    assert base["explanation"][0]["detail"] == 'matched primary name "ABBAS, Abu"'
    cases = [
        ({"dob": "1948-12-10"}, {"dob": 15.0}), ({"dob": "1948"}, {"dob": 6.0}), ({"dob": "circa 1949"}, {"dob": 6.0}), ({"dob": "1950-01-01"}, {"dob": -35.0}),
        ({"nationality": "RU"}, {"nationality": 6.0}), ({"nationality": "Egypt"}, {"nationality": -12.0}), ({"nationality": "Atlantis"}, {}),
        ({"identifier": "ab-123 456"}, {"identifier": 40.0}), ({"identifier": {"kind": "national_id", "value": "AB123456"}}, {}), ({"identifier": {"kind": "passport", "value": "AB123456", "country": "Egypt"}}, {}),
        ({"identifier": {"kind": "passport", "value": "AB123456", "country": "RUS"}}, {"identifier": 40.0}),
    ]
    for fields, want in cases:
        row = one(matcher, "Abu Abbas", "1", **fields)
        got = factors(row)
        assert {k: v for k, v in got.items() if k not in ("name", "clamp")} == want, fields
        assert row["score"] == pytest.approx(min(100.0, 90.4 + sum(want.values()))) and ("clamp" in got) == (90.4 + sum(want.values()) > 100)
    detail = {r["factor"]: r["detail"] for r in one(matcher, "Abu Abbas", "1", identifier="ab-123 456", dob="1950-01-01")["explanation"]}
    assert detail["identifier"] == "passport ab-123 456 matches listed AB123456" and detail["dob"] == "date of birth 1950-01-01 conflicts with listed 1948-12-10"
    assert one(matcher, "ABBAS, Abu", "1", dob="1950")["score"] == 65.0


def test_low_quality_aliases_and_unknown_countries(matcher):
    row = one(matcher, "Vlad", "2")
    assert factors(row)["alias_quality"] == -10.0 and row["score"] == 90.0 and [r["factor"] for r in row["penalties"]] == ["alias_quality"]
    assert "nationality" not in factors(one(matcher, "Mohammed Zawahiri", "5", nationality="Egypt"))  # one side is no known country
    assert one(matcher, "Mohammed Zawahiri", "5")["matched_kind"] == "aka"


def test_filters_and_limits(matcher):
    assert {r["entity_id"] for r in matcher.screen({"name": "Abu Abbas", "type": "vessel", "threshold": 0}).collect()} <= {"4"}
    assert {r["source"] for r in matcher.screen({"name": "Rosneft oil", "sources": ["b"], "threshold": 0}).collect()} == {"b"}
    assert matcher.screen("Abu Abbas", threshold=95).count() == 0 and matcher.screen("Abu Abbas", threshold=90.4).count() == 1
    assert matcher.screen("a b c vladimir sea rosneft abbas", limit=2).count() <= 2
    with pytest.raises(QueryError):
        matcher.screen({"name": "x", "sources": ["nowhere"]})
    stamped = matcher.screen("Vladimir Putin").first()
    assert stamped["matcher_version"] == "1" and stamped["backend"] == "spark" and stamped["weights"]["token_set"] == 0.45 and stamped["rank"] == 1
    rows = matcher.screen_all(["Vladimir Putin", {"name": "Sea Star", "qid": "ship"}]).where("rank = 1").collect()
    assert {(r["qid"], r["entity_id"]) for r in rows} == {("0", "2"), ("ship", "4")} and len({r["screened_at"] for r in rows}) == 1


def test_index(matcher):
    stats = matcher.index.stats().first()
    assert stats["names"] == 7 and stats["entities"] == 5 and stats["postings"] == matcher.index.posted.count()


def test_queries():
    assert queries.build("x y")["threshold"] == 75.0 and queries.build({"name": "x", "dob": "1960"})["dates_of_birth"][0]["year"] == 1960
    assert queries.build({"name": "x", "country": "RU"}, nationalities=["EG"])["nationalities"] == ["EG"]
    for bad in ({"name": "x", "dob": "1960", "date_of_birth": "1961"}, {"name": "x", "colour": 1}, {"name": ""}, {"name": "---"}, {"name": "x", "type": "planet"}, {"name": "x", "dob": "Smarch"}, {"name": "x", "limit": 0}, {"name": "x", "threshold": 101}, {"name": "x", "threshold": "high"}, {"name": "x", "sources": []}, {"name": "x", "identifier": {"value": "--"}}):
        with pytest.raises(InvalidArgument):
            queries.build(bad)
    assert threshold_of("50") == 50.0


def test_subjects_have_ids_and_no_limits(spark):
    row = queries.subjects_of(spark, [{"id": 7, "name": "x", "threshold": 60}]).first()
    assert row["qid"] == "7" and row["threshold"] == 60.0
    for bad in ({"name": "x"}, {"id": 1, "name": "x", "limit": 3}, {"id": 1, "name": "x", "source": "a"}):
        with pytest.raises(InvalidArgument):
            queries.subjects_of(spark, [bad])


def test_weights():
    for bad in ({"token_set": 0.5}, {"dob_conflict": 5.0}, {"identifier_match": -1.0}):
        with pytest.raises(InvalidArgument):
            Weights(**bad)


def test_records(spark):
    rows = [{"source": "a", "source_ref": "9", "type": "VESSEL", "names": [{"value": "  Sea  "}, {"value": " "}], "identifiers": [{"value": "Éa-1"}, {"value": "--"}]}]
    r = conformed(spark.createDataFrame(rows, ENTITY)).select("*", primary_name(F.col("names")).alias("p")).first()
    assert (r["id"], r["type"], r["p"], len(r["names"]), r["identifiers"][0]["normalized_value"], len(r["identifiers"])) == ("a:9", "vessel", "Sea", 1, "éa1", 1)
    bad = [{"id": "1", "type": "planet", "names": [{"value": "x"}]}, {"id": "2", "type": "vessel"}, {"type": "vessel", "names": [{"value": "x"}]}]
    assert {x["problem"] for x in invalid(conformed(spark.createDataFrame(bad, ENTITY))).collect()} == {"unknown type", "no name", "no id"}


LAWS = [("abc", "abd"), ("", "a"), ("kim jong un", "kim yong chol"), ("a", "a"), ("sea star", "star sea")]


@pytest.mark.parametrize("f", [similarity.jaro, similarity.jaro_winkler, similarity.levenshtein_similarity, similarity.token_sort, similarity.token_set])
def test_laws_of_similarities(spark, f):
    df = spark.createDataFrame(LAWS, "a string, b string")
    for r in df.select("a", "b", f(F.col("a"), F.col("b")).alias("x"), f(F.col("b"), F.col("a")).alias("y"), f(F.col("a"), F.col("a")).alias("z"), similarity.jaro_winkler_ceiling(F.col("a"), F.col("b")).alias("c"), similarity.levenshtein_ceiling(F.col("a"), F.col("b")).alias("d")).collect():
        assert 0 <= r["x"] <= 1 and r["x"] == pytest.approx(r["y"]) and r["z"] == 1
        assert f is not similarity.jaro_winkler or r["x"] <= r["c"] + 1e-12
        assert f is not similarity.levenshtein_similarity or r["x"] <= r["d"] + 1e-12
    assert spark.range(1).select(similarity.at_least(F.lit(0.4), 0.5).alias("s")).first()["s"] == 0.0

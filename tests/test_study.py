"""The study compositions end to end on small hand-written tables."""

import math

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from civicframe.models import predict, regress, report
from civicframe.operators import joins
from civicframe.plans import crosswalk, study
from civicframe.plans import study_values as V

RING = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


@pytest.fixture(scope="module")
def make(spark):
    from civicframe.sources.local import small_frame

    return lambda schema, *data: small_frame(spark, list(data), schema)


@pytest.fixture(scope="module")
def states(make):
    return make(
        "state string, state_name string, state_code string", ("TX", "Texas", "48"), ("FL", "Florida", "12"),
        ("VT", "Vermont", "50"), ("NE", "Nebraska", "31"), ("DC", "District of Columbia", "11"), ("TX", "Texas", "48"),
        ("AK", "Alaska", "02"), ("MD", "Maryland", "24"),
    )


def url(state, n):
    text = f"https://legislate.com{state}/bill/{n}"
    assert text[21:23] == state
    return text


@pytest.fixture(scope="module")
def bills(make):
    raw = make(
        "bill_id long, session_id long, bill_number string, status_date string, last_action_date string, title string,"
        " description string, url string, file string",
        (1, 10, "H0061", "2020-12-20", "2021-01-01", "Lists", "d", url("FL", 1), "FL/a/bills.csv"),
        (2, 11, "H0061", "2020-12-21", "2021-01-02", "Lists again", "d", url("FL", 2), "FL/b/bills.csv"),
        (3, 20, "SB7", None, "2021-02-03", "Voting", "d", url("TX", 3), "TX/a/bills.csv"),
        (4, None, "SB7", "2021-03-03", "2021-02-03", "Later", "d", url("TX", 4), "TX/b/bills.csv"),
        (5, 21, "SB1", "2021-08-03", "2021-09-03", "Special", "d", url("TX", 5), "TX/a/bills.csv"),
    ).withColumn("status_date", F.col("status_date").cast("date"))
    sessions = make("session_id long, session string", (10, ""), (11, ""), (20, ""), (21, "(S-2)"))
    return study.canonical_bills(raw, sessions, swaps=V.DROP_LETTER_2021)


def test_bills(bills):
    got = rows(bills, "bill_merge", "year", "bill_id")
    # A missing session reads NA in the year, so bill 4 stays apart; bill 2 is a later session.
    assert got == [("FL HB61", "2020", 1), ("TX SB1", "2021 (S-2)", 5), ("TX SB7", "2021", 3), ("TX SB7", "2021 NA", 4)]


@pytest.fixture(scope="module")
def provisions(make, bills):
    introduced = make(
        "state string, bill string, subject string, impact string, year string, date_added string, url string",
        ("Florida", "FL HJR 61", "Rolls", "Restrictive", "2021", "1/5/2021", "u1"),
        ("Florida", "FL HJR 61", "ID", "restrictive", "2021", "1/4/2021", "u2"),
        ("Texas", "TX SB 7", "ID", "R", "2021", "3/1/2021", "u3"),
        ("Texas", "TX SB 7", "Hours", "Expansive", "2021", "3/1/2021", "u4"),
        ("Texas", "TX SB 1", "ID", "R", "2021 (S-2)", "8/1/2021", "u5"),
        ("Texas", "TX SB 99", "ID", "R", "2021", "3/1/2021", "u6"),
        ("Texas", "TX SB 8", "ID", "R", "", "3/1/2021", "u7"),
        ("Kentucky", "KY BR 5", "ID", "R", "2021", "3/1/2021", "u8"),
    )
    enacted = make(
        "state string, bill string, subject string, impact string", ("Texas", "TX SB 1", "id", "R"), ("Texas", "TX SB 1", "hours", "R")
    )
    merged = study.merged_provisions(introduced, enacted)
    corrections = make("bill string, bill_merge2 string, year2 string", ("TX SB 7", "", "2021"), ("TX SB 99", "TX SB7", ""))
    keyed = study.keyed_provisions(merged, corrections, ["bill"])
    groupings = make("subject string, group string", ("id", "voter id"), ("hours", "early"), ("rolls", "Other"))
    return study.clean_provisions(keyed, bills, groupings)


def test_provisions(provisions):
    got = rows(provisions, "bill_id", "bill", "impact", "group", "pass", "year", "state")
    assert got == [
        (1, "FL HJR 61", "R", "Other", False, "2020", "Florida"),
        (1, "FL HJR 61", "R", "voter id", False, "2020", "Florida"),
        (3, "TX SB 7", "E", "early", False, "2021", "Texas"),
        (3, "TX SB 7", "R", "voter id", False, "2021", "Texas"),
        # A corrected key gives the bill its canonical name.
        (3, "TX SB 7", "R", "voter id", False, "2021", "Texas"),
        (5, "TX SB 1", "R", "early", True, "2021 (S-2)", "Texas"),
        (5, "TX SB 1", "R", "voter id", True, "2021 (S-2)", "Texas"),
    ]
    dates = {r["bill_id"]: str(r["date_added"]) for r in provisions.select("bill_id", "date_added").distinct().collect()}
    assert dates == {1: "2021-01-04", 3: "2021-03-01", 5: "2021-08-01"}


def test_dates_are_dates_and_not_text(make):
    introduced = make(
        "state string, bill string, year string, date_added string, url string",
        ("Texas", "b", "2021", "10/1/2021", "u1"), ("Texas", "b", "2021", "2/1/2021", "u2"), ("Texas", "b", "2021", "x", "u0"),
    )
    enacted = make("state string, bill string", ("Texas", "b"))
    assert rows(study.merged_provisions(introduced, enacted), "date_added") == [("2/1/2021",)]
    assert rows(study.merged_provisions(introduced, enacted, ["url"]), "date_added") == [("x",)]


def test_unreadable_numbers_keep_bills_apart(make):
    bills = make(
        "bill_id long, session_id long, bill_number string, status_date date, last_action_date string, url string, file string",
        *[(i, 1, n, None, "2021-01-01", "https://legiscan.com/FL/bill/x", "f") for i, n in enumerate(["H12A", "S77B", "H0012"])],
    )
    got = study.canonical_bills(bills, make("session_id long, session string", (1, "")))
    assert rows(got, "bill_merge") == [("FL H12A",), ("FL HB12",), ("FL S77B",)]


@pytest.fixture(scope="module")
def sponsors(make, provisions):
    who = make(
        "bill_id long, people_id long, position int, file string", (1, 100, 1, "FL/a/bills.csv"), (3, 200, 1, "TX/a/bills.csv"),
        (3, 201, 2, "TX/a/bills.csv"), (5, 200, 1, "TX/a/bills.csv"), (3, 999, 1, "TX/other.csv"),
    )
    people = make(
        "people_id long, name string, party string, district string, file string", (100, "Ann", "", "HD-007", "FL/a/bills.csv"),
        (200, "Bob", "R", "SD-012", "TX/a/bills.csv"), (201, "Cal", "D", "SD-012", "TX/a/bills.csv"), (200, "Old", "D", "SD-001", "TX/b/bills.csv"),
    )
    return study.sponsor_rows(
        provisions, who, people, ["state", "bill", "name", "party", "district", "position", "impact", "group", "pass"]
    )


def test_sponsors(sponsors):
    got = rows(sponsors.groupBy("bill", "name", "party").count())
    assert got == [
        ("FL HJR 61", "Ann", "", 2), ("TX SB 1", "Bob", "R", 2), ("TX SB 7", "Bob", "R", 3), ("TX SB 7", "Cal", "D", 3),
    ]


@pytest.fixture(scope="module")
def seats(make, sponsors, states):
    overrides = make("state string, district string, GEOID string", ("Massachusetts", "HD-x", "25001"))
    return study.district_sponsors(sponsors, overrides, states, ["state", "district"])


def test_seats(seats):
    cols = ["district", "chamber", "party", "n_R", "n_E", "n_pass_R", "n_pass_E"]
    assert rows(seats, *cols) == [("12007", "HD", "R", 2, 0, 0, 0), ("48012", "SD", "M", 6, 2, 2, 0)]


def test_district_codes(make, states):
    raw = [
        ("Alaska", "SD-B", "0200B"), ("Maryland", "HD-012A", "2412A"), ("Maryland", "HD-012", "24012"), ("Texas", "HD", "48NA"),
        ("Texas", "SD-012", "99999"),
    ]
    spons = make(
        "state string, bill string, district string, party string, position int, impact string, pass boolean, want string",
        *[(s, "b", d, "R", 1, "R", False, w) for s, d, w in raw],
    )
    overrides = make("state string, district string, GEOID string", ("Texas", "SD-012", "99999"))
    got = study.district_sponsors(spons, overrides, states, ["state", "district"])
    assert sorted(r["district"] for r in got.collect()) == sorted(w for _, _, w in raw)


VOTES = "state string, party_simplified string, year int, candidatevotes long"


@pytest.fixture(scope="module")
def votes(make):
    return make(
        VOTES, ("TEXAS", "DEMOCRAT", 2020, 46), ("TEXAS", "REPUBLICAN", 2020, 50), ("TEXAS", "REPUBLICAN", 2020, 4),
        ("TEXAS", "OTHER", 2020, 900), ("TEXAS", "DEMOCRAT", 2016, 40), ("TEXAS", "REPUBLICAN", 2016, 60),
        ("FLORIDA", "DEMOCRAT", 2020, 60), ("FLORIDA", "REPUBLICAN", 2020, 40), ("VERMONT", "DEMOCRAT", 2012, 60),
    )


@pytest.fixture(scope="module")
def control(make):
    return make("NAME string, control string", ("Texas", "Rep"), ("Florida", "Rep"), ("Vermont", "Dem"), ("Nebraska", None))


def test_state_panel(make, provisions, states, votes, control):
    demo = make(
        "GEOID string, NAME string, population double, nh_white double, median_income double, median_age double, some_college double",
        *[(c, n, 1000.0, w, 50000.0, 40.0, 0.5) for c, n, w in
          [("48", "Texas", 0.41), ("12", "Florida", 0.53), ("50", "Vermont", 0.92), ("31", "Nebraska", 0.78),
           ("11", "District of Columbia", 0.37), ("72", "Puerto Rico", 0.01)]],
    )
    before = make("GEOID string, nh_white double", ("48", 0.5), ("12", 0.53))
    index = make("state string, year int, FinalCOVI double", ("TX", 2020, 4.5), ("TX", 2016, 1.0), ("VT", 2020, 0.0))
    counts = study.provision_counts(provisions)
    panel = study.state_panel(counts, demo, before, index, states, votes, control)
    got = {r["NAME"]: r for r in panel.collect()}
    assert set(got) == {"Texas", "Florida", "Vermont", "Nebraska"}
    assert [(got[n]["intro"], got[n]["passed"]) for n in ("Texas", "Florida", "Vermont")] == [(4, 2), (2, 0), (0, 0)]
    assert [got[n]["r"] for n in ("Texas", "Vermont", "Nebraska")] == ["Republican", "Other", "Republican"]
    # Both limits of the competitive interval count; an unknown share stays unknown.
    assert [got[n]["competitive"] for n in ("Texas", "Florida", "Vermont")] == ["Competitive", "ANC", None]
    texas = got["Texas"]
    assert math.isclose(texas["change_dem"], 6.0) and math.isclose(texas["change_white"], -0.18)
    assert math.isclose(texas["nh_white"], 41.0) and math.isclose(texas["population"], math.log(1000))
    assert texas["FinalCOVI"] == 4.5 and got["Florida"]["FinalCOVI"] is None

    table = study.category_table(counts).collect()
    assert [(r["group"], r["intro"], r["passed"]) for r in table] == [("Voter ID", 4, 1), ("Early Voting", 1, 1), ("Other", 1, 0)]
    full = {r["state"]: r["intro"] for r in study.state_counts(counts, states).collect()}
    assert full["Vermont"] == 0 and full["Texas"] == 4 and "District of Columbia" not in full


@pytest.fixture(scope="module")
def districts(spark):
    schema = f"GEOID string, state string, rings {RING}"
    lower = spark.createDataFrame([("12007", "FL", box(0, 0, 2, 4)), ("12008", "FL", box(2, 0, 4, 4)), ("48001", "TX", box(0, 0, 4, 4))], schema)
    upper = spark.createDataFrame([("12001", "FL", box(0, 0, 4, 4)), ("48012", "TX", box(0, 0, 4, 4))], schema)
    zips = spark.createDataFrame([("00501", box(0, 0, 4, 2)), ("33101", box(0, 2, 4, 4))], f"GEOID string, rings {RING}")
    return {"lower": lower, "upper": upper, "zips": zips}


@pytest.fixture(scope="module")
def shares(spark, districts):
    precincts = spark.createDataFrame(
        [("FL", "1,000", "3,000", box(0, 0, 1, 1)), ("FL", "500", "500", box(0, 2, 1, 3)), ("FL", "10", "30", box(3, 0, 4, 1)),
         ("FL", "7", "7", box(50, 50, 51, 51))],
        f"state string, G20PREDBID string, G20PRERTRU string, rings {RING}",
    )
    return study.district_shares(precincts, districts["lower"], districts["upper"], "G20PREDBID", "G20PRERTRU")


def test_district_shares(shares):
    got = {(r["GEOID"], r["chamber"]): (round(r["share_dem"], 6), r["n"]) for r in shares.collect()}
    assert got == {
        ("12007", "HD"): (0.3, 2), ("12008", "HD"): (0.25, 1), ("12001", "SD"): (round(1510 / 5040, 6), 3),
        (None, "HD"): (0.5, 1), (None, "SD"): (0.5, 1),
    }


@pytest.fixture(scope="module")
def blocks(make, districts):
    raw = make(
        "GEOID20 string, state string, INTPTLON20 string, INTPTLAT20 string, COUNTYFP20 string, POP20 long",
        ("480010001", "TX", "+1.0", "1.0", "001", 100), ("480010002", "TX", "1.5", "3.0", "001", 300), ("480030001", "TX", "3.0", "1.0", "003", 0),
        ("120010001", "FL", "1.0", "1.0", "001", 10), ("120010002", "FL", "3.0", "3.0", "001", 30), ("120010003", "FL", "bad", "3.0", "001", 5),
    )
    placed = study.block_crosswalk(raw, districts["upper"], districts["lower"], districts["zips"])
    return placed.withColumn("county", F.concat(F.substring("GEOID20", 1, 2), "COUNTYFP20"))


def test_blocks(blocks):
    assert rows(blocks, "GEOID20", "upper", "lower", "zip") == [
        ("120010001", "12001", "12007", "00501"), ("120010002", "12001", "12008", "33101"), ("120010003", None, None, None),
        ("480010001", "48012", "48001", "00501"), ("480010002", "48012", "48001", "33101"), ("480030001", "48012", "48001", "00501"),
    ]


@pytest.fixture(scope="module")
def scores(make, blocks):
    survey = make(
        "race int, lookupzip int, CC20_441a int, CC20_441b int", (1, 501, 1, 5), (1, 501, 3, 3), (2, 501, 5, 1), (1, 33101, 5, 1),
        (1, 33101, None, 2), (1, 99999, 1, 1),
    )
    return crosswalk.score_by_area(
        blocks, study.survey_scores(survey), "zip", "rr", "POP20", {"SD": "upper", "HD": "lower"}, "resent"
    )


def test_scores(scores):
    got = {(r["GEOID"], r["chamber"]): (r["resent"], r["n"]) for r in scores.collect()}
    assert got[("48012", "SD")] == ((4.0 * 100 + 1.0 * 300) / 400, 3)
    assert got[("12007", "HD")] == (4.0, 1) and got[("12008", "HD")] == (1.0, 1)
    assert got[(None, "SD")] == (None, 1)


@pytest.fixture(scope="module")
def fallback(make, blocks):
    results = make(
        "year int, state_po string, party string, county_fips int, candidatevotes long", (2020, "TX", "DEMOCRAT", 48001, 25),
        (2020, "TX", "REPUBLICAN", 48001, 75), (2020, "TX", "GREEN", 48001, 99), (2016, "TX", "DEMOCRAT", 48001, 99),
    )
    shares = study.county_shares(results)
    assert rows(shares) == [("48001", 0.25)]
    return crosswalk.areal_share(blocks, shares, "county", "share_dem", "POP20", {"SD": "upper", "HD": "lower"})


def test_fallback(fallback):
    got = {(r["GEOID"], r["chamber"]): r["share_dem"] for r in fallback.collect()}
    # County 003 has no share but also no people; Florida's counties have people and no share.
    assert got[("48012", "SD")] == 0.25 and got[("48001", "HD")] == 0.25
    assert got[("12001", "SD")] is None


def test_district_panel(make, seats, shares, fallback, votes, control, states, scores):
    demo = make(
        "GEOID string, chamber string, nh_white double, population double, median_income double, median_age double, some_college double",
        *[(g, c, w, 100.0, 60000.0, 41.0, 0.4) for g, c, w in
          [("12007", "HD", 0.5), ("12008", "HD", 0.6), ("48001", "HD", 0.7), ("12001", "SD", 0.55), ("48012", "SD", 0.45),
           ("50001", "SD", 0.95), ("12009", "HD", None)]],
    )
    before = make("GEOID string, chamber string, nh_white double", ("12007", "HD", 0.25))
    around = make("GEOID string, nh_white double", ("12", 0.53), ("48", 0.41), ("50", 0.92))
    panel = study.district_panel(demo, before, seats, around, shares, fallback, votes, control, states, scores)
    got = {(r["GEOID"], r["chamber"], r["impact"]): r for r in panel.collect()}
    # Vermont has no 2020 share and drops out; the null district drops out; three impacts each remain.
    assert len(got) == 15
    fl, tx = got[("12007", "HD", "R")], got[("48012", "SD", "R")]
    assert (fl["n_intro"], fl["n_pass"], fl["sp_intro"], fl["sp_pass"]) == (2, 0, 100, 0)
    assert (tx["n_intro"], tx["n_pass"], tx["sp_pass"]) == (6, 2, 100)
    assert (got[("12008", "HD", "R")]["n_intro"], got[("12008", "HD", "R")]["sp_intro"]) == (0, 0)
    assert math.isclose(fl["share_rep"], 70.0) and math.isclose(tx["share_rep"], 75.0)
    assert fl["competitive"] is False and tx["competitive"] is True and tx["r"] is True
    assert fl["south"] is True and fl["change_white"] == 2.0 and math.isclose(fl["w"], 1 / 3)
    assert fl["resent"] == 4.0 and tx["resent"] == 1.75


def test_votes(make, bills):
    listed = make("bill string, bill_id long, file string", ("TX SB 7", 3, "TX/a"), ("IA SF 413", 5, "IA/a"), ("FL HB 61", 1, "FL/a"))
    urls = make(
        "bill string, house string, senate string", ("TX SB 7", "http://x/r/11", "http://x/r/12"), ("IA SF 413/IA SSB 1199", "http://x/r/13", ""),
    ).toDF("Bill", "House URL", "Senate URL")
    calls = make(
        "roll_call_id long, bill_id long, file string, date string, chamber string", (11, 3, "TX/a", "2021-01-01", "H"), (12, 3, "TX/a", "2021-01-02", "S"),
        (13, 5, "IA/a", "2021-01-03", "H"),
    )
    cast = make(
        "roll_call_id long, people_id long, vote_desc string, file string", (11, 1, "Yea", "TX/a"), (11, 2, "Nay", "TX/a"), (11, 3, "Yea", "TX/a"),
        (11, 4, "Absent", "TX/a"), (12, 1, "Nay", "TX/a"), (13, 5, "Yea", "IA/a"),
    )
    people = make(
        "people_id long, party string, file string", (1, "R", "TX/a"), (2, "D", "TX/a"), (3, "D", "TX/a"), (4, "I", "TX/a"), (5, "L", "IA/a"),
    )
    got = {r["Bill"]: r.asDict() for r in study.vote_crosstab(listed, urls, calls, cast, people).collect()}
    tx = got["TX SB 7"]
    assert (tx["R_house"], tx["D_house"], tx["I_house"], tx["R_senate"], tx["D_senate"]) == ("1 / 1", "1 / 2", None, "0 / 1", None)
    assert (got["IA SF 413"]["L_house"], got["IA SF 413"]["L_senate"]) == ("1 / 1", "Voice Vote")
    assert {v for k, v in got["FL HB 61"].items() if k != "Bill"} == {"Voice Vote"}
    assert study.vote_crosstab(listed, urls, calls, cast, people).columns == [
        "Bill", "R_house", "D_house", "I_house", "L_house", "R_senate", "D_senate", "I_senate", "L_senate"
    ]


def test_patched_roll_calls(make):
    urls = make("bill string, house_url string, senate_url string", ("OK HB 2663", "http://x/1", "http://x/2"))
    assert rows(study.final_votes(urls)) == [("OK HB 2663", "house", 1073681), ("OK HB 2663", "senate", 1060047)]


def test_introduced_2022(make, bills):
    listed = make(
        "state string, bill string, year int, url string", ("Texas", "TX SB 7", 2021, "u"), ("Virginia", "VA HB 34", 2022, "u"),
        ("Massachusetts", "MA H812/MA HD1393", 2022, "u"), ("North Carolina", "NC SB 326", 2021, "u"), ("Pennsylvania", "PA HCJR 5", 2022, "u"),
    )
    got = study.introduced_2022(listed, bills)
    assert rows(got, "bill_merge", "year", "bill_id") == [
        ("MA H812", "2022", None), ("NC S326", "2021", None), ("PA HB5", "2022", None), ("TX SB7", "2021", 3), ("VA HB34", "2021", None),
    ]
    assert rows(joins.unmatched(listed, got.filter("bill_id is not null"), ["bill"]), "bill") == [
        ("MA H812/MA HD1393",), ("NC SB 326",), ("PA HCJR 5",), ("VA HB 34",),
    ]


def test_party_tallies(make):
    df = make(
        "bill string, party string, position int", ("a", "R", 1), ("a", "R", 2), ("a", "D", 2), ("b", "", 1), ("MA S 2554", "", 1), ("c", "N", 1), ("c", "", 3),
    )
    assert rows(study.party_tallies(df)) == [(None, 1, 0), ("Democrat", 2, 1), ("Non-Partisan", 1, 1), ("Republican", 3, 2)]


@pytest.fixture(scope="module")
def fake_panel(make):
    rng = np.random.default_rng(4)
    n = 240
    data = []
    for i in range(n):
        white, rep = rng.uniform(20, 95), rng.uniform(10, 90)
        hit = bool(rng.random() < 1 / (1 + math.exp(-(rep - 50) / 15)))
        data.append((
            "HD" if i % 2 else "SD", white, float(rng.choice([45.0, 60.0, 75.0, 88.0])), rep, rng.uniform(3, 12), rng.uniform(30, 50),
            rng.uniform(9, 12), rng.uniform(30, 80), bool(rng.random() < 0.5), bool(rng.random() < 0.5),
            None if i % 31 == 0 else rng.uniform(1, 5), 100 * int(hit), hit,
        ))
    return make(
        "chamber string, nh_white double, state_nh_white double, share_rep double, median_income double, median_age double,"
        " population double, some_college double, competitive boolean, r boolean, resent double, sp_intro int, hit boolean", *data,
    ).persist()


@pytest.mark.parametrize("name", ["white", "share", "full", "score", "score_full"])
def test_district_models(fake_panel, name):
    robust = regress.fit(fake_panel, study.district_specs()[name], "hc1", slices=["chamber"])
    odds = regress.fit(fake_panel, study.district_specs("hit")[name], "logit", slices=["chamber"])
    assert set(robust.models) == set(odds.models) == {("HD",), ("SD",)}
    for m in [*robust.models.values(), *odds.models.values()]:
        assert np.all(np.isfinite(m.beta)) and np.all(np.linalg.eigvalsh(m.cov) > -1e-8) and m.dropped == []
        assert set(m.names) <= set(V.DISTRICT_LABELS)
        assert m.n == 120 if "score" not in name else m.n < 120
    # Rows lost to a missing score do not move the basis of the other columns.
    if name == "score_full":
        assert robust.design.poly.keys() == robust.models.keys()


def test_district_predictions(fake_panel):
    fit = regress.fit(fake_panel, study.district_specs()["full"], "hc1", slices=["chamber"])
    grid = predict.with_levels(predict.observed_grid(fake_panel, "nh_white", ["chamber"]), "state_nh_white", [50.0, 80.0])
    out = predict.rescale(predict.predict(fit, grid), 100)
    assert out.count() == 480
    assert out.filter("not (conf_low < predicted and predicted < conf_high)").count() == 0


def test_state_models(make):
    rng = np.random.default_rng(8)
    data = [
        (float(rng.poisson(8)), float(rng.poisson(2)), rng.uniform(20, 95), str(rng.choice(["Republican", "Other"])),
         str(rng.choice(["ANC", "Competitive"])), *rng.normal(size=6).tolist())
        for _ in range(50)
    ]
    panel = make(
        "intro double, passed double, nh_white double, r string, competitive string, FinalCOVI double, change_dem double,"
        " median_income double, median_age double, population double, some_college double", *data,
    )
    for name, spec in study.state_specs().items():
        for estimator in ("huber", "ols") if name.startswith("intro") else ("ols",):
            fit = regress.fit(panel, spec, estimator)
            labelled = report.label_terms(report.coefficients(fit), V.STATE_LABELS)
            assert labelled.count() == len(fit.models[()].names), name
    full = regress.fit(panel, study.state_specs()["intro_full"], "huber")
    grid = predict.with_levels(predict.value_grid(panel, "nh_white", 40, 93), "r", ["Republican", "Other"])
    assert predict.predict(full, grid, hold=predict.AT_BASE).count() == 108
    assert one(report.fit_stats(full))["nobs"] == 50

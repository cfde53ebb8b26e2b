"""The provision studies as compositions of operators.

Each function takes DataFrames and returns one, so callers choose where to write a
stage.  Join keys are explicit throughout.  Where the source study has a slip
(a competitive test without its upper limit, fallback shares that are never
merged, control exceptions in one panel only), the intended form is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.nulls import if_else_na, not_in, overlay, paste, strict, to_int
from ..models.design import Factor, Poly, Spec, crossing
from ..operators import aggregate, groups, joins, recode, reshape, spatial
from . import study_values as V

IMPACTS = ["R", "N", "E"]


# --- bills and provisions ---------------------------------------------------


def canonical_bills(
    bills: DataFrame, sessions: DataFrame, numbers=None, swaps=(), year_fallback: bool = True, order: Sequence[str] = ("file", "bill_id")
) -> DataFrame:
    """One row per (bill_merge, year): the bill of the first session."""
    state = text.chars(F.col("url"), 22, 23)
    year = F.year("status_date").cast("long")
    if year_fallback:
        year = text.year_or_text(F.col("status_date"), F.col("last_action_date"))
    out = joins.left_join(bills.withColumns({"state": state, "year": year}), sessions, ["session_id"])
    number = text.strip_leading_zeros(F.col("bill_number"), F.col("state"), numbers or V.NUMBERS_2021)
    out = recode.recode(out.withColumn("bill_number", number), "bill_number", list(swaps))
    out = out.withColumns(
        {
            "bill_merge": paste(F.col("state"), F.col("bill_number")),
            "year": text.trim_blank(paste(F.col("year"), F.col("session"))),
        }
    )
    return groups.first_per_group(out, ["bill_merge", "year"], groups.nulls_last("session_id", *order))


def bill_key(bill: Column) -> Column:
    """``'TX S B 1'`` to ``'TX SB1'``: state, blank, the rest without blanks."""
    return text.trim_blank(paste(text.chars(bill, 1, 2), text.squeeze(text.chars(bill, 3))))


def merged_provisions(introduced: DataFrame, enacted: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
    """Introduced provisions, with enacted bills taking the place of their introduced rows.

    An enacted bill takes the date of its first introduced row: by ``order`` (such as the
    source order of a CSV scan), else by the date itself.
    """
    keys = ["bill", "year", "state"]
    passed = recode.recode(enacted, "bill", V.ENACTED_NAMES)
    passed = recode.recode(passed.withColumn("year", F.lit("2021")), "year", V.ENACTED_YEAR)
    order = order or (text.parse_date(F.col("date_added"), "M/d/yyyy"), "url")
    dates = groups.first_per_group(introduced, keys, groups.nulls_last(*order)).select(*keys, "date_added")
    passed = joins.left_join(passed.withColumn("pass", F.lit(True)), dates, keys)
    return joins.override(introduced.withColumn("pass", F.lit(False)), passed, keys)


def keyed_provisions(provisions: DataFrame, corrections: DataFrame, on: Sequence[str], key_rules=None, year_rules=None) -> DataFrame:
    """Provisions with comparable (bill_merge, year) keys and one date per bill."""
    dated = provisions.withColumn("date_added", text.parse_date(F.col("date_added"), "M/d/yyyy")).filter("year <> ''")
    keyed = dated.withColumn("bill_merge", bill_key(F.col("bill")))
    keyed = recode.recode(keyed, "bill_merge", V.KEY_RULES_2021 if key_rules is None else key_rules)
    keyed = recode.recode(keyed, "year", V.YEAR_RULES_2021 if year_rules is None else year_rules).filter(V.NOT_BILLS)
    keyed = groups.with_strict_min(keyed, ["bill", "year", "state"], "date_added")
    if "date_added" in corrections.columns and dict(corrections.dtypes)["date_added"] == "string":
        corrections = corrections.withColumn("date_added", text.parse_date(F.col("date_added"), "M/d/yyyy"))
    fixed = joins.left_join(keyed, corrections, on)
    return fixed.withColumns(
        {"bill_merge": overlay(F.col("bill_merge2"), F.col("bill_merge")), "year": overlay(F.col("year2"), F.col("year"))}
    ).drop("bill_merge2", "year2")


def clean_provisions(provisions: DataFrame, bills: DataFrame, groupings: DataFrame) -> DataFrame:
    """Provisions matched to bill ids, with impact and category recoded; unmatched rows dropped."""
    first_added = provisions.groupBy("state", "bill", "year", "bill_merge").agg(
        strict(F.min, F.col("date_added")).alias("date_added")
    )
    known = bills.select("bill_id", "title", "file", "bill_merge", "year")
    bridge = joins.left_join(first_added, known, ["bill_merge", "year"])
    bridge = groups.first_per_group(
        bridge, ["state", "bill", "year", "title", "bill_id"], groups.nulls_last("bill_merge", "file")
    )
    names = groups.first_per_group(
        bridge.select("bill_id", F.col("bill").alias("first_name"), "state", "year", "bill_merge"), ["bill_id"],
        groups.nulls_last("state", "first_name", "year", "bill_merge"),
    ).select("bill_id", "first_name")
    matched = joins.left_join(provisions, bridge.select("bill", "bill_id", "file", "year", "state"), ["bill", "year", "state"])
    letter = F.lower(F.substring("impact", 1, 1))
    impact = F.when(letter == "r", "R").when(letter == "n", "N").when(letter.isin("e", "p"), "E")
    matched = matched.withColumns({"impact": impact, "subject": F.lower("subject")})
    grouped = joins.left_join(matched, groupings, ["subject"]).drop("subject").dropna(subset=["group", "impact"])
    named = joins.left_join(grouped, names, ["bill_id"]).drop("bill").withColumnRenamed("first_name", "bill")
    return named.filter(F.col("bill_id").isNotNull())


def sponsor_rows(bills: DataFrame, sponsors: DataFrame, people: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per bill row and sponsor, with the sponsor's name, party and district."""
    out = joins.left_join(bills, sponsors.select("bill_id", "file", "people_id", "position"), ["bill_id", "file"])
    people = people.select("people_id", "file", "name", "party", "district")
    return joins.left_join(out, people, ["people_id", "file"]).select(*keep)


def introduced_2022(listed: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills introduced in 2022 with their ids (null where none matches)."""
    keyed = listed.withColumns({"bill_merge": bill_key(F.col("bill")), "year": F.col("year").cast("string")})
    keyed = recode.recode(recode.recode(keyed, "bill_merge", V.KEY_RULES_2022), "year", V.YEAR_RULES_2022)
    return joins.left_join(keyed, bills.select("bill_id", "title", "file", "bill_merge", "year"), ["bill_merge", "year"])


# --- votes ------------------------------------------------------------------


def final_votes(urls: DataFrame) -> DataFrame:
    """Vote links to (bill, chamber, roll_call_id); the id is the last path segment."""
    links = text.snake_names(urls).select("bill", "house_url", "senate_url")
    long = reshape.lengthen(links, ["bill"], ["house_url", "senate_url"], "chamber", "url")
    long = recode.recode(long.withColumn("chamber", F.replace("chamber", F.lit("_url"), F.lit(""))), "bill", V.VOTE_BILL_NAMES)
    long = long.withColumn("roll_call_id", to_int(text.last_segment(F.col("url"))).cast("string"))
    return recode.recode(long, "roll_call_id", V.ROLL_CALL_IDS).select(
        "bill", "chamber", F.col("roll_call_id").cast("long").alias("roll_call_id")
    )


def vote_crosstab(bills: DataFrame, urls: DataFrame, rollcalls: DataFrame, votes: DataFrame, people: DataFrame) -> DataFrame:
    """'yea / total' per bill, party and chamber; 'Voice Vote' where a chamber has no roll call."""
    called = joins.left_join(bills.select("bill", "bill_id", "file"), final_votes(urls), ["bill"])
    called = joins.left_join(called, rollcalls.select("roll_call_id", "bill_id", "file", "date"), ["roll_call_id", "bill_id", "file"])
    cast = joins.left_join(called, votes.select("roll_call_id", "people_id", "vote_desc", "file"), ["roll_call_id", "file"])
    cast = joins.left_join(cast, people.select("file", "people_id", "party"), ["file", "people_id"])
    counted = cast.filter(F.col("vote_desc").isin("Yea", "Nay")).select("bill", "chamber", "party", "vote_desc")
    rows = joins.left_join(bills.select("bill").distinct(), counted, ["bill"])
    cells = reshape.crosstab_cells(
        rows, ["bill"],
        {c: F.col("chamber") == c for c in ("house", "senate")},
        {p: F.col("party") == p for p in ("R", "D", "I", "L")},
        F.col("vote_desc") == "Yea", empty_block="Voice Vote",
    )
    return cells.withColumnRenamed("bill", "Bill")


# --- state panel ------------------------------------------------------------


def provision_counts(provisions: DataFrame, impact: str = "R") -> DataFrame:
    """Counts by (state, pass, group): the small cube all state roll-ups start from."""
    return aggregate.tally(provisions.filter(F.col("impact") == impact), ["state", "pass", "group"])


def _roll_up(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(*aggregate.total_and_subset(F.col("n"), F.col("pass"), "intro", "passed"))


def democratic_shares(votes: DataFrame, years: Sequence[int] = (2016, 2020)) -> DataFrame:
    """Two-party Democratic share by state (upper case) and year, one column per year."""
    by_party = votes.groupBy(F.upper("state").alias("state"), "party_simplified", "year").agg(
        F.sum("candidatevotes").alias("candidatevotes")
    )
    two = by_party.filter(F.col("party_simplified").isin("DEMOCRAT", "REPUBLICAN"))
    shares = groups.with_share(two, ["state", "year"], "candidatevotes", small_groups=True)
    kept = shares.filter((F.col("party_simplified") == "DEMOCRAT") & F.col("year").isin(*years))
    return reshape.widen(kept, ["state"], "year", years, ["share"], name=lambda _, y: f"dem_share_{y}")


def unified_control(control: Column, name: Column, exceptions: Sequence[str]) -> Column:
    """Republican control, or a state of the exception list; unknown control stays null."""
    return (control == "Rep") | name.isin(*exceptions)


def state_panel(
    counts: DataFrame, demographics: DataFrame, earlier: DataFrame, index: DataFrame, states: DataFrame,
    votes: DataFrame, control: DataFrame, competitive: tuple[float, float] = (0.45, 0.55),
    exceptions: Sequence[str] = tuple(V.ONE_CHAMBER),
) -> DataFrame:
    """One row per state: provision counts, demographics, vote shares, control.

    ``earlier`` holds (GEOID, nh_white) of the baseline year, ``index`` (state,
    year, FinalCOVI) and ``states`` (state, state_name, state_code).
    """
    members = demographics.filter(not_in(F.col("NAME"), V.NOT_STATES))
    panel = joins.fill_from_dimension(members, _roll_up(counts, "state"), [("NAME", "state")], ["intro", "passed"])
    panel = joins.left_join(panel, earlier.select("GEOID", F.col("nh_white").alias("nh_white_before")), ["GEOID"])
    named = joins.left_join(
        states.select("state", "state_name").distinct(), index.filter("year = 2020").select("state", "FinalCOVI"), ["state"]
    ).drop("state")
    panel = joins.left_join(panel, named, [("NAME", "state_name")])
    panel = panel.withColumns(
        {
            "change_white": numeric.relative_change(F.col("nh_white"), F.col("nh_white_before")),
            "change_white_abs": F.col("nh_white") - F.col("nh_white_before"),
            "upper_name": F.upper("NAME"),
        }
    )
    panel = joins.left_join(panel, democratic_shares(votes), [("upper_name", "state")]).drop("upper_name")
    panel = joins.left_join(panel, control.select("NAME", "control"), ["NAME"])
    r = unified_control(F.col("control"), F.col("NAME"), exceptions)
    close = numeric.strictly_between(F.col("dem_share_2020"), *competitive)
    panel = panel.withColumns(
        {
            "change_dem": F.col("dem_share_2020") - F.col("dem_share_2016"),
            "population": F.ln("population"),
            "median_income": F.col("median_income") / 10000,
            "r": if_else_na(r, F.lit("Republican"), F.lit("Other")),
            "competitive": if_else_na(close, F.lit("Competitive"), F.lit("ANC")),
        }
    )
    return numeric.across(panel, ["nh_white", "some_college", "change_dem"], lambda c: c * 100)


def category_table(counts: DataFrame) -> DataFrame:
    """Introduced and passed counts by named category, 'Other' last."""
    named = F.col("group")
    label = text.title_case(named)
    for raw, name in V.CATEGORY_NAMES.items():
        label = F.when(named == raw, name).otherwise(label)
    table = _roll_up(counts, "group").withColumn("group", label)
    return aggregate.ranked_categories(table, "group", "intro", "Other")


def state_counts(counts: DataFrame, states: DataFrame) -> DataFrame:
    """Counts of every state, those without provisions included as 0."""
    members = states.filter(not_in(F.col("state_name"), V.NOT_STATES)).select(F.col("state_name").alias("state")).distinct()
    return joins.fill_from_dimension(members, _roll_up(counts, "state"), ["state"], ["intro", "passed"])


# --- district panel ---------------------------------------------------------


def district_shares(precincts: DataFrame, lower: DataFrame, upper: DataFrame, dem: str, rep: str) -> DataFrame:
    """Two-party share by district: precinct centroids placed in districts of their state."""
    votes = numeric.across(precincts, [dem, rep], numeric.grouped_number)
    middle = votes.withColumn("c", spatial.centroid(F.col("rings"))).withColumns({"x": F.col("c.x"), "y": F.col("c.y")})
    placed = spatial.assign_layers(
        middle.drop("c", "rings"), "x", "y", {"lower": (lower, "GEOID"), "upper": (upper, "GEOID")}, within=["state"]
    )
    measures = [strict(F.sum, F.col(dem)).alias(dem), strict(F.sum, F.col(rep)).alias(rep), F.count(F.lit(1)).alias("n")]
    sums = aggregate.stack_grains(placed, {"HD": "lower", "SD": "upper"}, measures)
    return sums.withColumn("share_dem", aggregate.share_of(dem, [dem, rep])).drop(dem, rep)


def county_shares(results: DataFrame, year: int = 2020) -> DataFrame:
    kept = results.filter((F.col("year") == year) & F.col("party").isin("REPUBLICAN", "DEMOCRAT"))
    share = aggregate.conditional_ratio(F.col("candidatevotes"), F.col("party") == "DEMOCRAT")
    return kept.groupBy(F.col("county_fips").cast("string").alias("county")).agg(share.alias("share_dem"))


def block_crosswalk(blocks: DataFrame, upper: DataFrame, lower: DataFrame, zips: DataFrame | None = None) -> DataFrame:
    """Census blocks with their upper and lower district (of the same state) and zip area."""
    points = blocks.withColumns({"x": F.col("INTPTLON20").try_cast("double"), "y": F.col("INTPTLAT20").try_cast("double")})
    placed = spatial.assign_layers(points, "x", "y", {"upper": (upper, "GEOID"), "lower": (lower, "GEOID")}, within=["state"])
    if zips is not None:
        placed = spatial.assign_polygon(placed, "x", "y", zips, "GEOID", "zip")
    return placed.drop("x", "y", "INTPTLON20", "INTPTLAT20")


def survey_scores(survey: DataFrame, race: int = 1) -> DataFrame:
    """Two 1-5 answers, the first turned around, averaged; zip codes padded to five digits."""
    score = (numeric.reverse_scale(F.col("CC20_441a"), 5) + F.col("CC20_441b")) / 2
    zip_code = text.pad_left(F.col("lookupzip").cast("string"), 5)
    return survey.filter(F.col("race") == race).select(zip_code.alias("zip"), score.alias("rr"))


def district_sponsors(sponsors: DataFrame, overrides: DataFrame, states: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sponsored provisions per (state, district, chamber): counts by impact, introduced and passed.

    A seat with sponsors of several parties is labelled 'M'.
    """
    patched = recode.recode(sponsors, "party", V.SPONSOR_PARTY)
    keyed = joins.left_join(patched, overrides, on)
    split = text.split_columns(keyed, "district", "-", 3)
    codes = states.select("state_name", "state_code").distinct()
    split = joins.left_join(split, codes, [("state", "state_name")])
    split = recode.recode(split, "district_2", V.DISTRICT_RULES)
    computed = paste(F.col("state_code"), F.col("district_2"), sep="")
    seats = split.select(
        "state", F.coalesce("GEOID", computed).alias("district"), F.col("district_1").alias("chamber"), "impact", "party", "pass"
    )
    counts = seats.filter(F.col("impact").isNotNull()).groupBy("state", "district", "chamber", "impact", "party").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pass").cast("int")).alias("n_pass")
    )
    ids = ["state", "district", "chamber"]
    wide = reshape.widen(counts, [*ids, "party"], "impact", IMPACTS, ["n", "n_pass"], fill=0)
    return groups.relabel_mixed(wide, ids, "party", "M", numeric.by_prefix(wide, "n_"))


def by_impact(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``n_R, n_pass_R, ...`` to one row per impact with counts and sponsor flags by stage."""
    stages = F.array(
        *[F.struct(F.lit(i).alias("impact"), F.col(f"n_{i}").alias("n_intro"), F.col(f"n_pass_{i}").alias("n_pass")) for i in IMPACTS]
    )
    rows = df.select(*ids, F.inline(stages))
    return rows.withColumns({"sp_intro": F.col("n_intro") > 0, "sp_pass": F.col("n_pass") > 0})


def district_panel(
    demographics: DataFrame, earlier: DataFrame, sponsors: DataFrame, state_demographics: DataFrame, shares: DataFrame,
    fallback: DataFrame, votes: DataFrame, control: DataFrame, states: DataFrame, scores: DataFrame,
    competitive: tuple[float, float] = (0.45, 0.55), exceptions: Sequence[str] = tuple(V.ONE_CHAMBER),
) -> DataFrame:
    """One row per (district, chamber, impact), complete in every model column.

    ``demographics`` holds both chambers at (GEOID, chamber).
    """
    keys = ["GEOID", "chamber"]
    base = joins.left_join(demographics, earlier.select(*keys, F.col("nh_white").alias("nh_white_before")), keys)
    base = groups.with_inverse_size(base.withColumn("state_code", text.chars(F.col("GEOID"), 1, 2)), ["state_code", "chamber"])
    facts = sponsors.drop("state", "party")
    counts = [c for c in facts.columns if c.startswith("n_")]
    base = joins.fill_from_dimension(base, facts, [("GEOID", "district"), "chamber"], counts)
    panel = by_impact(base, [c for c in base.columns if c not in counts])
    around = state_demographics.select(F.col("GEOID").alias("state_code"), F.col("nh_white").alias("state_nh_white"))
    panel = joins.left_join(panel, around, ["state_code"]).filter(F.col("nh_white").isNotNull())
    share = joins.prefer_first(shares.select(*keys, "share_dem"), fallback.select(*keys, "share_dem"), keys, "share_dem")
    panel = joins.left_join(panel, share, keys)
    panel = panel.withColumns(
        {
            "share_rep": 1 - F.col("share_dem"),
            "south": F.col("state_code").isin(*V.SOUTH),
            "population": F.ln("population"),
            "median_income": F.col("median_income") / 10000,
            "change_white": F.try_divide(F.col("nh_white"), F.col("nh_white_before")),
        }
    )
    panel = numeric.across(panel, ["nh_white", "state_nh_white", "some_college", "share_rep"], lambda c: c * 100)
    close = numeric.strictly_between(F.col("dem_share_2020"), *competitive)
    codes = states.select("state_code", "state_name").distinct()
    context = joins.left_join(codes.withColumn("upper_name", F.upper("state_name")), democratic_shares(votes), [("upper_name", "state")])
    context = joins.left_join(context, control.select("NAME", "control"), [("state_name", "NAME")])
    r = unified_control(F.col("control"), F.col("state_name"), exceptions)
    panel = joins.left_join(panel, context.select("state_code", close.alias("competitive"), r.alias("r")), ["state_code"])
    panel = numeric.across(panel, ["sp_intro", "sp_pass"], lambda c: c.cast("int") * 100)
    panel = joins.left_join(panel, scores.select(*keys, "resent"), keys)
    return panel.dropna(subset=PANEL_COLUMNS)


#: Columns a district needs to enter the models (the score may be missing).
PANEL_COLUMNS = [
    "sp_intro", "nh_white", "state_nh_white", "share_rep", "median_income", "median_age", "population", "some_college",
    "competitive", "r",
]


def party_tallies(sponsors: DataFrame) -> DataFrame:
    """Sponsorships by party, among all and among primary sponsors, in one pass."""
    patched = recode.recode(sponsors, "party", V.SPONSOR_PARTY)
    counts = patched.groupBy("party").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("position") == 1).alias("primary"))
    label = F.lit(None).cast("string")
    for letter, name in V.PARTY_NAMES.items():
        label = F.when(F.col("party") == letter, name).otherwise(label)
    return counts.select(label.alias("party"), "all", "primary")


# --- model sets -------------------------------------------------------------

_R = Factor("r", ("Other", "Republican"))
_CLOSE = Factor("competitive", ("ANC", "Competitive"))
_WHITE = Poly("nh_white", 2)
_SHARE = Poly("share_rep", 2)
_COVARIATES = ("median_income", "median_age", "population", "some_college")


def state_specs() -> dict[str, Spec]:
    """Introduced and passed counts: composition alone, competition alone, full."""
    out = {}
    for y in ("intro", "passed"):
        out[f"{y}_white"] = Spec.of(y, crossing(_WHITE, _R))
        out[f"{y}_competitive"] = Spec.of(y, crossing(_CLOSE, _R))
        out[f"{y}_full"] = Spec.of(
            y, crossing(_WHITE, _R), "FinalCOVI", crossing(_CLOSE, _R), "change_dem", "median_income", "median_age",
            "population", "some_college",
        )
    return out


def district_specs(outcome: str = "sp_intro") -> dict[str, Spec]:
    """Models fitted per chamber (slices) on rows of one impact."""
    return {
        "white": Spec.of(outcome, crossing(_WHITE, "state_nh_white")),
        "share": Spec.of(outcome, _SHARE),
        "full": Spec.of(outcome, crossing(_WHITE, "state_nh_white"), _SHARE, *_COVARIATES, "competitive", "r"),
        "score": Spec.of(outcome, "resent"),
        "score_full": Spec.of(outcome, "resent", _SHARE, *_COVARIATES, "competitive", "r", _WHITE),
    }

"""Fixed values of the 2021 and 2022 provision studies.

Everything in this file is data that must hold exactly these values for the study
results to come out: identifier formats per state, corrections of misrecorded
bills, category names.  The rules are applied by ``study.py``.
"""

from __future__ import annotations

from ..functions.text import NumberRule
from ..operators.recode import Assign, Compute, Exact, Swap, in_list

# How each state writes the number in a bill identifier, by study.
NUMBERS_2021 = [
    NumberRule(("FL", "ID"), keep=1, insert="B"),
    NumberRule(("IN", "UT", "WY", "TN", "CT", "IL", "MI"), keep=2, unless=("HCR", "HJR"), unless_scopes=("MI", "IL")),
    NumberRule(("SC", "RI"), keep=1),
    NumberRule(("NY",), keep=1, insert="B"),
]
NUMBERS_PASSED_2021 = [
    NumberRule(("FL", "ID"), keep=1, insert="B"),
    NumberRule(("IN", "UT", "WY"), keep=2),
    NumberRule(("NY",), keep=1, insert="B"),
]
NUMBERS_2022 = [
    NumberRule(("FL", "ID"), keep=1, insert="B"),
    NumberRule(("IN", "UT", "WY", "MI"), keep=2),
    NumberRule(("NY",), keep=1, insert="B"),
]
# States whose listed bill numbers carry a letter to drop.
DROP_LETTER_2021 = [Swap("state = 'NC'", "B")]

# Column positions of the provision lists (1-based).
INTRODUCED_COLUMNS = {"state": 1, "bill": 2, "subject": 3, "impact": 4, "year": 18, "date_added": 9, "url": 11}
ENACTED_COLUMNS = {"state": 1, "bill": 2, "subject": 3, "impact": 4}

# Names of enacted bills as the introduced list writes them.
ENACTED_NAMES = [
    Exact("IA SF 413", "IA SF 413/IA SSB 1199"),
    Exact("IA SF 568", "IA SSB 1237/IA SF 568"),
    Exact("MT SB 176", "MT HB 176"),
]
ENACTED_YEAR = [Assign("bill = 'TX SB 1'", "2021 (S-2)")]

# Corrections of the bill key, in order.
KEY_RULES_2021 = [
    Swap("state = 'Rhode Island'", "B"),
    Swap("bill_merge like 'PA %'", "C"),
    Swap("substring(bill_merge, 1, 2) in ('SC', 'NC')", "B"),
    Swap("bill_merge like 'NJ %'", "B"),
    Exact("FL HJR61", "FL HB61"),
    Compute("bill_merge like 'ND %'", "concat(substring(bill_merge, 1, 3), substring(bill_merge, 6))"),
    Exact("VT SB15", "VT S0015"),
    Exact("ME HP104/LD148", "ME LD148"),
    Exact("ME HP68/LD102", "ME LD102"),
    Exact("ME HP78/LD112", "ME LD112"),
    Exact("PA SJR30", "PA SB30"),
    Exact("MS SCR508", "MS SC508"),
    Exact("MS SCR520", "MS SC520"),
    Exact("MS HCR17", "MS HC17"),
    Exact("NH HB2", "NH SB2"),
    Exact("TN SB1178", "TN HB1178"),
    Exact("TX HB237", "TX HR237"),
    Exact("ME HP143", "ME LD208"),
    Exact("ME LD253/HP174", "ME LD253"),
    Exact("IA SJR9/IASSB1083", "IA SSB1083"),
    Exact("ME SR91", "ME LD202"),
    Exact("VT SB50", "VT S0050"),
    Exact("MA SD241", "MA S485"),
    Exact("NC HJR330", "NC H330"),
    Exact("NC HB119", "NC H119"),
    Exact("MA HD652", "MA H825"),
    Exact("WV SB516", "WV SB561"),
    Exact("MA HD1393", "MA H812"),
    Exact("MA HD237", "MA H788"),
    Exact("MA SD39", "MA S484"),
    Exact("MA SD189", "MA S457"),
    Exact("MA HD449", "MA H838"),
    Swap("bill_merge like 'CT%'", "R"),
    Exact("ME HR73", "ME LD107"),
]

# Session years of bills recorded under another year, in order.
YEAR_2021 = ["NJ S2820", "NJ A4655", "NJ A4814", "NJ S3203", "TX SB287", "TX HR237"]
YEAR_2020 = [
    "TN SB2", "TX HB76", "TX HB400", "TX HB221", "TX HB583", "TX SB95", "TX HB230", "TX SB100", "VA SB1101", "VA HB1746",
    "DE HB15", "FL HB61", "NJ AB 5171", "NJ S3297", "TN SB18", "VA HB1758", "VA SB1118", "NJ A5165", "NJ S3300",
    "NJ A5166", "TN SB23", "VA HB1800", "VA SB1100", "NJ A5171", "CA AJR3", "FL SB402",
]
BACK_TO_2021 = [
    "TX HB304", "TX HB530", "TX HB574", "TX HB740", "TX SB287", "TX HB1031", "TX HB1026", "TX SB303", "TX SB342",
    "TX HB1128", "TX HB1056", "TX SB377", "TX SB379", "TX SB378", "TX SB381", "TX HB1174", "TX HB1176", "TX HB1175",
    "TX HB1170", "TX HB1179", "TX HB1232", "TX HB1244", "TX HB1242", "TX SB426", "TX HB1243", "TX HB1245", "TX SB408",
    "TX HB1366", "TX HB1385", "TX HB1375", "TX HB1382", "TX HB3424", "AR SB557",
]
YEAR_2022 = ["CA SB34", "CA AB53", "CA AB372", "NC H605"]
SPECIAL_2021 = ["MN SF2", "TX HB82"]
YEAR_RULES_2021 = [
    Assign(in_list("bill_merge", YEAR_2021), "2021"),
    Assign(in_list("bill_merge", YEAR_2020), "2020"),
    Assign("year = '2021' and state = 'Texas'", "2020", strict=True),
    Assign("year = '2020' and " + in_list("bill_merge", BACK_TO_2021), "2021"),
    Assign("state = 'Texas' and date_added >= date '2021-02-03' and year = '2020'", "2021", strict=True),
    Assign(in_list("bill_merge", YEAR_2022), "2022"),
    Assign(in_list("bill_merge", SPECIAL_2021), "2021 (S)"),
]

# Keys that are not bills of the study.
NOT_BILLS = "bill_merge not like 'KY BR%' and bill_merge <> 'MA H2559' and state <> ''"

# Corrections for bills introduced in 2022.
SHORT_KEYS_2022 = ["MA H812/MAHD1393", "MA H762/MAHD642", "MA H792/MAHD503", "MA S468/MASD1096", "MA H816/MAHD2703"]
KEY_RULES_2022 = [
    Exact("IA SSB1204/IASF531", "IA SSB1204"),
    Exact("NC SB326", "NC S326"),
    Exact("MA H3878/MAHD1349", "MA H3878"),
    Exact("MA HD2559", "MA H762"),
    Swap("bill_merge like 'PA%'", "C"),
    Swap("substring(bill_merge, 1, 2) in ('SC', 'NJ')", "B"),
    Swap("bill_merge like 'PA%'", "JR", "B"),
    Compute(in_list("bill_merge", SHORT_KEYS_2022), "substring(bill_merge, 1, 7)"),
]
PREFILED_2022 = [
    "NH HB1153", "NH HB1522", "NH HB1543", "NH HB1542", "NH CACR36", "VA HB34", "VA HB35", "VA HB36", "VA HB39", "VA HB46",
    "VA HB24", "NH SB418",
]
YEAR_RULES_2022 = [
    Assign(in_list("bill_merge", ["CA SB511", "CA SB597"]), "2022"),
    Assign(in_list("bill_merge", PREFILED_2022), "2021"),
]

# Bill names and roll-call ids of the final-vote list.
VOTE_BILL_NAMES = [Exact("IA SF 413/IA SSB 1199", "IA SF 413")]
ROLL_CALL_IDS = [
    Assign("bill = 'OK HB 2663' and chamber = 'house'", "1073681"),
    Assign("bill = 'OK HB 2663' and chamber = 'senate'", "1060047"),
]

# Sponsors with a missing or wrong party.
SPONSOR_PARTY = [
    Assign("bill = 'MA S 2554' and position = 1", "D", strict=True),
    Assign("party = '' and position = 1", "R", strict=True),
]

# How four states write district numbers.
DISTRICT_RULES = [
    Compute("state = 'Alaska' and district_1 = 'SD'", "concat('00', district_2)"),
    Compute("state = 'Minnesota' and district_1 = 'HD'", "substring(district_2, 2)"),
    Compute("state = 'Washington' and district_1 = 'HD'", "substring(district_2, 1, 3)"),
    Compute("state = 'Maryland' and district_1 = 'HD' and district_2 rlike '[A-Z]$'", "substring(district_2, 2)"),
]

# State codes counted as the South; states left out of the state panel.
SOUTH = ["01", "48", "40", "22", "28", "05", "12", "13", "47", "45", "37", "21", "51", "54"]
NOT_STATES = ["Puerto Rico", "District of Columbia"]
ONE_CHAMBER = ["Nebraska"]

# Category names in figures and tables.
CATEGORY_NAMES = {
    "3pvro": "Third-Party Registration Organizations",
    "absentee": "Absentee Voting",
    "disenfranchisement": "Felony Disenfranchisement",
    "early": "Early Voting",
    "voter id": "Voter ID",
}
PARTY_NAMES = {"R": "Republican", "D": "Democrat", "N": "Non-Partisan"}

# Row labels of the coefficient tables, in order.
STATE_LABELS = {
    "poly(nh_white, 2)1": "Nonhispanic White",
    "poly(nh_white, 2)2": "Nonhispanic White^2",
    "rRepublican": "Unified Republican Control",
    "poly(nh_white, 2)1:rRepublican": "Nonhispanic White x Unified Republican Control",
    "poly(nh_white, 2)2:rRepublican": "Nonhispanic White^2 x Unified Republican Control",
    "competitiveCompetitive": "Competitive in 2020",
    "rRepublican:competitiveCompetitive": "Unified Republican Control x Competitive",
    "competitiveCompetitive:rRepublican": "Unified Republican Control x Competitive",
    "FinalCOVI": "2020 COVI",
    "change_dem": "Change in Dem. Vote Share 2016-2020",
    "median_income": "Median Income ($10,000s)",
    "median_age": "Median Age",
    "some_college": "Share with Some College",
    "population": "Log(Population)",
    "(Intercept)": "Intercept",
}
DISTRICT_LABELS = {
    "resent": "Racial Resentment Score",
    "poly(nh_white, 2)1": "Nonhispanic White",
    "poly(nh_white, 2)2": "Nonhispanic White^2",
    "state_nh_white": "State % Nonhispanic White",
    "poly(nh_white, 2)1:state_nh_white": "Nonhispanic White x State % Nonhispanic White",
    "poly(nh_white, 2)2:state_nh_white": "Nonhispanic White^2 x State % Nonhispanic White",
    "poly(share_rep, 2)1": "Trump 2020 Voteshare",
    "poly(share_rep, 2)2": "Trump 2020 Voteshare^2",
    "median_income": "Median Income ($10,000s)",
    "median_age": "Median Age",
    "some_college": "Share with Some College",
    "population": "Log(Population)",
    "competitiveTRUE": "State Competitive in 2020",
    "rTRUE": "State has Unified Republican Control",
    "(Intercept)": "Intercept",
}
